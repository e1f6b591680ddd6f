"""Whole runs put together from operators."""
