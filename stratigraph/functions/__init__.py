"""Column expressions and embedding providers."""
