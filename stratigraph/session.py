"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile

from pyspark.sql import SparkSession

_sent: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each Spark context.

    Functions that run in workers refer to their modules by name. The package is packed into one file that Spark itself
    hands to every executor, so nothing depends on installed copies, search paths or shared folders.
    """
    context = spark.sparkContext
    if context in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="stratigraph-")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    packed.write(whole, os.path.join("stratigraph", os.path.relpath(whole, root)))
    context.addPyFile(path)
    _sent.add(context)
