"""Names of inner columns beside those of a given table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores behind as it takes to differ from all columns of ``df``, in any case."""
    held, tail = {c.lower() for c in df.columns}, "_"
    while any((name + tail).lower() in held for name in names):
        tail += "_"
    return [name + tail for name in names]


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
