"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours move to the least of them; here u > v on every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """Count and two independent 64-bit checksums of a table of different edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Stars of a table small enough for one task: union by least id."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                low, high = sorted((top(a), top(b)))
                up[high] = low
        yield pd.DataFrame([(x, top(x)) for x in up], columns=["node", "component"], dtype="int64")

    return edges.coalesce(1).mapInPandas(solve, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """Component of every node that has an edge: ``(node, component)``, component = least node of it.

    ``edges`` has columns u and v of type long. Loops, repeated edges, both directions and an empty table are
    fine; rows with a null end are ignored. Each round is written to the shared folder, so lost executors cost
    one round at most. No row set reaches the driver: only a count and a checksum do. A table of at most ``small``
    different edges (0: none) is solved in one task instead, with the same result.
    """
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNull() | F.col("v").isNull()).alias("gap"))
    loops = tidy.where("not gap and u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = materialize(tidy.where("not gap and u <> v").select("u", "v").distinct(), "cc")
    state = _state(now)
    if state[0] <= small:
        return _in_one_task(now).union(loops).groupBy("node").agg(F.min("component").alias("component"))
    for _ in range(max_rounds):
        large = _large_star(now).where("u <> v").distinct()
        after = materialize(_small_star(large).distinct(), "cc")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
