"""Exact top-k by inner product with MaxScore over postings.

A term is a dimension with a sign; its postings are the rows of a shard whose component has that sign. A query's terms
are the dimensions where it is not 0, each with the sign that adds to its score; their bounds are the query's component
times the largest posting. Terms of small bounds, together below the query's k-th score so far, are non-essential: a row
found in none of the others cannot be among the best. Essential postings are added up term by term; what they touch
is probed in the other terms, largest bound first, and leaves as soon as its bound falls below the k-th score. Components
of the other sign only lower a score; they are probed along.

Queries are dealt into blocks, rows into shards; every block meets every shard in one task, which holds one of each.
A first pass over one shard gives every query a score to start from. What leaves a task are k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.llm.codes import finite
from stratigraph.session import ship
from stratigraph.storage import discard, materialize

#: Results a query, the factor before rounding down, and which ids are queries.
TOP, SCALE, EVERY = 5, 256, 50
#: Rows of a shard, queries of a block.
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Integer components must be smaller than this, so that scores of 1000 components stay below 2^63.
LIMIT = 1 << 26
FOUND = "query_id long, copy long, vec_id long, score long"


class Shard:
    """Postings of a block of rows: for each dimension the places of positive and of negative components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.columns = ids, np.ascontiguousarray(x.T)
        self.postings = {(d, sign): np.flatnonzero(sign * column > 0) for d, column in enumerate(self.columns) for sign in (1, -1)}
        self.most = {(d, sign): max(int((sign * column).max(initial=0)), 0) for d, column in enumerate(self.columns) for sign in (1, -1)}

    def best(self, own: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best rows but ``own``, of those with a score of at least ``floor`` if given."""
        terms = sorted((abs(int(q[d])) * self.most[d, s], d, s) for d in np.flatnonzero(q).tolist() for s in (int(np.sign(q[d])),))
        bounds = np.cumsum([t[0] for t in terms], dtype=np.int64)  # of the terms up to each
        first = int(np.searchsorted(bounds, floor)) if floor is not None else 0  # terms before it are non-essential
        score = np.zeros(len(self.ids), np.int64)
        if floor is None or floor <= 0:
            rows = np.flatnonzero(self.ids != own)  # a row without any term may be among the best
        else:
            touched = np.zeros(len(self.ids), bool)
            for _, d, s in terms[first:]:
                touched[self.postings[d, s]] = True
            rows = np.flatnonzero(touched & (self.ids != own))
        for _, d, s in terms[first:]:
            at = self.postings[d, s]
            score[at] += q[d] * self.columns[d, at]
        # what lowers a score in the essential dimensions; then the others, largest first
        for _, d, s in reversed(terms[first:]):
            score[rows] += np.minimum(q[d] * self.columns[d, rows], 0)
        for at in range(first - 1, -1, -1):
            if floor is not None:
                rows = rows[score[rows] + bounds[at] >= floor]
            score[rows] += q[terms[at][1]] * self.columns[terms[at][1], rows]
        if floor is not None:
            rows = rows[score[rows] >= floor]
        if len(rows) > k:
            edge = np.partition(score[rows], len(rows) - k)[len(rows) - k]
            rows = rows[score[rows] >= edge]
        rows = rows[np.lexsort((self.ids[rows], -score[rows]))][:k]
        return self.ids[rows], score[rows]


def _padded(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _met(queries: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, copy, vec_id, score): the ``k`` best of each shard for each query of ``queries`` (.., floor)."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            shard = Shard(right["vec_id"].to_numpy(np.int64), _padded(right["x"], width))
            for own, copy, q, floor in zip(left["query_id"], left["copy"], _padded(left["x"], width), left["floor"], strict=True):
                ids, score = shard.best(int(own), q, k, None if pd.isna(floor) else int(floor))
                out.append(pd.DataFrame({"query_id": own, "copy": copy, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "copy", "vec_id", "score")})

    return queries.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInPandas(meet, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def max_score(queries: DataFrame, rows: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` rows of largest inner product for each query, ties by vec_id.

    Both tables are (vec_id, x: array of integers below ``LIMIT``). A shorter vector is 0 beyond its end. Rows with the
    query's own vec_id are left out. A null vec_id takes no part. Equal rows (id and vector) count once; different
    vectors of one id are candidates each, and as queries give a list each. Fewer than ``k`` candidates: all of them.
    """
    ship(rows.sparkSession)
    held = materialize(rows.where("vec_id is not null").select("vec_id", "x").distinct(), "topk")
    n, width, most = held.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    asked = queries.where("vec_id is not null").select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("copy"), "x").distinct()
    asked = materialize(asked, "topk")
    m, wide, big = asked.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if max(most or 0, big or 0) >= LIMIT:
        raise ValueError(f"components must be below {LIMIT}")
    width = max(width or 0, wide or 0)
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    number = lambda c, of: F.pmod(F.xxhash64(c, "x"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = held.withColumn("shard", number("vec_id", shards)).withColumn("block", every(blocks))
    asking = asked.withColumn("block", number("query_id", blocks))
    start = asking.withColumn("shard", F.lit(0)).withColumn("floor", F.lit(None).cast("long"))
    seen = materialize(_met(start, dealt.where("shard = 0"), k, width), "topk")
    floors = seen.groupBy("query_id", "copy").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    known = asking.join(floors, ["query_id", "copy"], "left").withColumn("shard", every(shards)).where("shard > 0")
    found = seen if shards == 1 else seen.union(_met(known.select(*start.columns), dealt.where("shard > 0"), k, width))
    out = materialize(_ranked(found, k).select("query_id", "rank", "vec_id", "score"), "topk")
    for used in (held, asked, seen):
        discard(used)
    return out


def integers(vector: str | Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def top_vectors(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors (vec_id, embedding)``; queries have a vec_id that ``every`` divides.

    Vectors that are null or hold nulls or values that are not finite take no part. An empty table gives an empty result.
    """
    rows = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding").alias("x"))
    return max_score(rows.where(F.col("vec_id") % every == 0), rows, k)
