"""Evaluation of partitions: counts of pairs, group types and information measures, all from group sizes.

Tables hold one row per item with a predicted cluster (``pred``; below 0: unassigned) and a true group (``true``).
No pair of items is ever made: sizes are aggregated first and pairs are counted as n (n - 1) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.session import ship
from stratigraph.storage import materialize


def pairs_in(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (n * (n - 1) / 2).cast("long")


def ground_truth_stats(df: DataFrame, true: str = "true") -> DataFrame:
    """n_items, n_groups, n_pairs."""
    return df.groupBy(true).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(pairs_in("n")), F.lit(0)).alias("n_pairs"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pairwise_confusion(df: DataFrame, by: list[str] | None = None, pred: str = "pred", true: str = "true") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, in all or for each value of ``by``.

    Items with pred < 0 are in no predicted pair but count among true pairs and the total; 0/0 is 0.
    """
    by = by or []
    cells = df.groupBy(*by, pred, true).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col(pred) >= 0
    side = lambda c, where: cells.where(where).groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs_in("n")).alias(f"in_{c}"))
    both = cells.groupBy(*by).agg(F.sum(F.when(inside, pairs_in("n")).otherwise(0)).alias("tp"), F.sum("n").alias("items"))
    if by:
        joined = both.join(side(pred, inside), by, "left").join(side(true, F.lit(True)), by, "left")
    else:
        joined = both.crossJoin(side(pred, inside)).crossJoin(side(true, F.lit(True)))  # one row each
    tp, p, t = (F.coalesce(c, F.lit(0)).cast("long") for c in ("tp", f"in_{pred}", f"in_{true}"))
    counted = joined.select(*by, tp.alias("tp"), (p - tp).alias("fp"), (t - tp).alias("fn"), (F.coalesce(pairs_in("items"), F.lit(0)) - p - t + tp).alias("tn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counted.withColumns({"precision": precision, "recall": recall})
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def group_types(df: DataFrame, true: str = "true", species: str = "species") -> DataFrame:
    """(true, type): 1:1 if every species has one member, n:m if every one has several, else 1:m."""
    counts = df.groupBy(true, species).agg(F.count(F.lit(1)).alias("c"))
    kind = F.when(F.bool_and(F.col("c") == 1), "1:1").when(F.bool_and(F.col("c") > 1), "n:m").otherwise("1:m")
    return counts.groupBy(true).agg(kind.alias("type"))


def type_metrics(df: DataFrame, pred: str = "pred", true: str = "true", species: str = "species") -> DataFrame:
    """Pairwise metrics of the items of each group type: (type, n_groups, n_items, tp, ..., f1)."""
    types = group_types(df, true, species)
    typed = df.join(types, true)
    size = typed.groupBy("type").agg(F.countDistinct(true).alias("n_groups"), F.count(F.lit(1)).alias("n_items"))
    return pairwise_confusion(typed, ["type"], pred, true).join(size, "type")


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n, na, nb, total) for each cell; an a or b below 0 is a group like any other."""
    by = by or []
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c)) if by or c else None
    cells = cells.withColumns({"na": over(a), "nb": over(b)})
    if by:
        return cells.withColumn("total", over())
    return cells.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def _entropies(cells: DataFrame, by: list[str]) -> DataFrame:
    """Mutual information and the two entropies, in nats."""
    p = F.col("n") / F.col("total")
    mi = F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))))
    h = lambda c: -F.sum(p * F.log(F.col(c) / F.col("total")))
    return cells.groupBy(*by).agg(F.greatest(mi, F.lit(0.0)).alias("mi"), F.greatest(h("na"), F.lit(0.0)).alias("ha"), F.greatest(h("nb"), F.lit(0.0)).alias("hb"))


def nmi(df: DataFrame, a: str = "pred", b: str = "true", by: list[str] | None = None) -> DataFrame:
    """Normalised mutual information with the arithmetic mean; two partitions of one group each give 1."""
    got = _entropies(contingency(df, a, b, by), by or [])
    return got.select(*(by or []), F.when((F.col("ha") < 1e-15) & (F.col("hb") < 1e-15), 1.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def v_measure(df: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """homogeneity, completeness, v_measure; unassigned items are one ordinary cluster here."""
    got = _entropies(contingency(df, pred, true), [])
    share = lambda h: F.when(F.col(h) < 1e-15, 1.0).otherwise(F.col("mi") / F.col(h))
    got = got.select(share("hb").alias("homogeneity"), share("ha").alias("completeness"))
    return got.withColumn("v_measure", _ratio(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")))


def overlap_information(x: int, y: int, n: int) -> float:
    """Expected part of the mutual information of two groups of x and y among n items that meet by chance.

    The overlap k is hypergeometric. Its probabilities follow from the ratio of neighbours and are brought to sum 1, so no
    factorial is needed at any n. Overlaps beyond 40 standard deviations and 100 of the mean weigh nothing in doubles.
    """
    mean = x * (y / n)
    reach = 40 * np.sqrt(mean * (1 - x / n) * (1 - y / n) * n / max(n - 1, 1)) + 100
    least, most = max(0, x + y - n, int(mean - reach)), min(x, y, int(mean + reach) + 1)
    k = np.arange(least, most + 1, dtype=np.float64)
    up = np.log((x - k[:-1]) * (y - k[:-1])) - np.log(k[1:] * (n - x - y + k[1:]))
    weight = np.r_[0.0, np.cumsum(up)]
    weight = np.exp(weight - weight.max())
    some = k > 0
    k, weight = k[some], weight[some] / weight.sum()
    return float((k / n * (np.log(k / x) - np.log(y / n)) * weight).sum())


def _expected_mi(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(expected) mutual information of random partitions with the group sizes of ``cells``, in one row.

    Groups of one size are counted first, so a side has at most sqrt(2 N) different sizes. Both lists of sizes are dealt into
    blocks of about 64, and each meeting of two blocks is one row of work of its own.
    """
    ship(cells.sparkSession)
    sizes = lambda c, n: cells.select(c, n).distinct().groupBy(F.col(n).alias("size")).agg(F.count(F.lit(1)).alias("times"))

    def blocks(table: DataFrame, part: str, items: str) -> DataFrame:
        parts = int(np.ceil(table.count() / 64)) or 1
        dealt = table.groupBy(F.pmod(F.xxhash64("size"), F.lit(parts)).cast("int").alias(part)).agg(F.collect_list(F.struct("size", "times")).alias(items))
        return dealt

    left, right = blocks(materialize(sizes(a, "na"), "sizes"), "pa", "left"), materialize(blocks(materialize(sizes(b, "nb"), "sizes"), "pb", "right"), "sizes")
    meet = left.crossJoin(F.broadcast(right.agg(F.collect_set("pb").alias("parts")))).select("pa", "left", F.explode("parts").alias("pb"))  # one row
    met = meet.join(right, "pb").crossJoin(F.broadcast(cells.agg(F.max("total").alias("n")))).repartition("pa", "pb")  # one row

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = [
                sum(p["times"] * q["times"] * overlap_information(p["size"], q["size"], n) for p in one for q in other)
                for one, other, n in zip(batch["left"], batch["right"], batch["n"].tolist(), strict=True)
            ]
            yield pd.DataFrame({"e": sums}, dtype="float64")

    return met.select("left", "right", "n").mapInPandas(work, "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("expected"))


def adjusted_mutual_info(df: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """ami, with the arithmetic mean; 1 for two partitions of one group each, of single items each, or of no item."""
    cells = materialize(contingency(df, pred, true), "cells")
    shape = cells.agg(F.countDistinct(pred).alias("groups_a"), F.countDistinct(true).alias("groups_b"), F.coalesce(F.max("total"), F.lit(0)).alias("n"))
    got = _entropies(cells, []).crossJoin(_expected_mi(cells, pred, true)).crossJoin(shape)  # one row each
    below = (F.col("ha") + F.col("hb")) / 2 - F.col("expected")
    least = F.lit(float(np.finfo(float).eps))
    below = F.when(below < 0, F.least(below, -least)).otherwise(F.greatest(below, least))
    trivial = (F.col("groups_a") == F.col("groups_b")) & ((F.col("groups_a") <= 1) | (F.col("groups_a") == F.col("n")))
    return got.select(F.when(trivial, 1.0).otherwise((F.col("mi") - F.col("expected")) / below).alias("ami"))


def purity_entropy(df: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """Unweighted means over clusters of the largest share and of the entropy in bits."""
    cells = df.groupBy(pred, true).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(pred))
    per = cells.withColumn("p", p).groupBy(pred).agg(F.max("p").alias("purity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return per.agg(F.avg("purity").alias("purity"), F.avg("entropy").alias("entropy"))


def cluster_counts(df: DataFrame, pred: str = "pred") -> DataFrame:
    """n_clusters (assigned ones), n_unassigned (items), n_size1 (clusters of one item)."""
    sizes = df.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col(pred) >= 0
    return sizes.agg(F.count_if(inside).alias("n_clusters"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_unassigned"), F.count_if(inside & (F.col("n") == 1)).alias("n_size1"))


TYPE_PREFIX = {"1:1": "oto", "1:m": "otm", "n:m": "ntm"}


def evaluate_clustering(df: DataFrame, pred: str = "pred", true: str = "true", species: str = "species") -> DataFrame:
    """One wide row: pair metrics, information measures, counts and per-type precision, recall and f1 (0 where absent)."""
    wide = pairwise_confusion(df, None, pred, true).crossJoin(v_measure(df, pred, true)).crossJoin(adjusted_mutual_info(df, pred, true)).crossJoin(cluster_counts(df, pred))
    kinds = type_metrics(df, pred, true, species)
    flat = kinds.agg(*[F.coalesce(F.max(F.when(F.col("type") == k, F.col(m))), F.lit(0.0)).alias(f"{p}_{m}") for k, p in TYPE_PREFIX.items() for m in ("precision", "recall", "f1")])
    return wide.crossJoin(flat).withColumn("combined_score", F.col("f1"))  # one row each


def metric_triplet(precision: Column, recall: Column, f1: Column) -> Column:
    """P/R/F1 as text of four places."""
    return F.format_string("P=%.4f R=%.4f F1=%.4f", precision, recall, f1)
