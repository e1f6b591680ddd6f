"""Levels of a multiscale grouping: relabelling, hierarchy, scores and selection.

``part(level, id, cluster)`` holds the levels, coarse to fine; cluster -1 is unassigned. Level tables have at most
some dozens of rows, so the choice among scored levels runs on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.operators.evaluation import nmi
from stratigraph.operators.ranking import positions

#: Weights of the composite score and steepness of its parts. Fixed values.
WEIGHTS = {"nmi": 0.18, "cohesion": 0.18, "separation": 0.18, "size_reg": 0.12, "consensus": 0.10, "target_prior": 0.10}
FRAGMENT_WEIGHT, FRAGMENT_FREE = 0.14, 0.10
#: Band edges as shares of N. Fixed values.
BANDS = (1 / 20, 1 / 10, 1 / 6, 1 / 4, 1 / 2, 0.7)


def relabel_contiguous(part: DataFrame, by: list[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """Clusters from 0 on, in order of their old numbers; below 0 stays. Only the different numbers are placed."""
    by = by or []
    ranks = positions(part.where(F.col(cluster) >= 0).select(*by, cluster).distinct(), cluster, by, "__new")
    return part.join(ranks, [*by, cluster], "left").withColumn(cluster, F.coalesce("__new", cluster)).drop("__new")


def build_hierarchy(part: DataFrame) -> DataFrame:
    """(level, cluster, parent_cluster, overlap) for levels from 1 on.

    The parent is the cluster of the level before that shares most members; among equals the one of the least id.
    overlap is the shared part of the fine cluster.
    """
    fine = part.where("cluster >= 0")
    coarse = fine.select((F.col("level") + 1).alias("level"), "id", F.col("cluster").alias("parent_cluster"))
    shared = fine.join(coarse, ["level", "id"]).groupBy("level", "cluster", "parent_cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    size = fine.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("level", "cluster").orderBy(F.desc("n"), "first")
    best = shared.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.join(size, ["level", "cluster"]).select("level", "cluster", "parent_cluster", (F.col("n") / F.col("size")).alias("overlap"))


def level_shapes(part: DataFrame) -> DataFrame:
    """(level, n_items, n_clusters, n_unassigned, n_size1) of each level."""
    sizes = part.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("cluster") >= 0
    return sizes.groupBy("level").agg(
        F.sum("n").alias("n_items"),
        F.count_if(inside).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_unassigned"),
        F.count_if(inside & (F.col("n") == 1)).alias("n_size1"),
    )


def is_feasible(k: Column, unassigned: Column, n: Column) -> Column:
    """At least two clusters, 1.3 items a cluster on average, at most half unassigned, at most 0.8 N clusters."""
    return F.when((k < 2) | (F.try_divide(n, k) < 1.3) | (unassigned / n > 0.5) | (k > 0.8 * n), False).otherwise(True)


def adjacent_nmi(part: DataFrame) -> DataFrame:
    """(level, nmi) with the level before, over items that both assign; the first level has 1."""
    fine = part.where("cluster >= 0")
    coarse = fine.select((F.col("level") + 1).alias("level"), "id", F.col("cluster").alias("coarse"))
    later = nmi(fine.join(coarse, ["level", "id"]), "cluster", "coarse", ["level"])
    levels = part.select("level").distinct()
    return levels.join(later, "level", "left").select("level", F.when(F.col("level") == 0, 1.0).otherwise(F.coalesce("nmi", F.lit(0.0))).alias("nmi"))


def edge_profile(part: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, cluster, size, internal, volume): edges inside each cluster and the sum of its members' degrees."""
    inside = part.where("cluster >= 0")
    ends = edges.select("u", "v")
    degree = ends.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    volume = inside.join(degree, "id", "left").groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("degree"), F.lit(0)).alias("volume"))
    at = lambda end, c: inside.select("level", F.col("id").alias(end), F.col("cluster").alias(c))
    both = ends.join(at("u", "cu"), "u").join(at("v", "cv"), ["level", "v"]).where("cu = cv")
    internal = both.groupBy("level", F.col("cu").alias("cluster")).agg(F.count(F.lit(1)).alias("internal"))
    return volume.join(internal, ["level", "cluster"], "left").fillna(0, ["internal"])


def cohesion(profile: DataFrame) -> DataFrame:
    """(level, cohesion): size-weighted mean of internal edges over possible ones; a cluster of one counts 0."""
    dense = F.when(F.col("size") > 1, 2 * F.col("internal") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return profile.groupBy("level").agg((F.sum(dense * F.col("size")) / F.sum("size")).alias("cohesion"))


def separation(profile: DataFrame, n_edges: int) -> DataFrame:
    """(level, conductance, separation): size-weighted mean of cut over the lesser volume, and 1 minus it."""
    cut = F.col("volume") - 2 * F.col("internal")
    least = F.least(F.col("volume"), F.lit(2 * n_edges) - F.col("volume"))
    each = F.when(least > 0, cut / least).otherwise(0.0)
    mean = F.least(F.greatest(F.sum(each * F.col("size")) / F.sum("size"), F.lit(0.0)), F.lit(1.0))
    return profile.groupBy("level").agg(mean.alias("conductance")).withColumn("separation", 1 - F.col("conductance"))


def cpm_quality(part: DataFrame, edges: DataFrame, resolution: float) -> DataFrame:
    """(level, quality): internal weight minus resolution times possible pairs, over all clusters."""
    inside = part.where("cluster >= 0")
    at = lambda end, c: inside.select("level", F.col("id").alias(end), F.col("cluster").alias(c))
    weight = edges.join(at("u", "cu"), "u").join(at("v", "cv"), ["level", "v"]).where("cu = cv").groupBy("level").agg(F.sum("w").alias("w"))
    pairs = inside.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("level").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return pairs.join(weight, "level", "left").select("level", (F.coalesce("w", F.lit(0.0)) - resolution * F.col("pairs")).alias("quality"))


def composite_scores(shapes: DataFrame, parts: DataFrame, target_ratio: float = 1 / 3) -> DataFrame:
    """Composite score of each level.

    ``shapes``: level_shapes; ``parts``: (level, nmi, cohesion, separation, consensus). Adds size_reg, fragmentation,
    target_prior, feasible, composite (-1 where infeasible), size_drift and dominant_factor.
    """
    k, n = F.col("n_clusters"), F.col("n_items")
    target = F.greatest(n * target_ratio, F.lit(10.0))
    fine = shapes.join(parts, "level").withColumn("feasible", is_feasible(k, F.col("n_unassigned"), n))
    prior = F.exp(-0.5 * F.pow((k - target) / (0.3 * target + 1e-6), F.lit(2)))
    fine = fine.withColumns({
        "separation": F.when(F.col("feasible"), F.col("separation")).otherwise(0.0),
        "size_reg": F.coalesce(F.least(F.try_divide(n, k) / (n / target), F.lit(1.0)), F.lit(0.0)),
        "fragmentation": F.greatest(F.lit(0.0), (F.col("n_unassigned") + F.col("n_size1")) / n - FRAGMENT_FREE),
        "target_prior": F.when(F.col("feasible"), prior).otherwise(0.0),
    })
    terms = {name: F.col(name) * w for name, w in WEIGHTS.items()}
    total = reduce(Column.__add__, terms.values()) - FRAGMENT_WEIGHT * F.col("fragmentation")
    all_terms = {**terms, "frag_penalty": -FRAGMENT_WEIGHT * F.col("fragmentation")}
    ranked = F.array_max(F.array(*[F.struct(t.alias("t"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, t) in enumerate(all_terms.items())]))
    before = F.lag(k).over(Window.partitionBy(F.lit(0)).orderBy("level"))  # dozens of rows
    return fine.withColumns({
        "composite": F.when(F.col("feasible"), total).otherwise(-1.0),
        "dominant_factor": F.when(F.col("feasible"), ranked["name"]).otherwise("infeasible"),
        "size_drift": F.when(k / before > 1, F.least(k / before / 3, F.lit(1.0))).otherwise(0.0),
    })


def plateau_bonus(levels: DataFrame) -> DataFrame:
    """(level, plateau_bonus) of feasible levels, three at least: flat in log1p(K) to both sides 0.10, to one 0.05.

    Flat is a step under half the median step (0.1 if that is 0); the ends count as flat outwards.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("level")  # dozens of rows
    steps = levels.where("feasible").select("level", F.log1p("n_clusters").alias("y"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    steps = steps.withColumns({"before": F.abs(F.col("y") - F.lag("y").over(order)), "after": F.abs(F.lead("y").over(order) - F.col("y"))})
    middle = F.median("after").over(Window.partitionBy(F.lit(0)))
    least = F.when(middle > 0, 0.5 * middle).otherwise(0.1)
    flat = F.coalesce(F.col("before") < F.col("least"), F.lit(True)).cast("int") + F.coalesce(F.col("after") < F.col("least"), F.lit(True)).cast("int")
    return steps.withColumn("least", least).where("n >= 3").select("level", F.element_at(F.array(F.lit(0.0), F.lit(0.05), F.lit(0.1)), flat + 1).alias("plateau_bonus"))


def band_of(k: Column, n: Column) -> Column:
    """Number of the band of K/N, from 0; the last band is open."""
    return reduce(Column.__add__, [(k >= n * b).cast("int") for b in BANDS])


def band_best(levels: DataFrame) -> DataFrame:
    """(band, level) with the best composite among feasible levels of each band; ties go to the first level."""
    inside = levels.where("feasible").withColumn("band", band_of(F.col("n_clusters"), F.col("n_items"))).where(F.col("band") < len(BANDS))
    order = Window.partitionBy("band").orderBy(F.desc("composite"), "level")
    return inside.withColumn("r", F.row_number().over(order)).where("r = 1").select("band", "level")


@dataclass
class Level:
    level: int
    n_clusters: int
    n_items: int
    composite: float
    feasible: bool = True


def select_levels(levels: list[Level], cap: int = 6, target_ratio: float = 1 / 3) -> list[int]:
    """Levels to keep, by number of clusters.

    Feasible ones only, all if there are at most ``cap``. Else the one nearest the target, the best of each band and,
    while there is room, the next best whose K differs from every chosen one by a tenth of it; anchor and bands
    together may exceed the cap by one. With no feasible level, all are kept.
    """
    good = [x for x in levels if x.feasible]
    if not good:
        return [x.level for x in sorted(levels, key=lambda x: x.n_clusters)]
    if len(good) > cap:
        n = good[0].n_items
        target = max(n * target_ratio, 10)
        chosen = [min(good, key=lambda x: (abs(x.n_clusters - target), -x.composite))]
        band = lambda x: sum(x.n_clusters >= n * b for b in BANDS)
        for number in range(len(BANDS)):
            own = [x for x in good if band(x) == number and x not in chosen]
            if own:
                chosen.append(max(own, key=lambda x: x.composite))
        for x in sorted(good, key=lambda x: -x.composite):
            if len(chosen) >= cap:
                break
            if x not in chosen and all(abs(x.n_clusters - c.n_clusters) / max(c.n_clusters, 1) >= 0.10 for c in chosen):
                chosen.append(x)
        good = chosen
    return [x.level for x in sorted(good, key=lambda x: x.n_clusters)]


def thin_ladder(levels: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """Levels (resolution, K) by K: the first, each that adds max(2, 5 %) clusters, and the finest if K grew at all."""
    ranked = sorted(levels, key=lambda x: x[1])
    out = ranked[:1]
    for level in ranked[1:]:
        if level[1] >= out[-1][1] + max(2, int(0.05 * out[-1][1])):
            out.append(level)
    if ranked and ranked[-1][0] != out[-1][0] and ranked[-1][1] > out[-1][1]:
        out.append(ranked[-1])
    return out


def consensus_mean(pairs: DataFrame) -> float:
    """Mean of a one-column table of agreement values; 1 if there is none."""
    got = pairs.agg(F.avg(pairs.columns[0])).first()[0]
    return 1.0 if got is None or math.isnan(got) else float(got)
