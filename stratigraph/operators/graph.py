"""Neighbour graphs as edge tables (u < v, w) built by joins, set predicates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.operators.components import connected_components

#: Edges up to which components are found in one task; beyond it in rounds over the cluster.
SMALL = 200_000


def forward_graph(nbr: DataFrame) -> DataFrame:
    """Edge (i, j) if i < j and j is a neighbour of i with positive score; the other direction alone gives none."""
    return nbr.where("i < j AND score > 0").select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("score").alias("w"))


def similarity_weight(score: str = "score"):
    """max((s + 1) / 2, 1e-6)."""
    return F.greatest((F.col(score) + 1) / 2, F.lit(1e-6))


def distance_weight(d2: str, median_d2: float):
    """max(exp(-d2 / (2 median d2)), 1e-6)."""
    return F.greatest(F.exp(-F.col(d2) / (2 * median_d2)), F.lit(1e-6))


def _directed(nbr: DataFrame, metric: str) -> DataFrame:
    """(i, j, w) with the weight kernel of the metric; Euclidean distances come from unit vectors' scores."""
    if metric == "cosine":
        return nbr.select("i", "j", similarity_weight().alias("w"))
    far = nbr.select("i", "j", (2 - 2 * F.col("score")).alias("d2"))
    median = far.agg(F.percentile("d2", 0.5)).first()[0] or 1.0
    return far.select("i", "j", distance_weight("d2", median).alias("w"))


def union_graph(nbr: DataFrame, metric: str = "cosine") -> DataFrame:
    """Either direction makes an edge; the larger weight counts."""
    both = _directed(nbr, metric).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "w")
    return both.groupBy("u", "v").agg(F.max("w").alias("w"))


def mutual_graph(nbr: DataFrame, metric: str = "cosine") -> DataFrame:
    """Both directions are needed; the larger weight counts."""
    both = _directed(nbr, metric).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "w")
    return both.groupBy("u", "v").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def connectivity(nbr: DataFrame) -> DataFrame:
    """Symmetric 0/1 adjacency: both directions of each pair once."""
    return nbr.select("i", "j").union(nbr.select("j", "i")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("u", "v", "w").union(edges.select("v", "u", "w"))


def snn_pairs(nbr: DataFrame, snn_k: int | None = None) -> DataFrame:
    """(u, v, w) of mutual neighbours u < v with the Jaccard weight of their neighbour sets, cut to ``snn_k`` if given.

    Only mutual pairs are formed; the neighbour sets of both ends, of k ids at most, are joined to each and intersected,
    so what is shuffled grows with pairs times k.
    """
    near = (nbr.where(F.col("rank") <= snn_k) if snn_k else nbr).select("i", "j")
    sizes = near.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.collect_set("j").alias("set"))
    mutual = near.where("i < j").join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")
    left = sizes.select(F.col("i").alias("u"), F.col("set").alias("su"))
    right = sizes.select(F.col("i").alias("v"), F.col("set").alias("sv"))
    pairs = mutual.select(F.col("i").alias("u"), F.col("j").alias("v")).join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.select("u", "v", (shared / F.greatest(F.size("su") + F.size("sv") - shared, F.lit(1))).alias("w"))


def prune(pairs: DataFrame, method: str = "inverse_k", k: int = 1, percentile: float = 30.0) -> DataFrame:
    """Pairs of at least the threshold: 1/k, a percentile of all weights (linear), or 0 for any other method."""
    if method == "percentile":
        least = pairs.agg(F.percentile("w", percentile / 100).alias("t"))
        return pairs.crossJoin(F.broadcast(least)).where(F.col("w") >= F.col("t")).drop("t")  # one row
    return pairs.where(F.col("w") >= (1.0 / k if method == "inverse_k" else 0.0))


def rescue_edges(nbr: DataFrame, edges: DataFrame, cos: float = 0.92, floor: float = 0.02, most: int = 3) -> DataFrame:
    """For each i the first ``most`` neighbours j > i in rank order that are no edge yet and reach ``cos``; weight ``floor``."""
    free = nbr.where((F.col("i") < F.col("j")) & (F.col("score") >= cos)).join(edges.select(F.col("u").alias("i"), F.col("v").alias("j")), ["i", "j"], "left_anti")
    first = free.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("rank"))).where(F.col("r") <= most)
    return first.select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(floor).alias("w"))


def build_snn_graph(nbr: DataFrame, k: int, snn_k: int | None = None, prune_method: str = "inverse_k", percentile: float = 30.0, rescue: bool = True, cos: float = 0.92) -> DataFrame:
    """Mutual Jaccard graph, pruned, with rescue edges over all candidate ranks."""
    kept = prune(snn_pairs(nbr, snn_k), prune_method, snn_k or k, percentile)
    return kept.union(rescue_edges(nbr, kept, cos)) if rescue else kept


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, nodes without edges included."""
    parts = connected_components(edges.select(F.col("u").cast("long"), F.col("v").cast("long")), small=SMALL)
    return nodes.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, mean_degree, n_components, giant_pct."""
    parts = node_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    shape = parts.agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.max("n").alias("giant"))
    counted = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return shape.crossJoin(counted).select("n_nodes", "n_edges", (2 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree"), "n_components", (100 * F.col("giant") / F.col("n_nodes")).alias("giant_pct"))


def health_warnings(stats: dict, pruned_share: float = 0.0, min_giant: float = 95.0) -> list[str]:
    """What looks wrong with a graph, from its stats row; nothing is refused."""
    out = []
    if pruned_share > 0.4:
        out.append(f"{'most' if pruned_share > 0.6 else 'many'} edges were pruned: {pruned_share:.0%}")
    if not stats["n_edges"]:
        out.append("the graph has no edges")
    elif not 5 <= stats["mean_degree"] <= 200:
        out.append(f"mean degree {stats['mean_degree']:.1f} is outside 5 to 200")
    if stats["giant_pct"] < min_giant:
        out.append(f"the largest component holds {stats['giant_pct']:.1f} % of nodes, under {min_giant} %")
    return out
