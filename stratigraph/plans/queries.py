"""Named queries over the tables of a folder, and the same in SQL where SQL can express it.

Vectors come from ``embeddings`` (truth: label, species: vec_id mod 3), sequences from ``documents``, tree and pair
families from ``nation``. Partitions that are only evaluated are fixed expressions of the ids, so that both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratigraph.functions.providers import embed
from stratigraph.functions.vector import norm
from stratigraph.operators import baselines, density, distances, evaluation, graph, leiden, levels, merge, sequences, trees, vectors
from stratigraph.operators.neighbors import adaptive_k, cell_neighbors, descent_neighbors, top_neighbors
from stratigraph.plans import experiments, multiscale
from stratigraph.sources import fasta
from stratigraph.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: k of the neighbour queries follows the adaptive rule with these.
COEFF, CAP = 0.6, 150
#: Cosines of rescue edges and of component edges: the tables' vectors are random, so the defaults would find none.
RESCUE, LINKED = 0.30, 0.40


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def emb(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def units(spark: SparkSession, d: str) -> DataFrame:
    return vectors.l2_normalize(emb(spark, d))


def near(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    rows = units(spark, d)
    k = adaptive_k(rows.count(), COEFF, CAP)
    return materialize(top_neighbors(rows, k), "nbr"), k


def parted(spark: SparkSession, d: str) -> DataFrame:
    """Four levels of 6, 20, 90 and 250 clusters by id, some ids unassigned."""
    grid = spark.createDataFrame([(0, 6), (1, 20), (2, 90), (3, 250)], "level int, m int")
    ids = emb(spark, d).select("id").crossJoin(F.broadcast(grid))  # four rows
    return ids.select("level", "id", F.when((F.col("id") + F.col("level")) % 13 == 0, -1).otherwise(F.col("id") % F.col("m")).cast("long").alias("cluster"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    pred = F.when(F.col("id") % 11 == 0, -1).otherwise((F.col("id") * 7 + F.col("label")) % 23)
    return emb(spark, d).select("id", F.col("label").alias("true"), (F.col("id") % 3).alias("species"), pred.cast("long").alias("pred"))


E = "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
N = E + ", n AS (SELECT id, label, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS x FROM e)"
K = N + ", kk AS (SELECT CAST(least(ceil(0.6 * sqrt(count(*))), 150) AS BIGINT) AS k FROM e)"
NBR = K + """, scored AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.x, b.x) AS score FROM n a JOIN n b ON a.id <> b.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM scored),
    nbr AS (SELECT i, rank, j, score FROM ranked WHERE rank <= (SELECT k FROM kk))"""
FORWARD = NBR + ", edge AS (SELECT i AS u, j AS v, score AS w FROM nbr WHERE i < j AND score > 0)"
SETS = NBR + """, sets AS (SELECT i, list(j) AS s FROM nbr GROUP BY i),
    mutual AS (SELECT a.i AS u, a.j AS v FROM nbr a JOIN nbr b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j),
    pairs AS (SELECT u, v, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE AS w
        FROM mutual JOIN sets x ON x.i = u JOIN sets y ON y.i = v)"""
PART = "part AS (SELECT l AS level, id, CAST(CASE WHEN (id + l) % 13 = 0 THEN -1 ELSE id % m END AS BIGINT) AS cluster FROM e, (VALUES (0, 6), (1, 20), (2, 90), (3, 250)) t(l, m))"
JUDGED = E + ", j AS (SELECT id, label AS true_g, id % 3 AS species, CAST(CASE WHEN id % 11 = 0 THEN -1 ELSE (id * 7 + label) % 23 END AS BIGINT) AS pred FROM e)"
PAIRS_OF = "(n * (n - 1) // 2)"


@query("embedding_l2_normalize", f"WITH {N} SELECT id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS pos, round(unnest(x), 6) AS value FROM n")
def embedding_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("id", F.posexplode("x").alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query(
    "standardize_columns",
    f"WITH {E}, c AS (SELECT id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM e), "
    "m AS (SELECT pos, avg(value) AS mean, stddev_pop(value) AS dev FROM c GROUP BY pos) "
    "SELECT id, CAST(pos AS BIGINT) AS pos, round((value - mean) / dev, 6) AS value FROM c JOIN m USING (pos)",
)
def standardize_columns(spark: SparkSession, d: str) -> DataFrame:
    return vectors.standardize(emb(spark, d)).select("id", F.posexplode("x").alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("pca_cosine_invariant")
def pca_cosine_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Norms of PCA scores, which do not depend on the signs of components."""
    return vectors.prepare_embeddings(emb(spark, d), pca_dim=16).select("id", r6(norm("x_pca")).alias("norm_pca"), r6(norm("x")).alias("norm"))


@query("adaptive_k", "SELECT count(*) AS n, CAST(least(ceil(0.6 * sqrt(count(*))), 150) AS BIGINT) AS k FROM embeddings")
def adaptive_k_query(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return emb(spark, d).agg(n.alias("n"), F.least(F.ceil(COEFF * F.sqrt(n)), F.lit(CAP)).cast("long").alias("k"))


@query("knn_topk_cosine", f"WITH {NBR} SELECT i, rank, j, round(score, 6) AS score FROM nbr")
def knn_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d)[0].select("i", F.col("rank").cast("long").alias("rank"), "j", r6("score").alias("score"))


@query("knn_graph_forward", f"WITH {FORWARD} SELECT u, v, round(w, 6) AS w FROM edge")
def knn_graph_forward(spark: SparkSession, d: str) -> DataFrame:
    return graph.forward_graph(near(spark, d)[0]).select("u", "v", r6("w").alias("w"))


@query("knn_graph_union_weighted", f"WITH {NBR} SELECT least(i, j) AS u, greatest(i, j) AS v, round(max(greatest((score + 1) / 2, 1e-6)), 6) AS w FROM nbr GROUP BY 1, 2")
def knn_graph_union_weighted(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_graph(near(spark, d)[0]).select("u", "v", r6("w").alias("w"))


@query("knn_graph_mutual", f"WITH {NBR} SELECT least(i, j) AS u, greatest(i, j) AS v, round(max(greatest((score + 1) / 2, 1e-6)), 6) AS w FROM nbr GROUP BY 1, 2 HAVING count(*) = 2")
def knn_graph_mutual(spark: SparkSession, d: str) -> DataFrame:
    return graph.mutual_graph(near(spark, d)[0]).select("u", "v", r6("w").alias("w"))


@query(
    "knn_graph_euclidean",
    f"WITH {NBR}, far AS (SELECT i, j, 2 - 2 * score AS d2 FROM nbr), m AS (SELECT quantile_cont(d2, 0.5) AS med FROM far) "
    "SELECT least(i, j) AS u, greatest(i, j) AS v, round(max(greatest(exp(-d2 / (2 * med)), 1e-6)), 6) AS w FROM far, m GROUP BY 1, 2",
)
def knn_graph_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_graph(near(spark, d)[0], "euclidean").select("u", "v", r6("w").alias("w"))


@query("snn_jaccard_inverse_k", f"WITH {SETS} SELECT u, v, round(w, 6) AS w FROM pairs WHERE w >= 1.0 / (SELECT k FROM kk)")
def snn_jaccard_inverse_k(spark: SparkSession, d: str) -> DataFrame:
    nbr, k = near(spark, d)
    return graph.prune(graph.snn_pairs(nbr), "inverse_k", k).select("u", "v", r6("w").alias("w"))


@query("snn_jaccard_percentile", f"WITH {SETS} SELECT u, v, round(w, 6) AS w FROM pairs WHERE w >= (SELECT quantile_cont(w, 0.7) FROM pairs)")
def snn_jaccard_percentile(spark: SparkSession, d: str) -> DataFrame:
    pairs = materialize(graph.snn_pairs(near(spark, d)[0]), "snn")
    return graph.prune(pairs, "percentile", percentile=70).select("u", "v", r6("w").alias("w"))


@query(
    "rescue_edges_top3",
    f"WITH {SETS}, kept AS (SELECT u, v FROM pairs WHERE w >= 1.0 / (SELECT k FROM kk)), "
    f"free AS (SELECT n.i, n.j, n.rank, row_number() OVER (PARTITION BY n.i ORDER BY n.rank) AS r FROM nbr n ANTI JOIN kept k ON k.u = n.i AND k.v = n.j WHERE n.i < n.j AND n.score >= {RESCUE}) "
    "SELECT i AS u, j AS v, 0.02::DOUBLE AS w FROM free WHERE r <= 3",
)
def rescue_edges_top3(spark: SparkSession, d: str) -> DataFrame:
    nbr, k = near(spark, d)
    return graph.rescue_edges(nbr, graph.prune(graph.snn_pairs(nbr), "inverse_k", k), RESCUE)


COMPONENTS = FORWARD + f""", link AS (SELECT u, v FROM edge WHERE w >= {LINKED}), sides AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
    reach AS (SELECT id, id AS root FROM e UNION SELECT b.v, r.root FROM reach r JOIN sides b ON b.u = r.id),
    comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


def linked(spark: SparkSession, d: str) -> DataFrame:
    return graph.forward_graph(near(spark, d)[0]).where(F.col("w") >= LINKED)


@query("connected_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comp")
def connected_components_query(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_components(emb(spark, d), linked(spark, d))


@query(
    "graph_stats",
    f"WITH RECURSIVE {COMPONENTS}, sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) "
    "SELECT CAST(sum(n) AS BIGINT) AS n_nodes, (SELECT count(*) FROM link) AS n_edges, round(2 * (SELECT count(*) FROM link) / sum(n), 6) AS mean_degree, count(*) AS n_components, round(100 * max(n) / sum(n), 6) AS giant_pct FROM sizes",
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    s = graph.graph_stats(emb(spark, d), materialize(linked(spark, d), "edges"))
    return s.select("n_nodes", "n_edges", r6("mean_degree").alias("mean_degree"), "n_components", r6("giant_pct").alias("giant_pct"))


@query("symmetric_adjacency", f"WITH {FORWARD} SELECT u, v, round(w, 6) AS w FROM edge UNION ALL SELECT v, u, round(w, 6) FROM edge")
def symmetric_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(graph.forward_graph(near(spark, d)[0])).select("u", "v", r6("w").alias("w"))


@query("knn_connectivity", f"WITH {NBR} SELECT i, j FROM nbr UNION SELECT j, i FROM nbr")
def knn_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return graph.connectivity(near(spark, d)[0])


@query(
    "relabel_contiguous",
    f"WITH {E}, {PART} SELECT CAST(level AS BIGINT) AS level, id, CASE WHEN cluster < 0 THEN cluster ELSE dense_rank() OVER (PARTITION BY level, cluster >= 0 ORDER BY cluster) - 1 END AS cluster "
    "FROM (SELECT level, id, CASE WHEN cluster < 0 THEN cluster ELSE cluster * 5 + 2 END AS cluster FROM part)",
)
def relabel_contiguous(spark: SparkSession, d: str) -> DataFrame:
    wide = parted(spark, d).withColumn("cluster", F.when(F.col("cluster") < 0, F.col("cluster")).otherwise(F.col("cluster") * 5 + 2))
    return levels.relabel_contiguous(wide, ["level"]).select(F.col("level").cast("long").alias("level"), "id", F.col("cluster").cast("long").alias("cluster"))


@query(
    "hierarchy_argmax_overlap",
    f"WITH {E}, {PART}, p AS (SELECT * FROM part WHERE cluster >= 0), "
    "s AS (SELECT f.level, f.cluster, c.cluster AS parent_cluster, count(*) AS n, min(f.id) AS first FROM p f JOIN p c ON c.level = f.level - 1 AND c.id = f.id GROUP BY 1, 2, 3), "
    "z AS (SELECT level, cluster, count(*) AS size FROM p GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY level, cluster ORDER BY n DESC, first) AS r FROM s) "
    "SELECT CAST(level AS BIGINT) AS level, cluster, parent_cluster, round(n / size::DOUBLE, 6) AS overlap FROM r JOIN z USING (level, cluster) WHERE r = 1",
)
def hierarchy_argmax_overlap(spark: SparkSession, d: str) -> DataFrame:
    return levels.build_hierarchy(parted(spark, d)).select(F.col("level").cast("long").alias("level"), "cluster", "parent_cluster", r6("overlap").alias("overlap"))


@query(
    "cpm_quality",
    f"WITH {FORWARD}, {PART}, p AS (SELECT * FROM part WHERE cluster >= 0), "
    "w AS (SELECT a.level, sum(w) AS w FROM edge JOIN p a ON a.id = u JOIN p b ON b.id = v AND b.level = a.level AND b.cluster = a.cluster GROUP BY 1), "
    "q AS (SELECT level, sum(n * (n - 1) / 2) AS pairs FROM (SELECT level, cluster, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1) "
    "SELECT CAST(q.level AS BIGINT) AS level, round(coalesce(w, 0) - 0.05 * pairs, 6) AS quality FROM q LEFT JOIN w USING (level)",
)
def cpm_quality(spark: SparkSession, d: str) -> DataFrame:
    return levels.cpm_quality(parted(spark, d), graph.forward_graph(near(spark, d)[0]), 0.05).select(F.col("level").cast("long").alias("level"), r6("quality").alias("quality"))


SHAPES = PART + """, sizes AS (SELECT level, cluster, count(*) AS n FROM part GROUP BY 1, 2),
    shapes AS (SELECT level, CAST(sum(n) AS BIGINT) AS n_items, count(*) FILTER (cluster >= 0) AS n_clusters, CAST(coalesce(sum(n) FILTER (cluster < 0), 0) AS BIGINT) AS n_unassigned, count(*) FILTER (cluster >= 0 AND n = 1) AS n_size1 FROM sizes GROUP BY 1),
    feasible AS (SELECT *, NOT (n_clusters < 2 OR n_items / n_clusters < 1.3 OR n_unassigned / n_items > 0.5 OR n_clusters > 0.8 * n_items) AS feasible FROM shapes)"""


@query("level_feasibility", f"WITH {E}, {SHAPES} SELECT CAST(level AS BIGINT) AS level, n_items, n_clusters, n_unassigned, n_size1, feasible FROM feasible")
def level_feasibility(spark: SparkSession, d: str) -> DataFrame:
    shapes = levels.level_shapes(parted(spark, d))
    return shapes.select(F.col("level").cast("long").alias("level"), "n_items", "n_clusters", "n_unassigned", "n_size1", levels.is_feasible(F.col("n_clusters"), F.col("n_unassigned"), F.col("n_items")).alias("feasible"))


NMI = """both_p AS (SELECT f.level, f.cluster AS a, c.cluster AS b FROM part f JOIN part c ON c.level = f.level - 1 AND c.id = f.id WHERE f.cluster >= 0 AND c.cluster >= 0),
    cell AS (SELECT level, a, b, count(*)::DOUBLE AS n FROM both_p GROUP BY 1, 2, 3),
    marg AS (SELECT *, sum(n) OVER (PARTITION BY level, a) AS na, sum(n) OVER (PARTITION BY level, b) AS nb, sum(n) OVER (PARTITION BY level) AS t FROM cell),
    info AS (SELECT level, sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM marg GROUP BY 1),
    nmi AS (SELECT l.level, CASE WHEN l.level = 0 THEN 1.0 ELSE coalesce(mi / ((ha + hb) / 2), 0) END AS nmi FROM (SELECT DISTINCT level FROM part) l LEFT JOIN info USING (level))"""


@query("nmi_adjacent_levels", f"WITH {E}, {PART}, {NMI} SELECT CAST(level AS BIGINT) AS level, round(nmi, 6) AS nmi FROM nmi")
def nmi_adjacent_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.adjacent_nmi(parted(spark, d)).select(F.col("level").cast("long").alias("level"), r6("nmi").alias("nmi"))


PROFILE = """deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1),
    vol AS (SELECT level, cluster, count(*) AS size, coalesce(sum(degree), 0)::DOUBLE AS volume FROM part LEFT JOIN deg USING (id) WHERE cluster >= 0 GROUP BY 1, 2),
    internal AS (SELECT a.level, a.cluster, count(*) AS internal FROM edge JOIN part a ON a.id = u JOIN part b ON b.id = v AND b.level = a.level AND b.cluster = a.cluster WHERE a.cluster >= 0 GROUP BY 1, 2),
    profile AS (SELECT vol.*, coalesce(internal, 0)::DOUBLE AS internal FROM vol LEFT JOIN internal USING (level, cluster)),
    coh AS (SELECT level, sum(CASE WHEN size > 1 THEN 2 * internal / (size * (size - 1)) ELSE 0 END * size) / sum(size) AS cohesion FROM profile GROUP BY 1),
    cut AS (SELECT level, size, volume - 2 * internal AS cut, least(volume, 2 * (SELECT count(*) FROM edge) - volume) AS low FROM profile),
    cond AS (SELECT level, least(greatest(sum(CASE WHEN low > 0 THEN cut / low ELSE 0 END * size) / sum(size), 0), 1) AS conductance FROM cut GROUP BY 1)"""


@query("cluster_cohesion", f"WITH {FORWARD}, {PART}, {PROFILE} SELECT CAST(level AS BIGINT) AS level, round(cohesion, 6) AS cohesion FROM coh")
def cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    profile = levels.edge_profile(parted(spark, d), graph.forward_graph(near(spark, d)[0]))
    return levels.cohesion(profile).select(F.col("level").cast("long").alias("level"), r6("cohesion").alias("cohesion"))


@query("mean_conductance", f"WITH {FORWARD}, {PART}, {PROFILE} SELECT CAST(level AS BIGINT) AS level, round(conductance, 6) AS conductance, round(1 - conductance, 6) AS separation FROM cond")
def mean_conductance(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(graph.forward_graph(near(spark, d)[0]), "edges")
    got = levels.separation(levels.edge_profile(parted(spark, d), edges), edges.count())
    return got.select(F.col("level").cast("long").alias("level"), r6("conductance").alias("conductance"), r6("separation").alias("separation"))


SCORES = f"""{FORWARD}, {SHAPES}, {NMI}, {PROFILE}, raw AS (
        SELECT f.*, nmi, cohesion, CASE WHEN feasible THEN 1 - conductance ELSE 0 END AS separation, 1.0 AS consensus, greatest(n_items / 3.0, 10) AS target
        FROM feasible f JOIN nmi USING (level) JOIN coh USING (level) JOIN cond USING (level)),
    terms AS (SELECT *, least(n_items / n_clusters / (n_items / target), 1.0) AS size_reg, greatest(0, (n_unassigned + n_size1) / n_items - 0.10) AS fragmentation,
        CASE WHEN feasible THEN exp(-0.5 * ((n_clusters - target) / (0.3 * target + 1e-6)) ** 2) ELSE 0 END AS target_prior FROM raw),
    scores AS (SELECT *, CASE WHEN feasible THEN 0.18 * nmi + 0.18 * cohesion + 0.18 * separation + 0.12 * size_reg + 0.10 * consensus + 0.10 * target_prior - 0.14 * fragmentation ELSE -1 END AS composite FROM terms)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    part, edges = parted(spark, d), materialize(graph.forward_graph(near(spark, d)[0]), "edges")
    profile = materialize(levels.edge_profile(part, edges), "profile")
    parts = levels.adjacent_nmi(part).join(levels.cohesion(profile), "level").join(levels.separation(profile, edges.count()), "level").withColumn("consensus", F.lit(1.0))
    return levels.composite_scores(levels.level_shapes(part), parts)


@query(
    "target_prior_composite",
    f"WITH {SCORES} SELECT CAST(level AS BIGINT) AS level, round(size_reg, 6) AS size_reg, round(fragmentation, 6) AS fragmentation, round(target_prior, 6) AS target_prior, round(composite, 6) AS composite FROM scores",
)
def target_prior_composite(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.col("level").cast("long").alias("level"), *[r6(c).alias(c) for c in ("size_reg", "fragmentation", "target_prior", "composite")])


@query(
    "plateau_bonus",
    f"WITH {E}, {SHAPES}, s AS (SELECT level, ln(1 + n_clusters) AS y, count(*) OVER () AS c FROM feasible WHERE feasible), "
    "g AS (SELECT level, c, abs(y - lag(y) OVER (ORDER BY level)) AS b, abs(lead(y) OVER (ORDER BY level) - y) AS a FROM s), "
    "m AS (SELECT CASE WHEN median(a) > 0 THEN 0.5 * median(a) ELSE 0.1 END AS t FROM g) "
    "SELECT CAST(level AS BIGINT) AS level, (CAST(coalesce(b < t, true) AS INT) + CAST(coalesce(a < t, true) AS INT)) * 0.05::DOUBLE AS plateau_bonus FROM g, m WHERE c >= 3",
)
def plateau_bonus(spark: SparkSession, d: str) -> DataFrame:
    shapes = levels.level_shapes(parted(spark, d))
    marked = shapes.withColumn("feasible", levels.is_feasible(F.col("n_clusters"), F.col("n_unassigned"), F.col("n_items")))
    return levels.plateau_bonus(marked).select(F.col("level").cast("long").alias("level"), "plateau_bonus")


BAND = " + ".join(f"CAST(n_clusters >= n_items * {b!r} AS BIGINT)" for b in levels.BANDS)


@query(
    "band_best_level",
    f"WITH {SCORES}, b AS (SELECT level, composite, {BAND} AS band FROM scores WHERE feasible), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY composite DESC, level) AS r FROM b WHERE band < 6) "
    "SELECT band, CAST(level AS BIGINT) AS level FROM r WHERE r = 1",
)
def band_best_level(spark: SparkSession, d: str) -> DataFrame:
    return levels.band_best(scored(spark, d)).select(F.col("band").cast("long").alias("band"), F.col("level").cast("long").alias("level"))


@query(
    "cluster_centroids",
    f"WITH {JUDGED}, c AS (SELECT pred, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM e JOIN j USING (id) WHERE pred >= 0) "
    "SELECT pred, CAST(pos AS BIGINT) AS pos, count(*) AS n, round(avg(value), 6) AS value FROM c GROUP BY 1, 2",
)
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = emb(spark, d).join(judged(spark, d).select("id", "pred"), "id")
    return vectors.centroids(rows, "pred").select("pred", "n", F.posexplode("centroid").alias("pos", "value")).select("pred", F.col("pos").cast("long").alias("pos"), "n", r6("value").alias("value"))


CROSS = "cross_e AS (SELECT least(a.pred, b.pred) AS ca, greatest(a.pred, b.pred) AS cb, count(*) AS n_edges FROM edge JOIN j a ON a.id = u JOIN j b ON b.id = v WHERE a.pred >= 0 AND b.pred >= 0 AND a.pred <> b.pred GROUP BY 1, 2)"
JUDGED_ONLY = JUDGED.removeprefix(E + ", ")


@query("cross_cluster_edges", f"WITH {FORWARD}, {JUDGED_ONLY}, {CROSS} SELECT * FROM cross_e")
def cross_cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    return merge.cross_edges(judged(spark, d).withColumnRenamed("pred", "cluster"), graph.forward_graph(near(spark, d)[0]))


@query(
    "merge_pair_scores",
    f"WITH {FORWARD}, {JUDGED_ONLY}, {CROSS}, "
    "tot AS (SELECT pred, pos, sum(value) AS s FROM (SELECT pred, generate_subscripts(v, 1) AS pos, unnest(v) AS value FROM e JOIN j USING (id) WHERE pred >= 0) GROUP BY 1, 2), "
    "st AS (SELECT pred, list(s ORDER BY pos) AS total FROM tot GROUP BY 1), sz AS (SELECT pred, count(*) AS n FROM j WHERE pred >= 0 GROUP BY 1), "
    "cl AS (SELECT pred, n, list_transform(total, lambda x: x / n) AS c FROM st JOIN sz USING (pred)), lim AS (SELECT greatest(2 * median(n), 10) AS big FROM sz), "
    "m AS (SELECT ca, cb, a.n AS na, b.n AS nb, n_edges / (least(a.n, b.n) * (SELECT k FROM kk))::DOUBLE AS conn, "
    "list_inner_product(a.c, b.c) / (sqrt(list_inner_product(a.c, a.c)) * sqrt(list_inner_product(b.c, b.c)) + 1e-12) AS cos FROM cross_e JOIN cl a ON a.pred = ca JOIN cl b ON b.pred = cb), "
    "x AS (SELECT *, CASE WHEN conn >= CASE WHEN na + nb > big THEN 0.09 ELSE 0.06 END THEN 'branch_local' WHEN cos >= CASE WHEN na + nb > big THEN 0.15 ELSE 0.1 END AND conn >= CASE WHEN na + nb > big THEN 0.045 ELSE 0.03 END THEN 'branch_local' "
    "WHEN cos >= 0.2 AND greatest(na, nb) <= 20 THEN 'homology_rescue' WHEN cos >= 0.2 AND (greatest(na, nb) / least(na, nb) <= 3 OR greatest(na, nb) <= 10) THEN 'size_rescue' END AS merge_source FROM m, lim) "
    "SELECT ca, cb, round(cos, 6) AS cos_sim, round(conn, 6) AS edge_conn, merge_source, round(CASE WHEN merge_source IS NULL THEN 0 WHEN merge_source = 'branch_local' THEN 0.7 * conn + 0.3 * cos ELSE 1 + cos END, 6) AS score FROM x",
)
def merge_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    nbr, k = near(spark, d)
    part = judged(spark, d).select("id", F.col("pred").alias("cluster"))
    states = materialize(merge.cluster_states(part, emb(spark, d).select("id", "x")), "states")
    rule = merge.MergeRule(cos=0.1, edge=0.03, strong=0.06, k=k, large=merge.large_size(states), rescue=True, rescue_cos=0.2, final=True)
    side = lambda c, n, t: states.select(F.col("cluster").alias(c), F.col("n").alias(n), F.col("total").alias(t))
    pairs = merge.cross_edges(part, graph.forward_graph(nbr)).join(side("ca", "na", "ta"), "ca").join(side("cb", "nb", "tb"), "cb")
    return merge.score_pairs(pairs, rule).select("ca", "cb", r6("cos_sim").alias("cos_sim"), r6("edge_conn").alias("edge_conn"), "merge_source", r6("score").alias("score"))


@query("ground_truth_stats", f"WITH {JUDGED}, g AS (SELECT true_g, count(*) AS n FROM j GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_groups, CAST(sum{PAIRS_OF} AS BIGINT) AS n_pairs FROM g")
def ground_truth_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ground_truth_stats(judged(spark, d))


def confusion_sql(source: str, by: str = "") -> str:
    keys, group, join = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    return f"""cell_c AS (SELECT {keys}pred, true_g, count(*) AS n FROM {source} GROUP BY {keys}pred, true_g),
        tp AS (SELECT {keys}CAST(coalesce(sum{PAIRS_OF} FILTER (pred >= 0), 0) AS BIGINT) AS tp, CAST(sum(n) AS BIGINT) AS items FROM cell_c {group}),
        pp AS (SELECT {keys}CAST(coalesce(sum{PAIRS_OF}, 0) AS BIGINT) AS p FROM (SELECT {keys}pred, CAST(sum(n) AS BIGINT) AS n FROM cell_c WHERE pred >= 0 GROUP BY {keys}pred) {group}),
        tt AS (SELECT {keys}CAST(sum{PAIRS_OF} AS BIGINT) AS t FROM (SELECT {keys}true_g, CAST(sum(n) AS BIGINT) AS n FROM cell_c GROUP BY {keys}true_g) {group}),
        conf AS (SELECT {keys}tp, p - tp AS fp, t - tp AS fn, items * (items - 1) // 2 - p - t + tp AS tn, coalesce(tp / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(t, 0), 0)::DOUBLE AS recall FROM tp JOIN pp {join} JOIN tt {join})"""


CONF_OUT = "tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1"


def rounded_confusion(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("pairwise_confusion", f"WITH {JUDGED}, {confusion_sql('j')} SELECT {CONF_OUT} FROM conf")
def pairwise_confusion_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded_confusion(evaluation.pairwise_confusion(judged(spark, d)))


@query(
    "orthogroup_type_metrics",
    f"WITH {JUDGED.replace('label AS true_g', 'id % 171 AS true_g')}, sp AS (SELECT true_g, species, count(*) AS c FROM j GROUP BY 1, 2), "
    "ty AS (SELECT true_g, CASE WHEN bool_and(c = 1) THEN '1:1' WHEN bool_and(c > 1) THEN 'n:m' ELSE '1:m' END AS type FROM sp GROUP BY 1), "
    f"jt AS (SELECT j.*, type FROM j JOIN ty USING (true_g)), gs AS (SELECT type, count(DISTINCT true_g) AS n_groups, count(*) AS n_items FROM jt GROUP BY 1), {confusion_sql('jt', 'type')} SELECT type, n_groups, n_items, {CONF_OUT} FROM conf JOIN gs USING (type)",
)
def orthogroup_type_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).withColumn("true", F.col("id") % 171)
    return rounded_confusion(evaluation.type_metrics(rows), "type", "n_groups", "n_items")


INFO = """cell_v AS (SELECT pred, true_g, count(*)::DOUBLE AS n FROM j GROUP BY 1, 2),
    marg_v AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS na, sum(n) OVER (PARTITION BY true_g) AS nb, sum(n) OVER () AS t FROM cell_v),
    info_v AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM marg_v)"""


@query("homogeneity_completeness_v", f"WITH {JUDGED}, {INFO} SELECT round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness, round(2 * mi / hb * mi / ha / (mi / hb + mi / ha), 6) AS v_measure FROM info_v")
def homogeneity_completeness_v(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.v_measure(judged(spark, d)).select(*[r6(c).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


@query(
    "adjusted_mutual_info",
    f"WITH {JUDGED}, {INFO}, tot AS (SELECT count(*) AS nn FROM j), "
    "sa AS (SELECT a, count(*) AS ma FROM (SELECT count(*) AS a FROM j GROUP BY pred) GROUP BY 1), sb AS (SELECT b, count(*) AS mb FROM (SELECT count(*) AS b FROM j GROUP BY true_g) GROUP BY 1), "
    "ks AS (SELECT a, ma, b, mb, nn, unnest(generate_series(greatest(1, a + b - nn), least(a, b))) AS k FROM sa, sb, tot), "
    "em AS (SELECT sum(ma * mb * k / nn::DOUBLE * ln(nn * k / (a * b)::DOUBLE) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(nn - a + 1) + lgamma(nn - b + 1) - lgamma(nn + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(nn - a - b + k + 1))) AS e FROM ks) "
    "SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM info_v, em",
)
def adjusted_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.adjusted_mutual_info(judged(spark, d)).select(r6("ami").alias("ami"))


@query(
    "purity_entropy",
    f"WITH {JUDGED}, c AS (SELECT pred, true_g, count(*)::DOUBLE AS n FROM j GROUP BY 1, 2), p AS (SELECT pred, n / sum(n) OVER (PARTITION BY pred) AS p FROM c), "
    "q AS (SELECT pred, max(p) AS purity, -sum(p * log2(p)) AS entropy FROM p GROUP BY 1) SELECT round(avg(purity), 6) AS purity, round(avg(entropy), 6) AS entropy FROM q",
)
def purity_entropy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.purity_entropy(judged(spark, d)).select(r6("purity").alias("purity"), r6("entropy").alias("entropy"))


@query("size1_clusters", f"WITH {E}, {SHAPES} SELECT CAST(level AS BIGINT) AS level, n_clusters, n_unassigned, n_size1 FROM shapes")
def size1_clusters(spark: SparkSession, d: str) -> DataFrame:
    part = parted(spark, d)
    out = None
    for level in range(4):
        row = evaluation.cluster_counts(part.where(F.col("level") == level), "cluster").select(F.lit(level).cast("long").alias("level"), "n_clusters", "n_unassigned", "n_size1")
        out = row if out is None else out.union(row)
    return out


@query(
    "evaluate_clustering",
    f"WITH {JUDGED}, {confusion_sql('j')}, {INFO}, c AS (SELECT count(DISTINCT pred) FILTER (pred >= 0) AS n_clusters, count(*) FILTER (pred < 0) AS n_unassigned FROM j) "
    f"SELECT {CONF_OUT}, round(2 * mi / hb * mi / ha / (mi / hb + mi / ha), 6) AS v_measure, n_clusters, n_unassigned FROM conf, info_v, c",
)
def evaluate_clustering(spark: SparkSession, d: str) -> DataFrame:
    wide = evaluation.evaluate_clustering(judged(spark, d))
    return rounded_confusion(wide, *[r6("v_measure").alias("v_measure")], "n_clusters", "n_unassigned")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", "lang", "n_chars", F.regexp_replace("text", r"[^A-Za-z.*\-]", "").alias("s"), "text")


SEQ = "q AS (SELECT doc_id, lang, n_chars, regexp_replace(text, '[^A-Za-z.*-]', '', 'g') AS s, text FROM documents)"


@query(
    "residue_composition",
    "WITH " + SEQ + ", u AS (SELECT doc_id, upper(s) AS s FROM q), l AS (SELECT doc_id, s, unnest(list_append(string_split('ACDEFGHIKLMNPQRSTVWY', ''), 'X')) AS residue FROM u) "
    "SELECT doc_id, residue, CASE WHEN length(s) = 0 THEN NULL WHEN residue = 'X' THEN round(length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / length(s), 6) ELSE round((length(s) - length(replace(s, residue, ''))) / length(s), 6) END AS share FROM l",
)
def residue_composition(spark: SparkSession, d: str) -> DataFrame:
    rows = seqs(spark, d).select("doc_id", F.posexplode(sequences.composition(F.upper("s"))).alias("pos", "share"))
    letter = F.substr(F.lit(sequences.RESIDUES), F.col("pos") + 1, F.lit(1))
    return rows.select("doc_id", letter.alias("residue"), F.when(~F.isnan("share"), r6("share")).alias("share"))


@query(
    "sequence_cleanup",
    "WITH " + SEQ + " SELECT doc_id, sha256(replace(s, '.', '-')) AS stdgap, sha256(replace(upper(s), 'X', '-')) AS gapped, CAST(regexp_full_match(upper(s), '[.RHKDESTNQCGPAVILMFYW-]*') AS BIGINT) AS in_alphabet, "
    "sha256(replace(s, '.', '')) AS nogap, sha256(regexp_replace(s, '[a-z.*]', '', 'g')) AS match_columns, length(translate(s, 'UZO', 'XXX')) AS n_symbols, length(s[1:1022]) AS n_kept FROM q",
)
def sequence_cleanup(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    cut = F.char_length(sequences.truncate(s)).cast("long")
    spaced = F.char_length(F.replace(sequences.model_ready(s), F.lit(" "), F.lit(""))).cast("long")
    return seqs(spark, d).select("doc_id", F.sha2(sequences.std_gaps(s), 256).alias("stdgap"), F.sha2(sequences.x_to_gaps(s), 256).alias("gapped"), sequences.is_alphabet(s).cast("long").alias("in_alphabet"), F.sha2(sequences.remove_gaps(s), 256).alias("nogap"), F.sha2(sequences.remove_insertions(s), 256).alias("match_columns"), spaced.alias("n_symbols"), cut.alias("n_kept"))


@query(
    "family_length_filter",
    "WITH " + SEQ + ", m AS (SELECT lang, n_chars % 40 AS f, max(length(s)) AS longest, count(*) AS n FROM q GROUP BY 1, 2) SELECT lang, f, n, longest FROM m WHERE longest <= 2048",
)
def family_length_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = seqs(spark, d).withColumn("f", F.col("n_chars") % 40).withColumn("family", F.concat_ws(":", "lang", "f"))
    kept = sequences.within_length(rows, "family", "s", 2048)
    return kept.groupBy("lang", "f").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("s")).cast("long").alias("longest"))


@query("msa_stats", "WITH " + SEQ + " SELECT lang, count(*) AS n_sequences, max_by(length(s), doc_id) AS last_length, max(length(s)) AS longest FROM q GROUP BY lang")
def msa_stats(spark: SparkSession, d: str) -> DataFrame:
    got = sequences.msa_stats(seqs(spark, d), "lang", "doc_id", "s")
    return got.select("lang", "n_sequences", F.col("last_length").cast("long").alias("last_length"), F.col("longest").cast("long").alias("longest"))


@query(
    "consensus_by_column",
    "WITH " + SEQ + ", c AS (SELECT n_chars AS family, doc_id, unnest(string_split(replace(text, '.', '-'), '')) AS ch, generate_subscripts(string_split(replace(text, '.', '-'), ''), 1) AS pos FROM q WHERE text <> ''), "
    "k AS (SELECT family, pos, ch, count(*) AS n, min(doc_id) AS first FROM c GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY family, pos ORDER BY CAST(ch = '-' AS INT), n DESC, first) AS r FROM k) "
    "SELECT family, sha256(string_agg(ch, '' ORDER BY pos)) AS consensus FROM r WHERE r = 1 GROUP BY family",
)
def consensus_by_column(spark: SparkSession, d: str) -> DataFrame:
    rows = seqs(spark, d).where("text <> ''").select(F.col("n_chars").alias("family"), "doc_id", sequences.std_gaps("text").alias("s"))
    return sequences.consensus(rows, "family", "doc_id", "s").select("family", F.sha2("consensus", 256).alias("consensus"))


@query(
    "load_proteins",
    "SELECT l.doc_id AS id, 'sp' || l.doc_id % 3 || '|a|b|c|' || lang || '|d' || l.doc_id || ' tail' AS header, 'sp' || l.doc_id % 3 AS species, lang AS true_label, round(2 * CAST(embedding[1] AS DOUBLE), 6) AS x_first "
    "FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = l.doc_id",
)
def load_proteins(spark: SparkSession, d: str) -> DataFrame:
    """Records of ``documents`` by header, an index map made of ``labels``, embeddings of two layers, the second double."""
    label = F.concat(F.lit("sp"), (F.col("doc_id") % 3).cast("string"), F.lit("|a|b|c|"), "lang", F.lit("|d"), F.col("doc_id").cast("string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    records = docs.select(F.concat(label, F.lit(" tail")).alias("header"), F.lit("ACD").alias("sequence"))
    index = docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id").select(label.alias("label"), F.col("doc_id").alias("idx"))
    layers = emb(spark, d).select(F.col("id").alias("idx"), F.array("x", F.transform("x", lambda v: 2 * v)).alias("layers"))
    got = fasta.load_proteins(records, index, layers, 1)
    return got.select("id", "header", "species", "true_label", r6(F.get("x", F.lit(0))).alias("x_first"))


@query("resume_anti_join", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return fasta.pending(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), ["doc_id"])


@query("reference_index", "SELECT lang, doc_id AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents")
def reference_index(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("lang", F.col("doc_id").alias("name"))
    return fasta.reference_index(rows, "name", ["lang"]).withColumn("idx", F.col("idx").cast("long"))


@query(
    "composition_provider",
    "WITH " + SEQ + ", u AS (SELECT doc_id, upper(s) AS s FROM q) SELECT doc_id, 0 AS layer, CASE WHEN s <> '' THEN round((length(s) - length(replace(s, 'A', ''))) / length(s), 6) END AS share_a, "
    "CASE WHEN s <> '' THEN round((length(s) - length(replace(s, 'Y', ''))) / length(s), 6) END AS share_y, CASE WHEN s <> '' THEN round(length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / length(s), 6) END AS share_x FROM u",
)
def composition_provider(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences through the provider: shares of the first, last and of unknown residues."""
    got = embed(seqs(spark, d).select(F.col("doc_id").alias("id"), F.upper("s").alias("sequence")), "composition")
    share = lambda at: F.when(~F.isnan(F.get("x", F.lit(at))), r6(F.get("x", F.lit(at))))
    return got.select(F.col("id").alias("doc_id"), "layer", share(0).alias("share_a"), share(19).alias("share_y"), share(20).alias("share_x"))


INDEX = "ix AS (SELECT id, label, v, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS idx FROM e)"
EUCLID = """pd AS (SELECT a.label, a.idx AS i, b.idx AS j, CASE WHEN a.id % 17 = 0 OR b.id % 17 = 0 THEN 0 ELSE list_distance(a.v, b.v) END AS d FROM ix a JOIN ix b ON a.label = b.label AND a.idx < b.idx)"""


def family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each label's vectors; every seventeenth vector is taken for missing."""
    rows = emb(spark, d)
    index = fasta.reference_index(rows.withColumnRenamed("id", "name"), "name", ["label"])
    return distances.euclidean_pairs(rows.where("id % 17 <> 0").select("label", F.col("id").alias("name"), "x"), index, ["label"])


@query("euclidean_pairs", f"WITH {E}, {INDEX}, {EUCLID} SELECT label, i, j, round(d, 6) AS d FROM pd")
def euclidean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return family_pairs(spark, d).select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("d").alias("d"))


@query(
    "spearman_pearson_pairs",
    f"WITH {E}, {INDEX}, {EUCLID}, ab AS (SELECT label, round(d, 6) AS a, abs(i - j)::DOUBLE AS b FROM pd), "
    "rk AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY label ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2 AS rb FROM ab) "
    "SELECT label, round(corr(ra, rb), 4) AS spearman, round(corr(a, b), 4) AS pearson FROM rk GROUP BY label",
)
def spearman_pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = family_pairs(spark, d).select("label", r6("d").alias("a"), F.abs(F.col("i") - F.col("j")).cast("double").alias("b"))
    return distances.correlations(pairs, ["label"])


TREE = """RECURSIVE tree AS (SELECT k AS node, CASE WHEN k > 0 THEN (k - 1) // 2 END AS parent, (k % 7 + 1) * 0.5 AS len FROM (SELECT unnest(range(0, 2 * (SELECT count(*) FROM nation) - 1)) AS k)),
    up AS (SELECT node, node AS anc, 0.0::DOUBLE AS dist FROM tree UNION ALL SELECT up.node, t.parent, dist + t.len FROM up JOIN tree t ON t.node = up.anc WHERE t.parent IS NOT NULL),
    lf AS (SELECT n_nationkey AS idx, n_nationkey + (SELECT count(*) FROM nation) - 1 AS node FROM nation),
    co AS (SELECT a.idx AS i, b.idx AS j, min(x.dist + y.dist) AS d FROM lf a JOIN up x ON x.node = a.node JOIN up y ON y.anc = x.anc JOIN lf b ON b.node = y.node WHERE a.idx < b.idx GROUP BY 1, 2)"""


def nation_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A heap-shaped tree whose leaves are the nations."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("idx"))
    n = nations.count()
    k = F.col("id")
    named = F.when(k >= n - 1, (k - (n - 1)).cast("string"))
    tree = spark.range(2 * n - 1).select(k.cast("int").alias("node"), F.when(k > 0, F.floor((k - 1) / 2)).cast("int").alias("parent"), ((k % 7 + 1) * 0.5).cast("double").alias("branch_len"), named.alias("name"))
    return tree, nations.select(F.col("idx").cast("string").alias("name"), "idx")


@query("cophenetic_distance", f"WITH {TREE} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(d, 6) AS d FROM co")
def cophenetic_distance(spark: SparkSession, d: str) -> DataFrame:
    return trees.cophenetic_pairs(*nation_tree(spark, d)).select("i", "j", r6("d").alias("d"))


@query(
    "layer_correlations",
    f"WITH {TREE}, {E}, part AS (SELECT id % (SELECT count(*) FROM nation) AS idx, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM e), "
    "mean AS (SELECT idx, pos, avg(value) AS value FROM part GROUP BY 1, 2), x AS (SELECT idx, pos // 32 AS layer, list(value ORDER BY pos) AS x FROM mean GROUP BY 1, 2), "
    "pd AS (SELECT a.layer, list_distance(a.x, b.x) AS a, co.d AS b FROM co JOIN x a ON a.idx = co.i JOIN x b ON b.idx = co.j AND b.layer = a.layer), "
    "rk AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY a) + (count(*) OVER (PARTITION BY layer, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY layer ORDER BY b) + (count(*) OVER (PARTITION BY layer, b) - 1) / 2 AS rb FROM pd) "
    "SELECT CAST(layer AS BIGINT) AS layer, round(corr(ra, rb), 4) AS spearman, round(corr(a, b), 4) AS pearson FROM rk GROUP BY layer",
)
def layer_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the nations' mean vectors, in two layers of 32 components, against those in the tree of nations."""
    tree, index = nation_tree(spark, d)
    cells = emb(spark, d).select((F.col("id") % index.count()).cast("string").alias("name"), F.posexplode("x").alias("pos", "value"))
    means = cells.groupBy("name", "pos").agg(F.avg("value").alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "value")))
    layered = means.groupBy("name", F.floor(F.col("pos") / 32).cast("long").alias("layer")).agg(F.transform(listed, lambda c: c["value"]).alias("x"))
    pairs = materialize(trees.cophenetic_pairs(tree, index), "pairs")
    return distances.layer_correlations(layered, pairs, index, ["layer"])


@query(
    "interfamily_matrix",
    f"WITH {TREE}, dep AS (SELECT idx, max(dist) AS depth FROM lf JOIN up USING (node) GROUP BY 1), nn AS (SELECT count(*) AS n FROM nation) "
    "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(d, 6) AS d FROM (SELECT i, j, d FROM co UNION ALL SELECT i + n, j + n, 2 * d FROM co, nn UNION ALL SELECT a.idx, b.idx + n, a.depth + 1.5 + 2 * b.depth FROM dep a, dep b, nn)",
)
def interfamily_matrix(spark: SparkSession, d: str) -> DataFrame:
    tree, index = nation_tree(spark, d)
    pairs = materialize(trees.cophenetic_pairs(tree, index), "pairs")
    depth = materialize(trees.leaf_depths(tree).join(index, "name").select("idx", "depth"), "depth")
    double = lambda df, c: df.withColumn(c, 2 * F.col(c))
    got = distances.interfamily_pairs(pairs, double(pairs, "d"), depth, double(depth, "depth"), 1.5)
    return got.select("i", "j", r6("d").alias("d"))


@query(
    "merge_seq_index",
    "WITH a AS (SELECT c_nationkey AS name, row_number() OVER (ORDER BY c_nationkey) - 1 AS idx FROM (SELECT DISTINCT c_nationkey FROM customer)), b AS (SELECT s_nationkey AS name, row_number() OVER (ORDER BY s_nationkey) - 1 AS idx FROM (SELECT DISTINCT s_nationkey FROM supplier)) "
    "SELECT CAST(name AS BIGINT) AS name, CAST(max_by(idx, o) AS BIGINT) AS idx FROM (SELECT name, idx, 0 AS o FROM a UNION ALL SELECT name, idx + (SELECT count(*) FROM a), 1 FROM b) GROUP BY 1",
)
def merge_seq_index(spark: SparkSession, d: str) -> DataFrame:
    one = lambda table, c: fasta.reference_index(spark.read.parquet(f"{d}/{table}.parquet").select(F.col(c).cast("long").alias("name")).distinct(), "name")
    return distances.merge_indexes(one("customer", "c_nationkey"), one("supplier", "s_nationkey")).select("name", F.col("idx").cast("long").alias("idx"))


@query(
    "merge_stage_thresholds",
    f"WITH {E}, {PART}, c AS (SELECT level, count(DISTINCT cluster) AS k FROM part WHERE cluster >= 0 GROUP BY level), "
    "t AS (SELECT level AS stage, k AS fine_k, ((level - 1) / 2.0) ** 2 AS t FROM c WHERE level > 0) "
    "SELECT CAST(stage AS BIGINT) AS stage, fine_k, round(least(0.85 + 0.10 * t, 0.98), 6)::DOUBLE AS cos, round(least(0.05 + 0.05 * t, 0.5), 6)::DOUBLE AS edge, round(least(0.10 + 0.05 * t, 0.5), 6)::DOUBLE AS strong, stage = 3 AS final FROM t",
)
def merge_stage_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of the stages that the levels of the table have, with the clusters that come into each."""
    found = parted(spark, d).where("cluster >= 0").groupBy("level").agg(F.countDistinct("cluster").alias("fine_k"))
    rows = [(k + 1, r.cos, r.edge, r.strong, r.final) for k, r in enumerate(merge.stage_rules(found.count() - 1))]
    rules = spark.createDataFrame(rows, "stage long, cos double, edge double, strong double, final boolean")
    return found.join(rules, F.col("level") == F.col("stage")).select("stage", "fine_k", *[r6(c).alias(c) for c in ("cos", "edge", "strong")], "final")


@query(
    "tree_graft",
    "SELECT 'c:0' AS node, NULL AS parent, 0.0::DOUBLE AS branch_len UNION ALL SELECT 'c:' || (r_regionkey + 1), 'c:0', 1.0 FROM region WHERE r_regionkey > 0 "
    "UNION ALL SELECT r_name || ':0', CASE WHEN r_regionkey > 0 THEN 'c:' || (r_regionkey + 1) ELSE 'c:0' END, 0.0 FROM region "
    "UNION ALL SELECT r_name || ':' || (n_nationkey + 1), r_name || ':0', 0.5 FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def tree_graft(spark: SparkSession, d: str) -> DataFrame:
    """Regions hang on a consensus tree that lacks the first of them; nations are the leaves of their trees."""
    region, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    tree = lambda df, *c: df.select(*c)
    root = spark.createDataFrame([(0, None, 0.0, "root")], trees.TREE)
    key = F.col("r_regionkey").cast("int")
    inner = tree(region.where(key > 0), (key + 1).alias("node"), F.lit(0).alias("parent"), F.lit(1.0).alias("branch_len"), F.col("r_name").alias("name"))
    tops = tree(region, F.col("r_name").alias("family"), F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0.0).alias("branch_len"), F.lit(None).cast("string").alias("name"))
    leaves = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = tree(leaves, F.col("r_name").alias("family"), (F.col("n_nationkey").cast("int") + 1).alias("node"), F.lit(0).alias("parent"), F.lit(0.5).alias("branch_len"), F.col("n_name").alias("name"))
    return trees.graft(root.union(inner), tops.union(leaves)).select("node", "parent", "branch_len")


@query(
    "size_drift",
    f"WITH {E}, {SHAPES}, d AS (SELECT level, n_clusters / lag(n_clusters) OVER (ORDER BY level) AS ratio FROM shapes) SELECT CAST(level AS BIGINT) AS level, round(CASE WHEN ratio > 1 THEN least(ratio / 3, 1.0) ELSE 0 END, 6)::DOUBLE AS size_drift FROM d",
)
def size_drift(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.col("level").cast("long").alias("level"), r6("size_drift").alias("size_drift"))


@query("knn_cells")
def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact neighbours that the search over cells finds."""
    rows = units(spark, d)
    exact, k = near(spark, d)
    found = cell_neighbors(rows, k, probes=44)
    return exact.join(found, ["i", "j"], "left_semi").agg(F.count(F.lit(1)).alias("hit")).crossJoin(exact.agg(F.count(F.lit(1)).alias("n"))).select((F.col("hit") / F.col("n")).alias("recall"))  # one row each


@query("knn_descent", "SELECT count(*) AS n_rows, true AS full, true AS enough FROM embeddings")
def knn_descent(spark: SparkSession, d: str) -> DataFrame:
    """Rows, whether each list is full, and whether the refined neighbour graph has 0.95 of the exact neighbours."""
    exact, k = near(spark, d)
    found = materialize(descent_neighbors(units(spark, d), k), "found")
    hit = exact.join(found, ["i", "j"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    size = found.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_rows"), (F.min("n") == k).alias("full"))
    return size.crossJoin(hit).crossJoin(exact.agg(F.count(F.lit(1)).alias("n"))).select("n_rows", "full", (F.col("hit") >= 0.95 * F.col("n")).alias("enough"))  # one row each


@query(
    "merge_waves",
    f"WITH {E}, {PART}, f AS (SELECT * FROM part WHERE level = 2) SELECT (SELECT count(*) FROM f) AS n_items, (SELECT count(DISTINCT cluster) FROM f WHERE cluster >= 0) AS n_fine, true AS whole, true AS counted, true AS same_labels, true AS same_log",
)
def merge_waves(spark: SparkSession, d: str) -> DataFrame:
    """A merge stage whose guides run in waves, and what must hold of it: fine clusters stay whole, each merge is one
    cluster less, labels and log equal those of one queue for each connected group."""
    nbr, k = near(spark, d)
    part, edges, rows = materialize(parted(spark, d), "part"), materialize(graph.forward_graph(nbr), "edges"), emb(spark, d).select("id", "x")
    at = lambda level: part.where(F.col("level") == level).select("id", "cluster")
    rule = merge.MergeRule(cos=0.3, edge=0.02, strong=0.04, k=k, rescue=True, rescue_cos=0.35)
    (waves, log), (queue, told) = (merge.merge_stage(at(1), at(2), edges, rows, rule, held=held) for held in (0, graph.SMALL))
    both = at(2).withColumnRenamed("cluster", "fine").join(waves, "id").join(queue.withColumnRenamed("cluster", "other"), "id")
    by = both.groupBy("fine").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("goals"), F.min("cluster").alias("cluster"), F.count_if(F.col("cluster") != F.col("other")).alias("differ"))
    shape = by.agg(F.sum("n").alias("n_items"), F.count_if(F.col("fine") >= 0).alias("n_fine"), (F.max("goals") == 1).alias("whole"), (F.sum("differ") == 0).alias("same_labels"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("left"))
    plain = lambda t: t.select("guide", "seq", "child_a", "child_b", "merged", "reason", "size_a", "size_b")
    apart = plain(log).exceptAll(plain(told)).agg(F.count(F.lit(1)).alias("apart"))
    sums = log.agg(F.count_if("merged").alias("merges"), F.count(F.lit(1)).alias("n_log")).crossJoin(told.agg(F.count(F.lit(1)).alias("n_told")))
    same = (F.col("apart") == 0) & (F.col("n_log") == F.col("n_told"))
    return shape.crossJoin(apart).crossJoin(sums).select("n_items", "n_fine", "whole", (F.col("n_fine") - F.col("left") == F.col("merges")).alias("counted"), "same_labels", same.alias("same_log"))  # one row each


@query("merge_stages")
def merge_stages(spark: SparkSession, d: str) -> DataFrame:
    nbr, k = near(spark, d)
    part = materialize(parted(spark, d), "part")
    _, log = merge.refine_and_flatten(part, [0, 1, 2, 3], materialize(graph.forward_graph(nbr), "edges"), emb(spark, d).select("id", "x"), k, 0.3, 0.02, None, True, 0.35)
    return merge.stage_table(part, [0, 1, 2, 3], log, 0.3, 0.02)


@query("leiden_grid")
def leiden_grid(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.forward_graph(near(spark, d)[0])
    part, found = leiden.multiscale_grid(emb(spark, d).select("id"), materialize(edges, "edges"), (0.02, 0.05, 0.1, 0.2))
    return levels.relabel_contiguous(part, ["level"]).join(found.select("level", "resolution"), "level")


INVARIANT = """WITH r AS (SELECT unnest([{0}]) AS resolution)
    SELECT CAST(resolution AS DOUBLE) AS resolution, (SELECT count(*) FROM embeddings) AS n_items, true AS above_singletons, true AS inside_components, true AS least_names FROM r"""


def _invariants(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """For each resolution of ``found (resolution, id, cluster)``: items, whether its CPM quality is at least that of single
    nodes (0), whether clusters lie inside components, and whether each has the name of its least member."""
    parts = graph.node_components(nodes, edges)
    by = found.join(parts, "id").groupBy("resolution", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("parts"), F.min("id").alias("least"))
    a, b = found.select("resolution", F.col("id").alias("u"), F.col("cluster").alias("a")), found.select("resolution", F.col("id").alias("v"), F.col("cluster").alias("b"))
    inside = edges.join(a, "u").join(b, ["resolution", "v"]).where("a = b").groupBy("resolution").agg(F.sum("w").alias("inside"))
    shape = by.groupBy("resolution").agg(
        F.sum("n").alias("n_items"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), (F.max("parts") == 1).alias("inside_components"), F.min(F.col("least") == F.col("cluster")).alias("least_names")
    )
    good = F.coalesce("inside", F.lit(0.0)) - F.col("resolution") * F.col("pairs") >= -1e-6
    return shape.join(inside, "resolution", "left").select("resolution", "n_items", good.alias("above_singletons"), "inside_components", "least_names")


@query("leiden_rounds", INVARIANT.format("0.3, 0.6"))
def leiden_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Communities found in rounds, without a task that holds a component, and what must hold of them."""
    edges, nodes = materialize(graph.union_graph(near(spark, d)[0]), "edges"), emb(spark, d).select("id")
    numbered = spark.createDataFrame([(0, 0.3), (1, 0.6)], "run long, gamma double")
    found = leiden.leiden_rounds(edges, nodes.withColumn("mass", F.lit(1.0)).crossJoin(F.broadcast(numbered)), iterations=1, rest=0.02)  # two runs
    return _invariants(nodes, edges, materialize(found.join(F.broadcast(numbered), "run").select(F.col("gamma").alias("resolution"), "id", "cluster"), "found"))


@query("leiden_grid_invariants", INVARIANT.format(", ".join(map(str, leiden.GRID))))
def leiden_grid_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The default grid and what must hold of every partition in it."""
    edges, nodes = materialize(graph.forward_graph(near(spark, d)[0]), "edges"), emb(spark, d).select("id")
    return _invariants(nodes, edges, materialize(leiden.run_leiden(nodes, edges).drop("seed"), "found"))


@query("resolution_profile")
def resolution_profile(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(graph.forward_graph(near(spark, d)[0]), "edges")
    return leiden.resolution_profile(emb(spark, d).select("id"), edges)[1]


@query("consensus_nmi")
def consensus_nmi(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(graph.forward_graph(near(spark, d)[0]), "edges")
    return leiden.consensus_nmi(emb(spark, d).select("id"), edges, (0.05, 0.2), runs=3)


@query("merge_cascade")
def merge_cascade(spark: SparkSession, d: str) -> DataFrame:
    nbr, k = near(spark, d)
    rows = emb(spark, d).select("id", "x")
    labels, _ = merge.refine_and_flatten(parted(spark, d), [0, 1, 2, 3], materialize(graph.forward_graph(nbr), "edges"), rows, k, 0.3, 0.02, None, True, 0.35)
    return levels.relabel_contiguous(labels)


@query("kmeans_families")
def kmeans_families(spark: SparkSession, d: str) -> DataFrame:
    return experiments.kmeans_families(emb(spark, d).withColumnRenamed("label", "true"), k=10, pca_dim=16, seeds=3)


@query("hdbscan_baseline")
def hdbscan_baseline(spark: SparkSession, d: str) -> DataFrame:
    return experiments.baselines(units(spark, d), judged(spark, d).select("id", "true"), threshold=0.7)


@query("density_tables")
def density_tables(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters from blocks of vectors and batches of tree edges."""
    return density.density_clusters(units(spark, d), min_cluster_size=3, min_samples=2)


@query("agglomerative_baseline")
def agglomerative_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage over the neighbour graph up to a cosine distance of 0.7."""
    return baselines.agglomerative(units(spark, d).select("id", "x"), 0.7, "average", 10)


@query("simple_leiden")
def simple_leiden(spark: SparkSession, d: str) -> DataFrame:
    return experiments.simple_leiden(units(spark, d))


@query("merge_parameter_sweep")
def merge_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    config = multiscale.Config(consensus_runs=1, resolutions=(0.05, 0.1, 0.2))
    built = multiscale.build(emb(spark, d), config)
    return experiments.sweep_merges(built, config, judged(spark, d).select("id", "true"), n=3)


@query("graph_comparison")
def graph_comparison(spark: SparkSession, d: str) -> DataFrame:
    return experiments.best_resolution(experiments.compare_graphs(units(spark, d).select("id", "x"), judged(spark, d).select("id", "true"), steps=4))


@query("shuffled_sequences")
def shuffled_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a shuffled sequence are those of the sequence."""
    rows = seqs(spark, d).select("doc_id", "s", sequences.shuffled("s").alias("t"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    return rows.select("doc_id", (letters("s") == letters("t")).alias("same_letters"), (F.col("s") != F.col("t")).alias("moved"))


@query("multiscale_pipeline")
def multiscale_pipeline(spark: SparkSession, d: str) -> DataFrame:
    truth = judged(spark, d).select("id", "true", "species")
    return multiscale.run(emb(spark, d), multiscale.Config(consensus_runs=2), truth).metrics


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour graph, components of its close edges, and pair metrics of those against the labels."""
    parts = graph.node_components(emb(spark, d), linked(spark, d)).withColumnRenamed("component", "pred")
    return evaluation.pairwise_confusion(parts.join(judged(spark, d).select("id", "true"), "id"))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"WITH RECURSIVE {COMPONENTS}, j AS (SELECT c.id, component AS pred, label AS true_g FROM comp c JOIN e ON e.id = c.id), {confusion_sql('j')} SELECT tp, fp, fn, tn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM conf"
