"""Rules of single operators on small cases worked by hand, and invariants."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratigraph.operators import evaluation, graph, leiden, leiden_kernel, levels, merge, neighbors, vectors
from stratigraph.operators.baselines import agglomerative, density_labels, linked_labels
from stratigraph.operators.components import connected_components
from stratigraph.plans import multiscale


def planted(sizes=(30, 20, 12, 8, 5, 4), width=16, noise=0.05, seed=7):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for c, m in enumerate(sizes):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(m):
            rows.append((n, [float(v) for v in centre + noise * rng.normal(size=width)], c, int(rng.integers(3))))
            n += 1
    return rows


def brute_pairs(pred, true):
    tp = fp = fn = tn = 0
    for a, b in itertools.combinations(range(len(pred)), 2):
        p, t = pred[a] == pred[b] and pred[a] >= 0, true[a] == true[b]
        tp, fp, fn, tn = tp + (p and t), fp + (p and not t), fn + (t and not p), tn + (not p and not t)
    return tp, fp, fn, tn


def test_confusion_equals_pairs(spark):
    rng = random.Random(3)
    pred, true = [rng.randrange(-1, 5) for _ in range(60)], [rng.randrange(4) for _ in range(60)]
    row = evaluation.pairwise_confusion(spark.createDataFrame(list(zip(pred, true)), "pred long, true long")).first()
    assert (row.tp, row.fp, row.fn, row.tn) == brute_pairs(pred, true)


def test_confusion_of_nothing_is_zero(spark):
    row = evaluation.pairwise_confusion(spark.createDataFrame([], "pred long, true long")).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.f1) == (0, 0, 0, 0, 0.0)


def test_group_types(spark):
    rows = [("g1", "a"), ("g1", "b"), ("g2", "a"), ("g2", "b"), ("g2", "b"), ("g3", "a"), ("g3", "a"), ("g3", "b"), ("g3", "b"), ("g3", "b"), ("g4", "a"), *[("g5", "a")] * 4]
    got = dict(evaluation.group_types(spark.createDataFrame(rows, "true string, species string")).collect())
    assert got == {"g1": "1:1", "g2": "1:m", "g3": "n:m", "g4": "1:1", "g5": "n:m"}


def test_information_measures_of_equal_and_single_partitions(spark):
    same = spark.createDataFrame([(k % 4, k % 4 + 10) for k in range(40)], "pred long, true long")
    one = spark.createDataFrame([(0, 0)] * 5, "pred long, true long")
    assert evaluation.nmi(same).first()[0] == pytest.approx(1) and evaluation.nmi(one).first()[0] == 1
    assert evaluation.adjusted_mutual_info(same).first()[0] == pytest.approx(1)
    assert evaluation.v_measure(one).first().v_measure == 1


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)]
    up = list(range(200))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = sorted((top(a), top(b)))
        up[rb] = ra
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: top(x) for e in edges for x in e}
    assert got == dict(connected_components(spark.createDataFrame(edges, "u long, v long"), small=1000).collect())
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_neighbours_in_blocks_equal_broadcast_and_ties_go_to_the_least_id(spark):
    rows = [(k, [float(v) for v in np.random.default_rng(k % 37).normal(size=6)]) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    key = lambda d: sorted((r.i, r["rank"], r.j) for r in d.collect())
    whole = key(neighbors.top_neighbors(df, 5))
    assert whole == key(neighbors.top_neighbors(df, 5, broadcast_bytes=0, block_rows=17))
    x = np.array([r[1] for r in rows])
    for i in range(80):
        s = np.round(x @ x[i], 12)
        want = [j for j in np.lexsort((np.arange(80), -s)) if j != i][:5]
        assert [j for a, _, j in whole if a == i] == want


def test_exact_search_leaves_vectors_off_the_driver_and_copies_tie_by_id(spark, monkeypatch):
    base = np.random.default_rng(3).normal(size=(30, 7)) * 1e6
    df = spark.createDataFrame([(k, [float(v) for v in base[k % 30]]) for k in range(600)], "id long, x array<double>")
    monkeypatch.setattr(type(df), "toPandas", lambda *_: pytest.fail("a table came to the driver"))
    got = {}
    for r in neighbors.top_neighbors(df, 25, block_rows=70).collect():
        got.setdefault(r.i, {})[r["rank"]] = r.j
    for i in range(600):
        order = sorted(range(30), key=lambda c: -float(base[c] @ base[i % 30]))
        want = [j for c in order[:3] for j in range(c, 600, 30) if j != i][:25]
        assert [got[i][rank] for rank in range(1, 26)] == want


def test_agglomeration_joins_no_list_of_pairs_to_rows(spark):
    rows = planted((20, 20, 20), width=8, noise=0.3)
    df = vectors.l2_normalize(spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, x array<double>"))
    got = agglomerative(df, 0.3, "average", 8)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    x = np.array([r.x for r in df.orderBy("id").collect()])
    pairs = {tuple(sorted((r.i, r.j))) for r in neighbors.top_neighbors(df, 8).collect()}
    clusters, linked = {k: [k] for k in range(60)}, set(pairs)
    while linked:  # every mean over all pairs of members
        d, a, b = min((float(np.mean(1 - x[clusters[a]] @ x[clusters[b]].T)), a, b) for a, b in linked)
        if d > 0.3:
            break
        new = max(clusters) + 1 + len(rows)
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        linked = {tuple(sorted(new if c in (a, b) else c for c in pair)) for pair in linked if pair != (a, b)}
    want = {k: min(own) for own in clusters.values() for k in own}
    assert {r.id: r.cluster for r in got.collect()} == want


def test_neighbours_over_cells_find_nine_of_ten(spark):
    rows = [(r[0], r[1]) for r in planted((25,) * 12, width=12, noise=0.15)]
    df = vectors.l2_normalize(spark.createDataFrame(rows, "id long, x array<double>"))
    exact = {(r.i, r.j) for r in neighbors.top_neighbors(df, 8).collect()}
    for block in (8192, 20):
        found = neighbors.cell_neighbors(df, 8, cells=20, probes=5, block_rows=block).collect()
        assert len({(r.i, r.j) for r in found} & exact) >= 0.9 * len(exact)
        assert all(r.i != r.j for r in found) and len({(r.i, r["rank"]) for r in found}) == len(found)


def test_directions_of_graphs(spark):
    nbr = spark.createDataFrame([(5, 1, 1, 0.9), (1, 1, 2, 0.8), (2, 1, 1, 0.8)], "i long, rank int, j long, score double")
    pairs = lambda d: {(r.u, r.v) for r in d.collect()}
    assert pairs(graph.forward_graph(nbr)) == {(1, 2)}
    assert pairs(graph.union_graph(nbr)) == {(1, 5), (1, 2)}
    assert pairs(graph.mutual_graph(nbr)) == {(1, 2)}
    snn = graph.snn_pairs(nbr)
    assert pairs(graph.prune(snn, "none")) == {(1, 2)} and pairs(graph.prune(snn, "inverse_k", 2)) == set()


def test_hierarchy_tie_goes_to_the_cluster_of_the_least_id(spark):
    part = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 3, 4), (0, 4, 4), *[(1, k, 0) for k in (1, 2, 3, 4)]], "level int, id long, cluster long")
    row = levels.build_hierarchy(part).first()
    assert (row.parent_cluster, row.overlap) == (7, 0.5)


def test_selection_may_exceed_the_cap_by_one():
    n = 1000
    made = [levels.Level(k, c, n, 0.5 - k / 100) for k, c in enumerate((20, 70, 120, 200, 333, 400, 600, 45, 90))]
    kept = levels.select_levels(made, 6)
    assert len(kept) == 7 and 4 in kept
    assert levels.select_levels(made[:3], 6) == [0, 1, 2]
    assert levels.select_levels([levels.Level(0, 1, n, -1, False)], 6) == [0]


def test_positions_over_many_partitions(spark):
    from stratigraph.operators.ranking import positions

    values = random.Random(6).sample(range(10_000), 500)
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v long").repartition(7)
    assert [r.pos for r in positions(df, "v").orderBy("v").collect()] == list(range(500))
    for g in range(3):
        own = sorted(v for k, v in enumerate(values) if k % 3 == g)
        assert [(r.v, r.pos) for r in positions(df, "v", ["g"]).where(f"g = {g}").orderBy("v").collect()] == list(zip(own, range(len(own))))
    assert positions(df.limit(0), "v").count() == 0


def test_ladder_thinning():
    assert levels.thin_ladder([(0.1, 10), (0.2, 11), (0.3, 12), (0.4, 40), (0.5, 41)]) == [(0.1, 10), (0.3, 12), (0.4, 40), (0.5, 41)]
    assert levels.thin_ladder([]) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.sampled_from([0.2, 0.5, 1.0])), min_size=1, max_size=14), st.sampled_from([0.05, 0.2, 0.5]), st.integers(0, 3))
def test_leiden_invariants(edges, gamma, seed):
    net = leiden_kernel.Network.of_edges(7, edges)
    labels = leiden_kernel.leiden(net, gamma, seed)
    assert len(labels) == 7 and labels == leiden_kernel.leiden(leiden_kernel.Network.of_edges(7, edges), gamma, seed)
    assert leiden_kernel.quality(net, labels, gamma) >= leiden_kernel.quality(net, list(range(7)), gamma) - 1e-9
    for c in set(labels):
        members = [v for v in range(7) if labels[v] == c]
        seen, todo = {members[0]}, [members[0]]
        while todo:
            for u in net.links[todo.pop()]:
                if labels[u] == c and u not in seen:
                    seen.add(u)
                    todo.append(u)
        assert seen == set(members)


def test_leiden_finds_the_best_partition_of_two_triangles():
    net = leiden_kernel.Network.of_edges(6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 0.2)])
    assert leiden_kernel.leiden(net, 0.4) == [0, 0, 0, 1, 1, 1]


def test_profile_makes_small_components_single(spark):
    rng = random.Random(1)
    ring = [(k, (k + s) % 60, 1.0) for k in range(60) for s in (1, 2)]
    small = [(60 + k, 60 + (k + 1) % 49, 1.0) for k in range(49)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in ring + small], "u long, v long, w double")
    nodes = spark.range(111).select("id")
    part, found = leiden.resolution_profile(nodes, edges, min_component=50)
    assert rng and found.count() >= 1
    for r in part.where("id >= 60").groupBy("level", "cluster").count().collect():
        assert r["count"] == 1
    assert part.groupBy("level").count().select("count").distinct().first()[0] == 111


def test_refined_neighbours_reach_nearly_all_exact_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 10)) + rng.integers(0, 4, (900, 1))
    rows = [(5 * i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)] + [(9001, [0.0] * 10), (9002, [0.0] * 10)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    exact = {(r.i, r.j) for r in neighbors.top_neighbors(df, 8).collect()}
    found = neighbors.descent_neighbors(df, 8, lists=20, probes=2).collect()
    assert len({(r.i, r.j) for r in found}) == len(found) == 8 * len(rows) and all(r.i != r.j for r in found)
    assert len(exact & {(r.i, r.j) for r in found if r.i < 9000}) >= 0.95 * 8 * 900
    assert neighbors.descent_neighbors(df.limit(0), 3).isEmpty() and neighbors.descent_neighbors(df.limit(1), 3).isEmpty()
    assert {(r.i, r.rank, r.j) for r in neighbors.descent_neighbors(df.limit(2), 3).collect()} == {(0, 1, 5), (5, 1, 0)}


def test_long_lists_are_not_refined_where_all_pairs_are_fewer(spark, monkeypatch):
    """Lists of 30 would hold up to 1800 pairs a row and round against each other; 200 rows have 199."""
    monkeypatch.setattr(neighbors, "cell_neighbors", None)
    x = np.random.default_rng(5).normal(size=(200, 6))
    df = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert neighbors.descent_neighbors(df, 8).exceptAll(neighbors.top_neighbors(df, 8)).isEmpty() and neighbors.descent_neighbors(df, 8).count() == 1600


def run_sequential(guide, fine, edges, x, rule):
    """One queue over all guides in rising order, written plainly: what branch groups must reproduce."""
    sizes, totals, cross = {}, {}, {}
    for i, c in fine.items():
        sizes[c] = sizes.get(c, 0) + 1
        totals[c] = totals.get(c, 0) + np.array(x[i])
    for u, v in edges:
        a, b = sorted((fine[u], fine[v]))
        if a != b:
            cross[a, b] = cross.get((a, b), 0) + 1
    work = merge.Branches(sizes, totals, cross, rule)
    for g in sorted(set(guide.values())):
        work.work(g, {fine[i] for i in guide if guide[i] == g})
    return {i: work.now(c) for i, c in fine.items()}


def test_chance_overlap_equals_exact_sums():
    from fractions import Fraction
    from math import comb, log

    for x, y, n in [(1, 1, 1), (1, 1, 2), (3, 4, 7), (7, 7, 7), (5, 9, 12), (40, 300, 500), (1, 900, 1000), (400, 600, 1000)]:
        want = sum(k / n * log(n * k / (x * y)) * float(Fraction(comb(x, k) * comb(n - x, y - k), comb(n, y))) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert evaluation.overlap_information(x, y, n) == pytest.approx(want, abs=1e-12)
    # far beyond factorials: a nearly even hypergeometric, where the term tends to a known limit
    n = 10**13
    assert evaluation.overlap_information(n // 2, n // 2, n) == pytest.approx(1 / (8 * n), rel=0.01, abs=1e-13)
    assert evaluation.overlap_information(1, n // 2, n) == pytest.approx(np.log(2) / (2 * n))


def test_adjusted_information_of_random_labels(spark):
    import math

    rng = random.Random(8)
    rows = [(rng.randrange(-1, 70), min(int(rng.expovariate(0.03)), 150)) for _ in range(1500)]
    got = evaluation.adjusted_mutual_info(spark.createDataFrame(rows, "pred long, true long")).first()[0]
    n, cells = len(rows), pd.DataFrame(rows, columns=["a", "b"])
    na, nb, nab = (cells.groupby(c).size() for c in ("a", "b", ["a", "b"]))
    mi = sum(m / n * math.log(m * n / (na[a] * nb[b])) for (a, b), m in nab.items())
    ha, hb = (-sum(m / n * math.log(m / n) for m in side) for side in (na, nb))
    g = math.lgamma
    expected = sum(
        k / n * math.log(n * k / (x * y)) * math.exp(g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1))
        for x in na for y in nb for k in range(max(1, x + y - n), min(x, y) + 1)
    )
    assert got == pytest.approx((mi - expected) / ((ha + hb) / 2 - expected), abs=1e-8)
    one = lambda rows: evaluation.adjusted_mutual_info(spark.createDataFrame(rows, "pred long, true long")).first()[0]
    assert one([]) == one([(1, 1)]) == one([(1, 5), (1, 5)]) == one([(1, 1), (2, 2)]) == 1 and one([(1, 1), (1, 2)]) == 0


@pytest.mark.parametrize("seed, held", [(1, 200_000), (2, 200_000), (3, 200_000), (1, 0), (2, 0), (3, 12)])
def test_branch_groups_equal_one_sequential_run(spark, seed, held):
    rng = np.random.default_rng(seed)
    n = 60
    x = {i: [float(v) for v in rng.normal(size=4) + np.eye(4)[i % 4] * 3] for i in range(n)}
    fine, guide = {i: int(i % 15) for i in range(n)}, {i: int((i % 15) // 3 if rng.random() > 0.05 else rng.integers(5)) for i in range(n)}
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (200, 2)) if a < b]
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, cluster long")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double")
    vec = spark.createDataFrame(list(x.items()), "id long, x array<double>")
    rule = merge.MergeRule(cos=0.7, edge=0.02, strong=0.3, k=8, large=10, rescue=True, rescue_cos=0.9, final=True)
    merged, log = merge.merge_stage(table(guide), table(fine), e, vec, rule, held=held)
    assert dict(merged.collect()) == run_sequential(guide, fine, edges, x, rule)
    assert log.where("merged").count() == len(set(fine.values())) - len(set(run_sequential(guide, fine, edges, x, rule).values()))


def test_waves_where_every_guide_shares_a_cluster_with_the_next(spark):
    rng = np.random.default_rng(9)
    # cluster c has members in the guides c // 2 and (c + 1) // 2, so all guides hang in one chain
    fine = {i: i // 6 for i in range(84)}
    guide = {i: (c + i % 2) // 2 for i, c in fine.items()}
    x = {i: [float(v) for v in rng.normal(size=3) + np.eye(3)[c % 3]] for i, c in fine.items()}
    edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 84, (300, 2)).tolist() if a != b and abs(a - b) < 20})
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, cluster long")
    e, vec = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double"), spark.createDataFrame(list(x.items()), "id long, x array<double>")
    rule = merge.MergeRule(cos=0.6, edge=0.02, strong=0.25, k=4)
    told = []
    for held in (200_000, 0):
        merged, log = merge.merge_stage(table(guide), table(fine), e, vec, rule, held=held)
        assert dict(merged.collect()) == run_sequential(guide, fine, edges, x, merge.MergeRule(**{**rule.__dict__, "large": 12.0}))
        told.append([(r.guide, r.seq, r.child_a, r.child_b, round(r.centroid_sim, 9), round(r.edge_connectivity, 9), r.merged, r.reason, r.size_a, r.size_b) for r in log.orderBy("guide", "seq").collect()])
    assert told[0] == told[1] and any(r[6] for r in told[0]) and not all(r[6] for r in told[0])


def test_stage_without_guides_or_edges(spark):
    none = spark.createDataFrame([], "id long, cluster long")
    fine, vec = spark.createDataFrame([(0, 4), (1, -1)], "id long, cluster long"), spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, x array<double>")
    merged, log = merge.merge_stage(none, fine, spark.createDataFrame([], "u long, v long, w double"), vec, merge.MergeRule())
    assert dict(merged.collect()) == {0: 4, 1: -1} and log.isEmpty()


def test_merge_paths():
    unit = lambda a: np.array([np.cos(a), np.sin(a)])
    judge = lambda sizes, angle, m, **r: merge.Branches({0: sizes[0], 1: sizes[1]}, {0: unit(0) * sizes[0], 1: unit(angle) * sizes[1]}, {(0, 1): m} if m else {}, merge.MergeRule(k=10, **r)).judge(0, 1)
    assert judge((5, 5), 1.5, 10)[4] == "branch_local"
    assert judge((5, 5), 0.3, 3)[3].startswith("cos")
    assert judge((5, 5), 0.1, 0, rescue=True)[0] == pytest.approx(1 + np.cos(0.1))
    assert judge((30, 25), 0.1, 0, rescue=True, final=True)[4] == "size_rescue"
    assert judge((5, 5), 1.5, 1)[0] is None


def test_cascade_of_no_and_one_level(spark):
    vec = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, x array<double>")
    part = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "level int, id long, cluster long")
    e = spark.createDataFrame([], "u long, v long, w double")
    assert {r.cluster for r in merge.refine_and_flatten(part, [], e, vec, 3)[0].collect()} == {-1}
    assert dict(merge.refine_and_flatten(part, [0], e, vec, 3)[0].collect()) == {0: 5, 1: 6}


def test_planted_clusters_are_found(spark):
    rows = planted((20,) * 6)
    df = spark.createDataFrame(rows, "id long, x array<double>, true long, species long")
    config = multiscale.Config(consensus_runs=2, resolutions=(0.02, 0.05, 0.2), graph_type="mutual", k_coeff=0.9, scale=False)
    done = multiscale.run(df, config, df.select("id", "true", "species"))
    assert done.metrics.first().f1 > 0.9
    stage = done.stages.orderBy("stage").collect()
    assert [r.fine_k_after for r in stage] == [r.fine_k_before - r.n_merges for r in stage]
    from stratigraph.sources.results import SUMMARY, summary_row

    row = summary_row("fine", done.metrics)
    assert row.columns == list(SUMMARY.values()) and row.first().pairwise_F1 > 0.9


def test_vectors_of_constant_columns_and_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "id long, x array<double>")
    assert [r.x for r in vectors.standardize(df).collect()] == [[0.0, 0.0]] * 2
    assert [r.x for r in vectors.l2_normalize(spark.createDataFrame([(0, [0.0, 0.0])], "id long, x array<double>")).collect()] == [[0.0, 0.0]]


def test_density_and_linkage_separate_two_clouds():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(30, 2)) * 0.1, rng.normal(size=(30, 2)) * 0.1 + 5]
    labels = density_labels(x, 5, 3)
    assert len(set(labels[:30][labels[:30] >= 0])) == 1 and len(set(labels[30:][labels[30:] >= 0])) == 1 and set(labels[:30]) - {-1} != set(labels[30:]) - {-1}
    pairs = np.array([(a, b) for a, b in itertools.combinations(range(60), 2)])
    assert len(set(linked_labels(np.r_[np.tile([1.0, 0], (30, 1)), np.tile([0, 1.0], (30, 1))], pairs, 0.5))) == 2
    assert isinstance(pd.Series(labels), pd.Series)


def test_mean_ranks_over_partitions(spark):
    from stratigraph.operators.ranking import mean_ranks

    rng = random.Random(6)
    rows = [(rng.choice("ab"), round(rng.gauss(0, 1), rng.choice([0, 1, 4]))) for _ in range(3000)] + [("c", 0.5)] * 900
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {(r["g"], r["x"] + 0.0): r["rank"] for r in mean_ranks(df, "x", ["g"], "rank").collect()}
    table = pd.DataFrame(rows, columns=["g", "x"])
    table["rank"] = table.groupby("g")["x"].rank(method="average")
    assert got == {(g, x + 0.0): k for g, x, k in zip(table["g"], table["x"], table["rank"], strict=True)}
    assert mean_ranks(df.limit(0), "x", ["g"], "rank").count() == 0


def test_twins_by_matrices_are_those_of_single_cosines():
    rng = np.random.default_rng(3)
    sizes = {c: int(rng.integers(1, 30)) for c in range(700)}
    base = rng.normal(size=(40, 8))
    totals = {c: sizes[c] * (base[c % 40] + 0.05 * rng.normal(size=8)) for c in sizes}
    got = merge.Branches(sizes, totals, {}, merge.MergeRule(rescue=True, rescue_cos=0.9))
    found = {(a, b) for a, others in got.twins(sorted(sizes)).items() for b in others}
    small = [c for c in sizes if sizes[c] <= 20]
    wanted = {(a, b) for a in small for b in small if a < b and got.cos(a, b) >= 0.9}
    assert found == wanted and len(wanted) > 100


def test_a_group_of_three_hundred_thousand_rows_is_one_unit(spark):
    """One wave does what took one for each guide of a chain."""
    touch = spark.createDataFrame([(g, c) for g in range(4) for c in (g, g + 1)], "guide long, cluster long")
    cross = spark.range(300_000).selectExpr("id % 5 as ca", "(id + 1) % 5 as cb", "1L as n_edges").where("ca < cb").union(spark.range(100_000).selectExpr("0L as ca", "1L as cb", "1L as n_edges"))
    assert cross.count() > 300_000
    worked = merge._wave(touch, cross, merge.merge_stage.__defaults__[-1]).collect()
    assert len(worked) == 8 and len({r["unit"] for r in worked}) == 1


@pytest.mark.parametrize("part", [1 << 20, 500])
def test_lists_over_cells_are_the_best_of_all_probed_cells(spark, part):
    """All cells probed give the exact lists, in one part or several; only the searched rows are repeated, and not by a shuffle."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(150, 4)))], "id long, x array<double>")
    found = neighbors.cell_neighbors(df, 6, cells=9, probes=9, block_rows=20, broadcast_bytes=part)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    key = lambda t: sorted((r.i, r["rank"], r.j) for r in t.collect())
    assert key(found) == key(neighbors.top_neighbors(df, 6))
