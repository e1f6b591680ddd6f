"""Sequence files, clean-up, consensus, trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratigraph.functions.providers import embed, pooled
from stratigraph.operators import distances, sequences, trees
from stratigraph.plans import experiments
from stratigraph.sources import fasta, results


def test_fasta_with_dirt(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one|x|y|z|G1 a>b\nac-DX\n ef\n>two\nAA\n>one|x|y|z|G1 a>b\nKK\n")
    got = {r.header: r.sequence for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one|x|y|z|G1 a>b": "KK", "two": "AA"}


def test_index_and_lists(spark, tmp_path):
    (tmp_path / "i.csv").write_text("idx,label\n1, a \n2,b\n3,a\n")
    assert {r.label: r.idx for r in fasta.read_index(spark, str(tmp_path / "i.csv")).collect()} == {"a": 3, "b": 2}
    (tmp_path / "p.txt").write_text("PF1 PF2\n\n  PF3   PF4 \n")
    assert sorted(map(tuple, fasta.read_list(spark, str(tmp_path / "p.txt"), ("a", "b")).collect())) == [("PF1", "PF2"), ("PF3", "PF4")]


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.123456, None)], "level int, f1 double, x double")
    results.save_results(df, str(tmp_path / "r"))
    text = spark.read.csv(str(tmp_path / "r/levels.tsv"), sep="\t", header=True).first()
    assert (text.f1, text.x) == ("0.1235", "0.0000")


def test_cleanup(spark):
    row = spark.createDataFrame([("aXb.-UZ*",)], "s string").select(
        sequences.std_gaps("s").alias("a"), sequences.x_to_gaps("s").alias("b"), sequences.remove_gaps("s").alias("c"), sequences.remove_insertions("s").alias("d"), sequences.model_ready("s").alias("e"), sequences.is_alphabet(F.lit("AC.-w")).alias("f"), sequences.is_alphabet(F.lit("AB")).alias("g")
    ).first()
    assert tuple(row) == ("aXb--UZ*", "A-B.-UZ*", "aXb-UZ*", "X-UZ", "a X b . - X X *", 1, 0)


def test_consensus_ties_and_gaps(spark):
    rows = [("f", k, s) for k, s in enumerate(["AC-GTA", "AD-GTC", "TC-G-C", "TD-GAA"])]
    df = spark.createDataFrame(rows, "f string, r int, s string")
    assert sequences.consensus(df, "f", "r", "s").first().consensus == "AC-GTA"
    with pytest.raises(Exception, match="unequal"):
        sequences.consensus(spark.createDataFrame([("f", 0, "AA"), ("f", 1, "A")], "f string, r int, s string"), "f", "r", "s").collect()
    assert sequences.consensus(df.limit(0), "f", "r", "s").count() == 0


def test_composition_sums_to_one_and_unknown_is_x(spark):
    x = spark.createDataFrame([("AAB-",)], "s string").select(sequences.composition("s")).first()[0]
    assert x[0] == 0.5 and x[-1] == 0.5 and sum(x) == 1


def test_newick(spark):
    tree = spark.createDataFrame(trees.parse_newick("((A:1,B:2):3,C:4);"), trees.TREE)
    index = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "name string, idx long")
    assert {(r.i, r.j): r.d for r in trees.cophenetic_pairs(tree, index).collect()} == {(0, 1): 3, (0, 2): 8, (1, 2): 9}
    assert {r.name: r.depth for r in trees.leaf_depths(tree).collect()} == {"A": 4, "B": 5, "C": 4}


@pytest.mark.parametrize("shape, block", [("any", 256), ("any", 3), ("caterpillar", 4), ("star", 5)])
def test_paths_between_leaves_equal_walks_to_the_root(spark, shape, block):
    rng = random.Random(len(shape))
    rows = [(0, None, 0.0, "n0")]
    for k in range(1, 40):
        parent = {"any": rng.randrange(k), "caterpillar": max(0, k - 1 - k % 2), "star": 0}[shape]
        rows.append((k, parent, round(rng.uniform(-0.2, 2), 3), f"n{k}"))  # joined trees may have negative lengths
    names = rng.sample(range(40), 23)  # inner nodes as well as leaves
    up = {k: (p, w) for k, p, w, _ in rows}

    def path(k):
        out, d = {}, 0.0
        while k is not None:
            out[k] = d
            k, d = up[k][0], d + up[k][1]
        return out

    want = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            x, y = path(a), path(b)
            deepest = next(k for k in x if k in y)  # walks go upwards
            want[j, i] = x[deepest] + y[deepest]
    index = spark.createDataFrame([(f"n{k}", i) for i, k in enumerate(names)], "name string, idx long")
    got = trees.cophenetic_pairs(spark.createDataFrame(rows, trees.TREE), index, block).collect()
    assert len(got) == len(want) and {(r.i, r.j): pytest.approx(r.d) for r in got} == want
    assert trees.cophenetic_pairs(spark.createDataFrame(rows, trees.TREE), index.limit(0), block).isEmpty()


def test_graft_below_named_node_or_root(spark):
    base = spark.createDataFrame(trees.parse_newick("(P1:1,P2:2)R;"), trees.TREE)
    fam = [("P1", *r) for r in trees.parse_newick("(a:1,b:1);")] + [("P9", *r) for r in trees.parse_newick("(c:1,d:1);")]
    got = {r.node: r.parent for r in trees.graft(base, spark.createDataFrame(fam, "family string, " + trees.TREE)).collect()}
    assert got["P1:0"] == "c:1" and got["P9:0"] == "c:0" and got["P1:1"] == "P1:0" and len(got) == 9


def test_missing_vectors_have_distance_zero(spark):
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, idx long")
    vec = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "name string, x array<double>")
    assert {(r.i, r.j): r.d for r in distances.euclidean_pairs(vec, index).collect()} == {(0, 1): 5.0, (0, 2): 0.0, (1, 2): 0.0}


def test_merged_index_keeps_the_second_of_equal_names(spark):
    a, b = (spark.createDataFrame(r, "name string, idx long") for r in ([("x", 0), ("y", 1)], [("y", 0), ("z", 1)]))
    assert {r.name: r.idx for r in distances.merge_indexes(a, b).collect()} == {"x": 0, "y": 2, "z": 3}


def test_family_preparation_drops_bad_families(spark):
    rows = spark.createDataFrame([("f", 0, "n", "ACX"), ("f", 1, "m", "AC."), ("g", 0, "k", "AB")], "family string, rec int, name string, sequence string")
    got = experiments.prepare_families(rows).collect()
    assert {r.family for r in got} == {"f"} and {(r.name, r.idx, r.nogap) for r in got} == {("n", 0, "AC-"), ("m", 1, "AC")}


def test_provider_errors_become_rows(spark):
    def model(texts):
        if any("!" in t for t in texts):
            raise ValueError("bad residue")
        return [[[[float(len(t))], [1.0]]] for t in texts]

    rows = spark.createDataFrame([(0, "AA"), (1, "A!")], "id long, sequence string")
    got = {r.id: (r.x, r.error) for r in pooled(model)(rows).collect()}
    assert got[0] == ([1.5], None) and got[1] == (None, "bad residue")
    with pytest.raises(ValueError, match="no embedding provider"):
        embed(rows, "nothing")


def test_first_records_of_an_alignment(spark, tmp_path):
    (tmp_path / "m.a3m").write_text(">q\nAC-d\n>r\nAcDE\n>s\nTTTT\n")
    assert [tuple(r) for r in fasta.read_msa(spark, str(tmp_path / "m.a3m"), 2).select("header", "sequence").collect()] == [("q", "AC-"), ("r", "ADE")]


def test_pairs_of_families_correlate(spark):
    vec = spark.createDataFrame([("m", f, 0, k, [float(k + o), 0.0]) for f, o in (("p", 0), ("q", 10)) for k in range(3)], "model string, family string, layer int, idx long, x array<double>")
    place = [0, 1, 2, 10, 11, 12]
    trees_of = spark.createDataFrame([("p", "q", i, j, float(place[j] - place[i])) for i in range(6) for j in range(i + 1, 6)], "a string, b string, i long, j long, d double")
    row = experiments.interfamily_correlations(vec, spark.createDataFrame([("p", "q")], "a string, b string"), trees_of).first()
    assert (row.a, row.b, row.spearman, row.pearson) == ("p", "q", 1.0, 1.0)
    own = spark.createDataFrame([("p", i, j, float(j - i)) for i in range(3) for j in range(i + 1, 3)], "family string, i long, j long, d double")
    assert experiments.family_correlations(vec, own).first().pearson == 1.0


def test_pairs_of_one_family_are_shared_out(spark):
    rng = np.random.default_rng(3)
    x = {k: rng.normal(size=5).tolist() for k in range(60)}
    x[4], x[9], x[11] = x[5], [1.0, None, 0.0, 0.0, 0.0], [1.0]
    vec = spark.createDataFrame([("f", str(k), v) for k, v in x.items() if k != 7], "fam string, name string, x array<double>")
    index = spark.createDataFrame([("f", str(k), k) for k in range(60)] + [("g", "0", 0), ("g", "1", 1), (None, "2", 2)], "fam string, name string, idx int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        got = distances.euclidean_pairs(vec, index, ["fam"], block_rows=8).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    far = lambda i, j: 0.0 if {i, j} & {7, 9, 11} else float(np.sqrt(((np.array(x[i]) - np.array(x[j])) ** 2).sum()))
    want = {("f", i, j): far(i, j) for i in range(60) for j in range(i + 1, 60)} | {("g", 0, 1): 0.0}
    assert len(got) == len(want) and {(r.fam, r.i, r.j): r.d for r in got} == pytest.approx(want)
    assert len({r.part for r in got if r.fam == "f"}) > 1


@pytest.mark.parametrize("sent", [0, 1000])
def test_correlations_from_counted_values(spark, monkeypatch, sent):
    import pandas as pd

    monkeypatch.setattr(distances, "SENT_RANKS", sent)
    rng = np.random.default_rng(5)
    rows = [(g, float(rng.integers(0, 9)) + 1e6, float(rng.integers(0, 5))) for g in ("p", "q") for _ in range(80)]
    flat = [("flat", 0.1, float(k)) for k in range(3)] + [("one", 1.0, 2.0), ("p", None, 1.0)]
    got = {r.g: (r.spearman, r.pearson) for r in distances.correlations(spark.createDataFrame(rows + flat, "g string, a double, b double"), ["g"]).collect()}
    for g, own in pd.DataFrame(rows, columns=["g", "a", "b"]).groupby("g"):
        assert got[g] == pytest.approx((own["a"].rank().corr(own["b"].rank()), own["a"].corr(own["b"])), abs=6e-5)
    assert got["flat"] == got["one"] == (None, None)


def test_blocks_of_a_family_are_not_shuffled_for_each_other(spark):
    vec = spark.createDataFrame([("f", str(k), [float(k)]) for k in range(30)], "fam string, name string, x array<double>")
    index = spark.createDataFrame([("f", str(k), k) for k in range(30)], "fam string, name string, idx int")
    pairs = distances.euclidean_pairs(vec, index, ["fam"], block_rows=8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and pairs.count() == 435
