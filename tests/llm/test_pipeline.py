"""The pipeline against its rules applied plainly, stage by stage."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import plain_near_classes, plain_overlap, prose

DIR = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, DIR).cache()
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and all(before[i] == t for i, t in kept.items())
    assert sum((i in kept) == bool(q) for i, q in labels.items()) / len(labels) > 0.9

    lean = stages["line_dedup"](spark, good, DIR).cache()
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in kept.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    drop = lambda i, line: len(holders[key(line)]) >= 3 and i != max(holders[key(line)])
    want = {i: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 20 and drop(i, x))) for i, t in kept.items()}
    rows = lean.collect()
    assert {r.doc_id: r.text for r in rows} == want and lean.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows)

    single = stages["near_duplicates"](spark, lean, DIR).cache()
    classes = plain_near_classes(want)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    clean = stages["decontamination"](spark, single, DIR).cache()
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    stay = {r.doc_id: r.text for r in clean.collect()}
    for r in single.collect():
        assert (r.doc_id not in stay) == any(plain_overlap(r.text, t)[1] for t in items if set(re.findall(r"\w+", t.lower())) & set(re.findall(r"\w+", r.text.lower())))

    packed = corpus_pipeline.run(spark, DIR).collect()
    assert {p.doc_id for p in packed} == set(stay)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], COLUMNS)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, clashing extra columns."""
    rng = random.Random(14)
    long, one, two = prose(rng, 30_000), prose(rng, 70), prose(rng, 70)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\n ", "en", None, 4), (4, one, None, "a", len(one)), (4, one, None, "a", len(one)), (4, two, "en", "b", len(two)), (None, prose(rng, 80), "de", "b", None), (None, prose(rng, 80), "de", "b", 1), (5, long, "en", "a", len(long)), (6, one + " ", "en", "a", len(one) + 1)]
    extra = ("node", "rid", "mark", "print", "key", "n", "__id", "__hit", "component", "score", "bitmap", "seed", "least")
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(k).cast("string") for k, c in enumerate(extra)})
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    before = plain(docs)
    for name in ("quality", "line_dedup", "near_duplicates", "decontamination"):
        out = stages[name](spark, docs, DIR)
        assert out.columns == docs.columns and not plain(out) - before
        if name in ("line_dedup", "decontamination"):
            assert plain(out) == before
    assert plain(stages["near_duplicates"](spark, docs, DIR)) == Counter([(1, None, None), (4, one, "a"), (4, two, "b"), *((r[0], r[1], r[3]) for r in rows[6:9])])
    pieces = stages["packing"](spark, docs, DIR).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r[0] for r in rows)
