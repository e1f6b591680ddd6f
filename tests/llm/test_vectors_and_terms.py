"""Vector codes, exact top-k and source divergence against plain versions, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratigraph.llm import codes, divergence, topk

VECTORS = "vec_id long, embedding array<float>, label int"
TEXTS = "doc_id long, text string, lang string, source string"


def extra(df, *names):
    return df.withColumns({c: F.lit(c) for c in names})


# vector codes
def lloyd(rows, parts=4, entries=256, rounds=4):
    """The contract, one vector at a time."""
    kept = [(i, x, label) for i, x, label in rows if x is not None and all(v is not None and isfinite(v) for v in x)]
    ints = [[floor(1024 * v) for v in x] for _, x, _ in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(v[p], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            members = defaultdict(list)
            for v, o in zip(cut, own, strict=True):
                members[o[p][1]].append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(books[p])]
    own = assign()
    errors = [sum(d for d, _ in o) for o in own]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in o), e, by_label[label], sha) for (i, _, label), o, e in zip(kept, own, errors, strict=True))


def some_vectors(n, width=8, seed=3):
    rng = random.Random(seed)
    rows = [(k, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(10, n)]
    rows += [rows[5]] * 7 + [(rows[5][0], rows[6][1], 2)]  # repeated rows, one id with two vectors
    rows += [(k, rows[8][1], 1) for k in range(1000, 1400)]  # one very common vector
    rows += [(0, None, 1), (1, [float("nan")] * width, 1), (2, [float("inf")] + [0.0] * (width - 1), 1), (3, [None] + [0.0] * (width - 1), None), (4, [float("-inf")] * width, 2)]
    return rows + [(None, [0.5] * width, None), (5, [0.0] * width, None)]


@pytest.mark.parametrize("sent", [200_000, -1])
def test_vector_codes_equal_plain_lloyd(spark, monkeypatch, sent):
    monkeypatch.setattr(codes, "SENT_LABELS", sent)
    rows = some_vectors(400)
    df = extra(spark.createDataFrame(rows, VECTORS).repartition(5), "x", "now", "error", "of_", "salt_", "share", "code")
    assert Counter(tuple(r) for r in codes.vector_codes(df).collect()) == lloyd(rows)


def test_fewer_vectors_than_entries(spark):
    rows = some_vectors(30)[:20]
    assert Counter(tuple(r) for r in codes.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()) == lloyd(rows)


def test_vector_codes_of_nothing(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0


def test_vectors_of_unequal_length_are_refused(spark):
    with pytest.raises(ValueError, match="components"):
        codes.vector_codes(spark.createDataFrame([(1, [0.1] * 8, 1), (2, [0.1] * 4, 1)], VECTORS))


def test_distances_are_exact_beyond_floats():
    x, c = np.array([[codes.LIMIT - 1, -codes.LIMIT + 1]] * 2), np.array([[-codes.LIMIT + 1, codes.LIMIT - 2]])
    assert codes._squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0], strict=True))]] * 2


def test_only_changes_are_shuffled(spark):
    """A second round over the same codebooks contributes nothing."""
    df = spark.createDataFrame([(k, [k % 7, k % 3, k % 5, k % 2], [-1, -1], [-1, -1], 0) for k in range(50)], "vec_id long, x array<int>, now array<short>, before array<short>, error long")
    books = [np.array([[0, 0], [6, 2]]), np.array([[0, 0], [4, 1]])]
    once = codes._assigned(df, books)
    assert sum(r["sums"][0] for r in codes._changes(once, books).collect()) == 100
    assert codes._changes(codes._assigned(once, books), books).count() == 0


# exact top-k
def plain_top(rows, queries, k):
    held = sorted({(i, tuple(x)) for i, x in rows if i is not None})
    out = Counter()
    for q, v in {(i, tuple(x)) for i, x in queries if i is not None}:
        dot = lambda x, v=v: sum(a * b for a, b in zip(x, v, strict=False))
        found = sorted((-dot(x), i) for i, x in held if i != q)[:k]
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(found))
    return out


def int_vectors(n, kind, seed=5):
    rng = random.Random(seed)
    value = {"dense": lambda: rng.randint(-90, 90), "sparse": lambda: rng.choice([0] * 9 + [rng.randint(-60, 60)]), "negative": lambda: rng.randint(-30, -1), "ties": lambda: rng.randint(0, 1)}[kind]
    rows = [(k, [value() for _ in range(12)]) for k in range(n)]
    return rows + [(7, rows[9][1])] + [rows[4]] * 5 + [(None, rows[3][1]), (n + 1, []), (n + 2, [5])] + [(n + 10 + k, rows[2][1]) for k in range(60)]


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative", "ties"])
def test_max_score_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    rows = int_vectors(300, kind)
    queries = [r for r in rows if r[0] is None or r[0] % 7 == 0] + [(5, [-x for x in rows[5][1]])]
    made = lambda r: extra(spark.createDataFrame(r, "vec_id long, x array<long>"), "floor", "block", "shard", "copy", "score")
    got = topk.max_score(made(queries), made(rows), 5)
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows, queries, 5)


def test_low_bounds_are_not_traversed():
    """Rows that only non-essential terms hold are left alone, and the result is right."""
    x = np.array([[9, 0, 1], [0, 3, 0], [0, 0, 3], [8, 1, 0]])
    shard = topk.Shard(np.arange(4), x)
    ids, score = shard.best(-1, np.array([10, 1, 1]), 2, 50)
    assert (ids.tolist(), score.tolist()) == ([0, 3], [91, 81])


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [0.5, -0.25], 1), (50, [1.0, 1.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (100, [None, 1.0], 1)], VECTORS)
    assert sorted(tuple(r) for r in topk.top_vectors(df).collect()) == [(0, 1, 50, 128 * 256 - 64 * 256), (50, 1, 0, 128 * 256 - 64 * 256)]
    assert topk.top_vectors(df.limit(0)).count() == 0


# source divergence
def plain_divergence(rows, min_docs=10, top=10):
    docs, count, groups = defaultdict(set), Counter(), defaultdict(set)
    for doc, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
            t = re.sub("[A-Z]", lambda m: m.group().lower(), t)
            docs[lang, t].add((source, doc))
            count[lang, source, t] += 1
    out = Counter()
    for lang, sources in groups.items():
        kept = sorted((t for la, t in docs if la == lang and len(docs[la, t]) >= min_docs), key=lambda t: t.encode())
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, total, v=len(kept): 1 + 10**9 * (c + 2) // (total + 2 * v)
        p = {s: {t: share(count[lang, s, t], n[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for r, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or r < top:
                        out[lang, s, part, item, v, r + 1] += 1
    return out


def some_texts(seed=8):
    rng = random.Random(seed)
    words = ["river", "Stone", "ÄRGER", "ärger", "İ", "K", "naïve", "a", "B", "\U0001d518\U0001d52b", "日本", "x\x00y", "it's", "tab\tend", "co op"] + [f"w{chr(97 + k)}" for k in range(26)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", "7", "-Z"]) for _ in range(n))
    rows = [(rng.choice([k, k - 10**13, k * 10**9]), text(rng.randint(0, 30)), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 4 + ["s1", "s2", "S1", None, "é"])) for k in range(400)]
    rows += [rows[3]] * 12 + [(None, text(9), "en", "hot"), (None, text(9), "en", "hot"), (900, None, "en", "void"), (901, "", "fr", "one"), (902, "12 34", "fr", "two"), (903, "solo solo", "it", "one")]
    return rows + [(2000 + k, "river", "en", f"s{k % 9}") for k in range(50)] + [(3000, text(60_000), "de", "long"), (3001, "ß" * 200_000, "de", "long"), (-(1 << 62), "river stone", "en", "s1")]


def test_divergence_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_ROWS", 11)
    rows = some_texts()
    df = extra(spark.createDataFrame(rows, TEXTS).repartition(6), "doc", "term", "n", "df", "kept", "shard", "span", "part", "value")
    assert Counter(tuple(r) for r in divergence.source_divergence(df).collect()) == plain_divergence(rows)


def test_divergence_of_large_terms_sets_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SENT_TERMS", -1)
    rows = some_texts(9)
    assert Counter(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, TEXTS), 4, 3).collect()) == plain_divergence(rows, 4, 3)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], TEXTS)).count() == 0


def test_small_blocks_and_batches_give_the_same_runs(monkeypatch):
    """Postings of many blocks, cut into batches of three rows, sum up to the postings of one block."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BLOCK_BYTES", 500)
    rows = [(d or 0, t or "", la or "", s or "") for d, t, la, s in some_texts() if len(t or "") < 1000]
    batch = pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("doc", "text", "lang", "source"))})
    postings = pa.Table.from_batches(divergence._posted(iter([batch]))).sort_by([(c, "ascending") for c in ("lang", "term", "source", "first")])
    found = Counter()
    for run in divergence._run_lengths(iter(postings.to_batches(max_chunksize=3))):
        for lang, term, source, df, n in zip(*(c.to_pylist() for c in run.columns), strict=True):
            found[lang, term, source, "df"] += df
            found[lang, term, source, "n"] += n
    want, docs = Counter(), set()
    for doc, text, lang, source in rows:
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text):
            t = re.sub("[A-Z]", lambda m: m.group().lower(), t)
            want[lang, t, source, "n"] += 1
            docs.add((lang, t, source, doc))
    want.update((la, t, s, "df") for la, t, s, _ in docs)
    assert found == want


def test_shares_of_large_counts_are_exact():
    count = np.array([0, 5, 10**15])
    assert divergence.shares(count, 10**15 + 5, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**15 + 5 + 6) for c in count]


def test_a_block_of_postings_takes_less_than_sixteen_times_its_text():
    import tracemalloc

    from stratigraph.llm.divergence import _postings

    rng = np.random.default_rng(0)
    letters = str.maketrans("0123456789", "abcdefghij")
    words = np.array([f"w{k}".translate(letters).encode() for k in range(20_000)])
    texts = [b" ".join(words[rng.integers(0, 20_000, 300)].tolist()) for _ in range(2000)]
    tracemalloc.start()
    _postings(texts, np.arange(2000), [("a", f"s{k % 5}") for k in range(2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(map(len, texts))
