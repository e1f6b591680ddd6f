"""Divergence of the sources of each language, from sorted postings of terms.

1. A map task reads blocks of whole texts and writes one posting for every (lang, term, source) of a block: how often
   the term occurs there and in which documents. So what is shuffled is pre-aggregated, and a source that holds a third
   of all rows costs a block's vocabulary, not its words.
2. Postings are dealt by (lang, term, span of documents) and sorted inside a partition by (lang, term, source, first
   document). A scan over that order closes a run at each new source and gives its document frequency and count. A span
   is ``SPAN`` consecutive document ids, so the run of a word that every document holds is split over tasks, and rows
   that share an id always meet. The runs of different spans are summed.
3. Kept terms are dealt by (lang, shard of terms) behind a header of the language's sources. A second scan holds a block
   of terms by sources at a time and gives, for a shard, partial sums of all pairs of sources and each source's best terms.

Nothing is sent to the driver but counts. Numbers are integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.session import ship
from stratigraph.storage import discard, materialize

#: Least documents of a language that hold a kept term; terms that a source reports.
MIN_DOCS, TOP = 10, 10
#: Scale of a share, and what is added to every count.
SCALE, PRIOR = 1_000_000_000, 2
#: Document ids of one span.
SPAN = 1 << 20
#: Bytes of text that a task gathers before it writes postings.
BLOCK_BYTES = 32 << 20
#: Rows of a shard of kept terms, and cells (terms by sources) of a block in it.
SHARD_ROWS, CELLS = 200_000, 2_000_000
#: Most rows of terms or languages that are sent to all tasks.
SENT_TERMS = 200_000
#: Every byte that is no part of a term becomes a blank; A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

POSTINGS = "lang string, term string, source string, first long, more binary, n int"
RUNS = "lang string, term string, source string, df long, n long"
FOUND = "lang string, source string, part string, item string, value long"


def _binary(starts: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array of the pieces of ``data`` (bytes) that begin at ``starts``; its last entry is the end."""
    return pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _postings(texts: list[bytes], docs: np.ndarray, groups: list[tuple[str, str]]) -> pa.RecordBatch | None:
    """One row for every (group, span, term) of a block of folded texts."""
    # what a block needs in between is let go as soon as may be: it is several times the block's text
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    words = _binary(np.r_[0, np.cumsum(ends - starts)], data[inside], pa.string()).dictionary_encode()
    del data, inside, ends
    numbers = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    group = np.fromiter((numbers[g] for g in groups), np.int64, len(groups))
    text_of = np.searchsorted(np.cumsum(sizes + 1), starts, "right").astype(np.int32)
    del edges, starts
    at = np.lexsort((docs, group))  # texts by group and document; a text's place stands for both
    place = np.empty(len(at), np.int32)
    place[at] = np.arange(len(at))
    span = docs // SPAN
    breaks = np.r_[True, (group[at][1:] != group[at][:-1]) | (span[at][1:] != span[at][:-1])]
    lot = np.cumsum(breaks) - 1  # (group, span) of a place
    # sorted by lot, word and place; an occurrence is one long
    where = place[text_of]
    del text_of
    key = lot[where]
    key *= len(words.dictionary)
    key += words.indices.to_numpy()
    key *= len(texts)
    key += where
    del where
    key.sort()
    differs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[differs, len(key)])
    run, where = np.divmod(key[differs], len(texts))
    del key, differs
    doc = docs[at][where]
    heads = np.r_[True, run[1:] != run[:-1]]
    head = np.flatnonzero(heads)
    first, size = doc[head], np.diff(np.r_[head, len(doc)])
    more = (doc - np.repeat(first, size))[~heads].astype("<i4")  # documents behind the first
    code, text_at = run[head] % len(words.dictionary), at[where[head]]
    lang, source = (pa.array([g[c] for g in numbers], pa.string()).take(pa.array(group[text_at])) for c in (0, 1))
    return pa.RecordBatch.from_arrays(
        [lang, words.dictionary.take(pa.array(code)), source, pa.array(first), _binary(4 * np.r_[0, np.cumsum(size - 1)], more.view(np.uint8), pa.binary()), pa.array(np.add.reduceat(count, head).astype(np.int32))],
        names=["lang", "term", "source", "first", "more", "n"],
    )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[bytes] = []
    docs: list[int] = []
    groups: list[tuple[str, str]] = []
    held = 0
    for batch in batches:
        columns = [batch.column("text").cast(pa.binary()), *(batch.column(c) for c in ("doc", "lang", "source"))]
        for text, doc, lang, source in zip(*(c.to_pylist() for c in columns), strict=True):
            texts.append(text.translate(_FOLD))
            docs.append(doc)
            groups.append((lang, source))
            held += len(texts[-1]) + 64
            if held >= BLOCK_BYTES:
                yield from filter(None, [_postings(texts, np.array(docs, np.int64), groups)])
                texts, docs, groups, held = [], [], [], 0
    if texts:
        yield from filter(None, [_postings(texts, np.array(docs, np.int64), groups)])


def _changes(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Places, from 1, whose value of any of ``names`` differs from the row before."""
    differs = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        column = batch.column(name)
        differs |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def _whole_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal ``names`` ends, with the places where runs begin."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and all(kept[0].column(c)[0].as_py() == batch.column(c)[batch.num_rows - 1].as_py() for c in names):
            kept.append(batch)  # a run that fills more than a batch
            continue
        whole = pa.concat_batches([*kept, batch])
        starts = np.r_[0, _changes(whole, names)]
        if starts[-1]:
            yield whole.slice(0, int(starts[-1])), starts[:-1]
        kept = [whole.slice(int(starts[-1]))]
    if kept:
        whole = pa.concat_batches(kept)
        yield whole, np.r_[0, _changes(whole, names)]


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, df, n) of every run of one source in sorted postings."""
    spanned = (b.append_column("span", pa.array(b.column("first").to_numpy() // SPAN)) for b in batches)
    for rows, starts in _whole_runs(spanned, ("lang", "term", "source", "span")):
        size = np.diff(np.r_[starts, rows.num_rows])
        first, lengths = rows.column("first").to_numpy() % SPAN, pa.compute.binary_length(rows.column("more")).to_numpy() // 4
        more = np.frombuffer(b"".join(rows.column("more").to_pylist()), "<i4")
        of = np.repeat(np.arange(len(starts)), size)
        doc, run = np.r_[first, more + np.repeat(first, lengths)], np.r_[of, np.repeat(of, lengths)]
        df = np.bincount(np.unique(run * SPAN + doc) // SPAN, minlength=len(starts))  # a document counts once
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [rows.column("lang").take(at), rows.column("term").take(at), rows.column("source").take(at), pa.array(df.astype(np.int64)), pa.array(np.add.reduceat(rows.column("n").to_numpy().astype(np.int64), starts))],
            names=["lang", "term", "source", "df", "n"],
        )


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact for counts of any size."""
    wide = count if count.max(initial=0) < 9_000_000_000 else count.astype(object)
    return (1 + SCALE * (wide + PRIOR) // (total + PRIOR * terms)).astype(np.int64)


def _parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Shard:
    """Sums of one (lang, shard): ``sources`` with their totals, pairs so far, best terms so far."""

    def __init__(self, lang: str, header: pa.RecordBatch, top: int) -> None:
        self.lang, self.top = lang, top
        self.sources, self.totals = header.column("source").to_pylist(), header.column("n").to_numpy()
        self.terms = int(header.column("kept")[0].as_py())
        self.pairs = np.zeros((len(self.sources),) * 2, np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in self.sources]

    def add(self, names: list[str], count: np.ndarray) -> None:
        """``count`` has a row a term and a column a source."""
        p = np.stack([shares(count[:, s], int(n), self.terms) for s, n in enumerate(self.totals)], 1)
        q = shares(count.sum(1), int(self.totals.sum()), self.terms)
        for s in range(len(self.sources)):
            self.pairs[s, s + 1 :] += _parted(p[:, s : s + 1], p[:, s + 1 :]).sum(0)
            more = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
            value = _parted(p[more, s], q[more])
            if len(more) > self.top:
                edge = np.partition(value, len(value) - self.top)[-self.top]
                more, value = more[value >= edge], value[value >= edge]
            self.best[s] = sorted([*self.best[s], *((-int(v), names[k]) for k, v in zip(more, value, strict=True))])[: self.top]

    def result(self) -> pa.RecordBatch:
        a, b = np.triu_indices(len(self.sources), 1)
        name = np.array(self.sources, dtype=object)
        best = [(name[s], term, -v) for s, found in enumerate(self.best) for v, term in found]
        columns = [[*name[a], *(x[0] for x in best)], ["pair"] * len(a) + ["term"] * len(best), [*name[b], *(x[1] for x in best)]]
        value = np.r_[self.pairs[a, b], np.array([x[2] for x in best], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(value), pa.string()), *(pa.array(c, pa.string()) for c in columns), pa.array(value)], names=["lang", "source", "part", "item", "value"])


def _scanned(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Partial pairs and terms of every shard; rows with ``kept`` are the header of a shard and come first."""
    at, shard, header = None, None, []
    held: list[tuple[str, np.ndarray, np.ndarray]] = []

    def block() -> None:
        count = np.zeros((len(held), len(shard.sources)), np.int64)
        for k, (_, places, n) in enumerate(held):
            count[k, places] = n
        shard.add([x[0] for x in held], count)
        held.clear()

    for rows, starts in _whole_runs(batches, ("lang", "shard", "term")):
        terms = rows.column("term").to_pylist()
        for low, high in zip(starts, np.r_[starts[1:], rows.num_rows], strict=True):
            key = (rows.column("lang")[int(low)].as_py(), rows.column("shard")[int(low)].as_py())
            part = rows.slice(int(low), int(high - low))
            if key != at:
                if shard:
                    block()
                    yield shard.result()
                at, shard, header = key, _Shard(key[0], part, top), {s: k for k, s in enumerate(part.column("source").to_pylist())}
                continue
            held.append((terms[low], np.array([header[s] for s in part.column("source").to_pylist()]), part.column("n").to_numpy()))
            if len(held) * len(shard.sources) >= CELLS:
                block()
    if shard:
        block()
        yield shard.result()


def _sent(df: DataFrame) -> DataFrame:
    """``df``, sent to all tasks of its next join if it has at most ``SENT_TERMS`` rows."""
    return F.broadcast(df) if df.count() <= SENT_TERMS else df


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n) of the terms in at least ``min_docs`` documents of a language; ``docs`` has no nulls."""
    ship(docs.sparkSession)
    postings = docs.mapInArrow(_posted, POSTINGS).repartition("lang", "term", F.floor(F.col("first") / SPAN))
    runs = materialize(postings.sortWithinPartitions("lang", "term", "source", "first").mapInArrow(_run_lengths, RUNS), "runs")
    kept = materialize(runs.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs).select("lang", "term"), "runs")
    counts = runs.join(_sent(kept), ["lang", "term"])
    counts = materialize(counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")), "runs")
    discard(runs)
    discard(kept)
    return counts


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` kept terms that the source
    holds more of than its language. Ranks go by falling value, equal values by item in UTF-8 order.

    Null text, lang and source are read as empty. A term is a run of letters A-Z, a-z and characters beyond ASCII. Rows
    of one language and source that share a doc_id are one document, a null doc_id being an id like others; repeated
    rows therefore add to counts but not to document frequencies. Sources without terms count. A language of one source
    has no pairs; without kept terms all values of its pairs are 0. An empty table gives an empty result. Only the
    columns doc_id, text, lang and source are read.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), read("lang"), read("source"), read("text"))
    counts = term_counts(rows, min_docs)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = _sent(materialize(counts.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards")), "runs"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    header = groups.select("lang", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"), F.lit("").alias("term"), "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    lines = counts.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term", "source", "n", F.lit(None).cast("long").alias("kept"))
    dealt = header.union(lines).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term", "source")
    parts = materialize(dealt.mapInArrow(lambda batches: _scanned(batches, top), FOUND), "runs")
    found = parts.where("part = 'term'").union(_both_ways(parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
