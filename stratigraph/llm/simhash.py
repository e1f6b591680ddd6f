"""Near-duplicate classes by SimHash with a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most ``MAX_BITS`` = 3 bits
differ in at most three bytes, so they share at least five of the eight. A posting list for every single byte would
pair each fingerprint with a large part of the corpus, so the index merges lists three at a time: its postings are
triples of positional bytes, taken from the eight triples inside {0,1,2,3} and {4,5,6,7}. Any five positions have
three in one of those halves, so every pair that can reach the minimum count meets in a posting list. There the
shared positional bytes are tallied, pairs below five are dropped and the rest are verified on the differing bits.

Skew: equal fingerprints are collapsed before indexing, so exact copies cost one posting. A posting list of more
than ``BLOCK`` different fingerprints is split by two more positional bytes; what is still longer is dealt into blocks and
every two blocks meet in a group of their own, so no task holds more than two blocks. From each group only a spanning forest of its links is returned (fewer rows than
it has fingerprints), which keeps every component exactly without writing out the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratigraph.llm.names import own_columns, spare
from stratigraph.llm.shingles import mark_column, near_classes
from stratigraph.operators.components import connected_components
from stratigraph.session import ship
from stratigraph.storage import discard, materialize

#: Words in a shingle, seed of its hash, most differing bits of a link.
WORDS, SEED, MAX_BITS = 3, 42, 3
#: Least number of positional bytes that two linked fingerprints share.
LEAST_BYTES = 8 - MAX_BITS
#: Positional bytes that make up a posting key.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Most different fingerprints that one block of a posting list holds.
BLOCK = 2048
#: Most rows of documents that go which the near-duplicate stage sends to every executor.
SENT_ROWS = 1_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the whole text as an unsigned number.

    ASCII letters are lower-cased, words are maximal runs without ASCII white space, shingles are ``words`` words
    joined by a space, repeats included. A text of fewer words has one shingle, all of them; null, empty and blank
    texts have none and get zero.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def fingerprint_column(text: str | Column) -> Column:
    """The fingerprint as a signed long with the same bits."""
    return _fingerprint_udf(text)


def _near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` share enough positional bytes with ``one`` and, verified, differ in few bits."""
    gap = np.bitwise_xor(one, many)
    shared = (gap.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_BYTES
    shared[shared] = np.bitwise_count(gap[shared]) <= MAX_BITS
    return shared


def spanning_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that join whatever links of ``prints`` join: breadth first, each print reached once."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(prints))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _near(prints[at], prints[left])
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return links


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the posting groups of a partition, which come sorted by group; a group may span batches."""
    keys, kept = ["key", "block_a", "block_b"], None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.zeros(0, bool)
        cut = len(rows) - int(last[::-1].argmin()) if len(rows) and not last.all() else 0
        kept = rows.iloc[cut:]
        yield _links_of(rows.iloc[:cut])
    if kept is not None:
        yield _links_of(kept)


def _links_of(rows: pd.DataFrame) -> pd.DataFrame:
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    if len(rows) > 1:
        group = rows[["key", "block_a", "block_b"]].to_numpy()
        prints, reps = rows["print"].to_numpy(np.int64).view(np.uint64), rows["rep"].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        pairs = starts[sizes == 2]
        hit = pairs[_near(prints[pairs], prints[pairs + 1])]
        out.append(np.stack([reps[hit], reps[hit + 1]], 1))
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if found := spanning_links(prints[at : at + n]):
                out.append(reps[at : at + n][np.array(found)])
    return pd.DataFrame(np.concatenate(out), columns=["u", "v"])


def _postings(prints: DataFrame) -> DataFrame:
    """(key, block_a, block_b, print, rep): each fingerprint under its eight triples of positional bytes.

    Linked members of a triple's list share two more positional bytes at least, so a list of more than ``BLOCK`` is split
    by each two of the other five. Blocks remain for what is still longer: fingerprints that differ in three bytes only.
    """
    byte = lambda p: F.shiftright("print", 8 * p).bitwiseAND(F.lit(255))
    listed = lambda rows: rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    triple = lambda t, at: F.struct(F.lit(t).alias("t"), (F.lit(t << 24).cast("long") + byte(at[0]) * 65536 + byte(at[1]) * 256 + byte(at[2])).alias("key"))
    single = listed(prints.select("print", "rep", F.inline(F.array(*[triple(t, at) for t, at in enumerate(TRIPLES)]))))
    further = None
    for t, at in enumerate(TRIPLES):
        own = F.array(*[F.xxhash64(F.lit(p), F.lit(q), "key", byte(p), byte(q)) for p, q in combinations([p for p in range(8) if p not in at], 2)])
        further = F.when(F.col("t") == t, own) if further is None else further.when(F.col("t") == t, own)
    split = listed(single.where(F.col("n") > BLOCK).select("print", "rep", F.explode(further).alias("key")))
    posted = single.where(F.col("n") <= BLOCK).select("key", "print", "rep", "n").union(split.select("key", "print", "rep", "n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    meet = F.when(F.col("n") <= BLOCK, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    )
    dealt = posted.select("key", "print", "rep", F.explode(meet).alias("meet")).select("key", F.col("meet.a").alias("block_a"), F.col("meet.b").alias("block_b"), "print", "rep")
    return dealt.repartition("key", "block_a", "block_b").sortWithinPartitions("key", "block_a", "block_b", "print")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose fingerprints are linked directly or over others.

    Returns one row per input row: doc_id, print (long), fingerprint (16 hex digits), component_id (least doc_id
    that can be reached, its own included). Null texts count as empty; texts without words share fingerprint zero
    and are linked. Repeated rows are returned as often as they come. A null doc_id sorts below all others: a class
    that holds one has component_id null. An empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)
    signed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col).cast("string")).alias("print")), "simhash")
    lowest = F.lit(-(2**63)).cast("long")
    prints = materialize(signed.groupBy("print").agg(F.min(F.coalesce("doc_id", lowest)).alias("rep")), "simhash")
    links = _postings(prints).mapInPandas(_forest, "u long, v long")
    parts = connected_components(links)
    classes = materialize(prints.join(parts, prints["rep"] == parts["node"], "left").select("print", F.coalesce("component", "rep").alias("component")), "simhash")
    return signed.join(classes, "print").select(
        "doc_id",
        "print",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != lowest, F.col("component")).alias("component_id"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near texts (see ``shingles``) the least in doc_id, once.

    This is not op3's contract of three-word shingles and three bits: texts are near at 0.8 of their five-word shingles.
    All columns are kept as they are. Texts are linked, not ids: rows of equal or null doc_id belong together only if
    their texts are near. A null doc_id sorts below all others. Texts without words are equal. Rows that equal the one
    that stays in doc_id and words leave one row. Between rows of one least doc_id the hashes of the texts decide.

    What goes is written and counted. Up to ``SENT_ROWS`` rows of it are sent to the documents, whose texts then are
    not shuffled; beyond that both sides are dealt by document.
    """
    ship(docs.sparkSession)
    rid = lambda: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    marks = materialize(docs.select("doc_id", rid().alias("rid"), mark_column(F.col("text").cast("string")).alias("mark")).select("doc_id", "rid", "mark.*"), "simhash")
    parts = near_classes(marks, texts, rid)
    rows = marks.groupBy("doc_id", "rid", "node").agg(F.count(F.lit(1)).alias("n"))
    named = materialize(rows.join(parts, "node", "left").withColumn("class", F.coalesce("component", "node")), "simhash")
    # written, so that both sides of the join come straight from a table and Spark can split a large class
    firsts = materialize(named.groupBy("class").agg(F.min(F.struct("doc_id", "node", "rid")).alias("least"), F.sum("n").alias("all")).where("all > 1"), "simhash")
    met = named.join(firsts, "class")
    one, own, kept = spare(docs, "id", "rid", "stays")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("rid") == F.col("least.rid"))
    gone = materialize(met.select(F.col("doc_id").alias(one), F.col("rid").alias(own), "n", stays.alias(kept)).where(f"n > 1 OR NOT {kept}").drop("n"), "simhash")
    for used in (marks, named, firsts):
        discard(used)
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone.hint("shuffle_hash")
    told = docs.join(gone, docs["doc_id"].eqNullSafe(gone[one]) & (rid() == gone[own]), "left")
    # rows that stay and come more than once: the only ones that are grouped
    twice = told.where(kept).dropDuplicates([one, own])
    return told.where(f"{kept} IS NULL").select(*own_columns(docs)).union(twice.select(*own_columns(docs)))
