"""Classes of texts whose five-word shingles are alike: the near-duplicate stage of the pipeline.

Two texts are near if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Operator 3's
contract, three bits of 64, is far stricter, and its guarantee cannot be stretched to 0.8: there every bit of a plain
SimHash differs with probability 0.15, so a whole byte is equal with 0.27 only, and eight bytes guarantee nothing.
The fingerprint is therefore longer and its bytes steadier: byte k is the SimHash byte of a sample of the shingles, the
one that is least in the k-th order. Two texts agree in it with at least their similarity.

The rest is operator 3's. ``BYTES`` positional bytes are indexed, ``MERGED`` lists at a time; a pair at 0.8 shares none
of the ``BYTES / MERGED`` merged lists with probability (1 - 0.8**5)**36, about 6e-7. In a list the shared positional
bytes are tallied; pairs below ``LEAST_BYTES`` (a pair at 0.8 is with 2e-7) are dropped, the others are verified on
their whole shingle sets. ``lists`` describes how members meet and what becomes of long lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratigraph.llm.lists import list_classes
from stratigraph.storage import discard, materialize

#: Words in a shingle, seed of its hash, least similarity as a fraction.
WORDS, SEED, SIMILAR = 5, 42, (4, 5)
#: Positional bytes of a fingerprint, bytes that a merged list covers, least number that two near texts share.
BYTES, MERGED, LEAST_BYTES = 180, 5, 117
#: Most nodes that are sent to the texts; beyond, the texts are dealt by node.
SENT_NODES = 2_000_000
_TURNS = np.random.default_rng(SEED).integers(0, 2**63, (2, BYTES), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _hashes(tokens: list[bytes]) -> np.ndarray:
    shingles = [b" ".join(tokens)] if len(tokens) <= WORDS else map(b" ".join, zip(*(tokens[k:] for k in range(WORDS)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)) if tokens else np.zeros(0, np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Different hashed shingles of the whole text; one of all its words if these are fewer, none if there are none."""
    return _hashes(_tokens(text))


def near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of hashed shingles have the similarity."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(one) + len(other) - both)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The positional bytes of a set of hashed shingles; none for a text without words."""
    if not len(hashes):
        return b""
    least = np.full(BYTES, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, k : k + 4096] * _TURNS[0][:, None] + _TURNS[1][:, None]).min(1))
    return (least * _MIX >> np.uint64(56)).astype(np.uint8).tobytes()


MARK = T.StructType([T.StructField("node", T.LongType()), T.StructField("print", T.BinaryType())])


@F.pandas_udf(MARK)
def _mark_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        nodes, prints = [], []
        for text in batch:
            tokens = _tokens(text)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(tokens), SEED))
            prints.append(fingerprint(_hashes(tokens)))
        yield pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "print": prints})


@F.pandas_udf(T.BinaryType())
def _set_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingle_hashes(t).tobytes() for t in batch], dtype=object)


def mark_column(text: str | Column) -> Column:
    """(node, print): the hash of a text's words, by which texts of equal words are one, and its fingerprint."""
    return _mark_udf(text)


def match(group: dict[str, np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Tally of shared positional bytes, then the sets of those that reach the least number."""
    prints = np.frombuffer(b"".join(group["print"]), np.uint8).reshape(len(group["print"]), BYTES)
    sets: dict[int, np.ndarray] = {}

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = np.frombuffer(group["hashes"][k], np.uint64)
        return sets[k]

    def near_to(one: int, others: np.ndarray) -> np.ndarray:
        out = (prints[others] == prints[one]).sum(1) >= LEAST_BYTES
        if out.any():
            mine = own(one)
            both = np.array([np.count_nonzero(mine[np.minimum(np.searchsorted(mine, x), len(mine) - 1)] == x) for x in map(own, others[out])])
            sizes = np.array([len(own(k)) for k in others[out]])
            out[out] = SIMILAR[1] * both >= SIMILAR[0] * (len(mine) + sizes - both)
        return out

    return near_to


def near_classes(marks: DataFrame, texts: DataFrame, rid: Callable[[], Column]) -> DataFrame:
    """(node, component) of the nodes of ``marks (rid, node, print)`` that are linked to another.

    ``texts (text)`` are those that the marks were made of; ``rid()`` is the number of a row's text, by which a mark
    finds one of them.
    """
    prints = materialize(marks.groupBy("node").agg(F.first("print").alias("print"), F.min("rid").alias("rid")), "prints")
    part = lambda k: F.xxhash64(F.lit(k), F.substring("print", 1 + k * MERGED, MERGED))
    keys = F.explode(F.array(*[part(k) for k in range(BYTES // MERGED)]))
    listed = materialize(prints.where(F.octet_length("print") > 0).select(keys.alias("key"), "node"), "lists")

    def payload(nodes: DataFrame) -> DataFrame:
        wanted = materialize(prints.join(nodes, "node"), "prints")
        wanted = F.broadcast(wanted) if wanted.count() <= SENT_NODES else wanted.hint("shuffle_hash")
        found = texts.select(rid().alias("rid"), "text").join(wanted.select("rid", "node"), "rid").select("node", _set_udf("text").alias("hashes"))
        return found.dropDuplicates(["node"]).join(prints.select("node", "print"), "node")

    out = list_classes(listed, payload, match)
    for used in (prints, listed):
        discard(used)
    return out
