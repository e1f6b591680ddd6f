"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one blank, and the n-grams of 1 to 3 characters are hashed
into ``BUCKETS`` columns. Document frequencies are counted over every row that may be learned from. The model is
trained with follow-the-regularised-leader (per-coordinate steps, elastic net: L1 makes most weights exactly zero, L2
bounds the rest) on a bounded sample, ``PER_LANGUAGE`` documents of each language expected. A part of the sample that
training does not see sets the temperature by which the class scores are divided, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratigraph.session import ship

#: Columns of the hashed n-grams, longest n-gram.
BUCKETS, LONGEST = 1 << 15, 3
#: Expected documents of each language that the model is fitted on.
PER_LANGUAGE = 1500
#: FTRL: step, smoothing, L1 and L2 penalties, passes over the sample.
STEP, SMOOTH, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 2
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 32 for all else; one to one, so lengths stay."""
    table = np.full(0x10000, 32, np.uint32)
    for c in map(chr, range(0x10000)):
        if c.isalpha():
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of the n-grams of a whole text; both empty if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    beyond = points > 0xFFFF
    clean = _letters()[np.where(beyond, 32, points)]
    if beyond.any():
        clean[beyond] = [p if chr(p).isalpha() else 32 for p in points[beyond].tolist()]
    blank = clean == 32
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    clean = np.r_[np.uint32(32), clean[~(blank & np.r_[True, blank[:-1]])], np.uint32(32)]
    found, code = [], np.zeros(len(clean), np.uint32)
    for n in range(1, LONGEST + 1):
        code = code[: len(clean) - n + 1] * np.uint32(0x9E3779B1) + clean[n - 1 :] + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append(((mixed >> np.uint32(13)) & np.uint32(BUCKETS - 1)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Sublinear term counts times rarity, scaled to unit length."""
    x = (1 + np.log(counts)) * rarity[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class LanguageModel:
    """``langs[k]`` has weights ``weights[:, k]``; without languages every text with letters is unknown."""

    langs: list[str] = field(default_factory=list)
    rarity: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))
    heat: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax((weighted(at, counts, self.rarity) @ self.weights[at] + self.weights[-1]) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Leader:
    """Follow the regularised leader, proximal form, for one weight column per class."""

    def __init__(self, rows: int, classes: int) -> None:
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((SMOOTH + np.sqrt(n)) / STEP + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        now = self.weights(at)
        slope = softmax(x @ now)
        slope[label] -= 1
        g = x[:, None] * slope
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / STEP * now
        self.n[at] = more


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], rarity: np.ndarray, seed: int = 7) -> LanguageModel:
    """Train on nine rows of ten and set the temperature on the tenth (on all, if that leaves too few)."""
    bias = np.array([BUCKETS])
    data = [(np.r_[at, bias], np.r_[weighted(at, n, rarity), 1.0]) for at, n in rows]
    leader, order = Leader(BUCKETS + 1, len(langs)), np.random.default_rng(seed)
    apart = np.arange(len(data)) % 10 == 9 if len(data) >= 50 else np.zeros(len(data), bool)
    for _ in range(PASSES):
        for k in order.permutation(np.flatnonzero(~apart)):
            leader.learn(*data[k], int(labels[k]))
    weights = leader.weights(slice(None)).astype(np.float32)
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(data))
    scores = np.stack([x @ weights[at] for at, x in (data[k] for k in check)])
    loss = lambda heat: -np.log(softmax(scores / heat)[np.arange(len(check)), labels[check]] + 1e-12).mean()
    heat = min(np.geomspace(0.05, 20, 121), key=loss)
    return LanguageModel(langs, rarity.astype(np.float32), weights, float(heat))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per column that a task has seen: in how many of its documents."""
    seen = np.zeros(BUCKETS, np.int64)
    total = 0
    for batch in batches:
        for text in batch["text"]:
            at, _ = grams(text)
            seen[at] += 1
            total += 1
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"slot": np.r_[at, BUCKETS], "docs": np.r_[seen[at], total]})


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [grams(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "at": [a.astype("<i4").tobytes() for a, _ in found], "n": [n.astype("<i4").tobytes() for _, n in found]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows that are not held out and have a lang and a text with letters.

    Document frequencies cover all of them. The fitted sample takes a row if the hash of its doc_id is below a bound
    set by its language's count, so about ``per_language`` rows of each language, whatever the corpus' size. The
    driver gets column numbers and counts of the sampled rows (at most BUCKETS of each a row), no text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel()
    langs = sorted(counts)
    seen = rows.select("text").mapInPandas(_counted, "slot int, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).toPandas()
    per_slot = np.zeros(BUCKETS + 1)
    per_slot[seen["slot"]] = seen["docs"]
    rarity = np.log((1 + per_slot[-1]) / (1 + per_slot[:-1])) + 1
    bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / counts[lang]))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(bound, F.col("lang")) * (1 << 30))
    got = drawn.mapInPandas(_gathered, "doc_id long, lang string, at binary, n binary").toPandas()
    got = got[got["at"].map(len) > 0].sort_values(["doc_id", "lang", "n"]).reset_index(drop=True)
    if not len(got):
        return LanguageModel()
    grams_of = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(n, "<i4")) for a, n in zip(got["at"], got["n"], strict=True)]
    return fit(grams_of, got["lang"].map(langs.index).to_numpy(), langs, rarity)


def language_column(model: LanguageModel, text: str | Column = "text") -> Column:
    """Struct (lang_pred, score) of each whole text."""
    shared = model

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    A null text or one without a letter is ``und`` with score 0. Only the text enters a prediction. Repeated rows get
    the same result each; a null doc_id is held out; with nothing to learn from, every text is ``und``; an empty
    table gives an empty result.
    """
    model = train(docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_column(model, F.col("text").cast("string")).alias("found"))
    return marked.select("doc_id", F.coalesce(is_held_out(), F.lit(True)).alias("held_out"), "found.lang_pred", "found.score")
