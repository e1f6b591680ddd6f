"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned counts (letters, capitals, marks, repeats, ...) of the line and of
its two neighbours; a chain of transition weights links the lines. Labels exist for documents only, so the field is
fitted twice: first every line has its document's label, then the lines of bad documents that the first field finds
less than half as bad as the worst one are relabelled as good. A document's quality is the length-weighted mean of the lines' forward-backward marginals,
mapped to a probability by a logistic curve fitted on the same rows.

Only a bounded sample of labelled documents is fitted (``PER_CLASS`` of each label); all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.names import spare
from stratigraph.session import ship

#: Most labelled documents of each label that the field is fitted on.
PER_CLASS = 2000
#: Documents with a score from here on are good.
THRESHOLD = 0.3
#: Upper ends of the bins of each count of a line.
BINS = {
    "length": (1, 20, 60, 150, 400),
    "words": (1, 3, 8, 20, 60),
    "word_length": (2.5, 3.5, 5, 7, 10),
    "capitals": (0.02, 0.06, 0.15, 0.4, 0.8),
    "digits": (0.001, 0.02, 0.08, 0.2, 0.5),
    "marks": (0.01, 0.03, 0.06, 0.12, 0.25),
    "letters": (0.5, 0.65, 0.75, 0.82, 0.9),
    "distinct": (0.15, 0.35, 0.6, 0.8, 0.95),
    "echoes": (0.001, 0.05, 0.15, 0.4, 0.8),
    "loose_marks": (0.001, 0.03, 0.1, 0.3, 0.6),
    "mark_runs": (0.001, 0.03, 0.1, 0.3, 0.6),
    "shortest_share": (0.05, 0.15, 0.3, 0.5, 0.8),
}
EDGES = [np.array(e) for e in BINS.values()]
OWN = sum(len(e) + 1 for e in EDGES)
#: Features of a line: bias, own bins, bins of the line before and after, whether there is one.
WIDTH = 1 + 3 * OWN + 2


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each code point of the basic plane: 0 blank, 1 mark, 2 letter, 3 capital, 4 digit."""
    kind = np.ones(0x10000, np.uint8)
    for c in map(chr, range(0x10000)):
        if c.isspace():
            kind[ord(c)] = 0
        elif c.isupper():
            kind[ord(c)] = 3
        elif c.isalpha():
            kind[ord(c)] = 2
        elif c.isdigit():
            kind[ord(c)] = 4
    return kind


def line_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(binned counts of each line as an array of bin numbers, weights): weights are the lines' lengths plus one."""
    text = text or ""
    lines = text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _kinds()[np.minimum(points, 0xFFFF)]
    kinds[points > 0xFFFF] = 1
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = np.r_[0, ends[:-1]]
    size = ends - starts - 1
    by_kind = np.zeros((5, len(lines)))
    for k in range(5):
        total = np.r_[0, np.cumsum(kinds == k)]
        by_kind[k] = total[starts + size] - total[starts]
    seen = np.maximum(size - by_kind[0], 1)
    letters = by_kind[2] + by_kind[3]
    shape = np.zeros((6, len(lines)))
    for i, line in enumerate(lines):
        words = line.split()
        if n := len(words):
            loose = sum(not w[0].isalnum() and not w[-1].isalnum() for w in words)
            runs = sum(len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum() for w in words)
            shape[:, i] = n, len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, loose / n, runs / n, sum(len(w) < 3 for w in words) / n
    n = np.maximum(shape[0], 1)
    values = [size, shape[0], seen / n, by_kind[3] / np.maximum(letters, 1), by_kind[4] / seen, by_kind[1] / seen, letters / seen, *shape[1:]]
    bins = np.stack([np.searchsorted(e, v, "right") for e, v in zip(EDGES, values, strict=True)], 1).astype(np.int64)
    return bins, size + 1.0


def places_of(bins: np.ndarray) -> np.ndarray:
    """Positions of the own features that are 1, one row a line."""
    return bins + np.cumsum([0, *[len(e) + 1 for e in EDGES[:-1]]])


@dataclass
class LineField:
    """Weights of the field. ``step[a, b]``: from a line of label a to one of label b; label 1 is good."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (1.0, 0.0)
    prior: float | None = None

    def tilts(self, bins: np.ndarray) -> np.ndarray:
        """Log-odds of good that each line's own and neighbouring features give."""
        at = places_of(bins)
        here, before, after = (self.weights[1 + k * OWN : 1 + (k + 1) * OWN][at].sum(1) for k in range(3))
        out = self.weights[0] + here
        out[1:] += before[:-1] + self.weights[-2]
        out[:-1] += after[1:] + self.weights[-1]
        return out

    def marginals(self, bins: np.ndarray) -> np.ndarray:
        """Probability that each line is good, by the forward-backward algorithm."""
        tilt = self.tilts(bins)[None]
        return marginals(tilt, np.ones_like(tilt, bool), self.step)[0][0]

    def quality(self, text: str | None) -> float:
        """Probability that a whole text is good."""
        if self.prior is not None:
            return self.prior
        bins, size = line_counts(text)
        return float(_curve(self.curve, np.array([(self.marginals(bins) * size).sum() / size.sum()]))[0])


def _curve(curve: tuple[float, float], mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-np.clip(curve[0] * np.log(mean / (1 - mean)) + curve[1], -30, 30)))


def marginals(tilt: np.ndarray, there: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good-probabilities [chains, lines] and expected step counts [2, 2]; ``there`` marks the lines of each chain."""
    chains, most = tilt.shape
    good = 1 / (1 + np.exp(-np.clip(tilt, -40, 40)))
    emit = np.stack([1 - good, good], 2) + 1e-18
    moves = np.exp(step)
    ahead, back = np.zeros((chains, most, 2)), np.ones((chains, most, 2))
    ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, most):
        now = emit[:, t] * (ahead[:, t - 1] @ moves)
        ahead[:, t] = now / now.sum(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        now = (emit[:, t + 1] * back[:, t + 1]) @ moves.T
        back[:, t] = np.where(there[:, t + 1, None], now / now.sum(1, keepdims=True), 1)
    both = ahead * back
    p = both[:, :, 1] / both.sum(2)
    if most == 1:
        return p, np.zeros((2, 2))
    pairs = ahead[:, :-1, :, None] * moves * (emit * back)[:, 1:, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return p, (pairs * there[:, 1:, None, None]).sum((0, 1))


def _chunks(sizes: np.ndarray, cells: int = 40_000) -> Iterator[np.ndarray]:
    """Documents in groups of like length, so that padding stays small."""
    order, now = np.argsort(sizes, kind="stable"), []
    for d in order:
        if now and (len(now) + 1) * sizes[d] > cells:
            yield np.array(now)
            now = []
        now.append(d)
    if now:
        yield np.array(now)


def _fit_chain(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int, pull: float = 1e-4, rate: float = 0.15) -> LineField:
    """Gradient ascent (Adam) on the mean log-likelihood of the labelled lines."""
    out, sizes = LineField(), np.array([len(c) for c in chains])
    total = sizes.sum()
    packed = []
    for group in _chunks(sizes):
        most = sizes[group].max()
        there = np.arange(most) < sizes[group][:, None]
        want = np.zeros(there.shape)
        want[there] = np.concatenate([labels[d] for d in group])
        went = np.zeros((2, 2))
        for d in group:
            y = labels[d].astype(int)
            np.add.at(went, (y[:-1], y[1:]), 1)
        packed.append((group, there, want, went))
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for k in range(1, rounds + 1):
        slope, moved = np.zeros(WIDTH), np.zeros((2, 2))
        for group, there, want, went in packed:
            tilt = np.zeros(there.shape)
            tilt[there] = np.concatenate([out.tilts(chains[d]) for d in group])
            p, expected = marginals(tilt, there, out.step)
            moved += went - expected
            miss = np.split((want - p)[there], np.cumsum(sizes[group])[:-1])
            for d, e in zip(group, miss, strict=True):
                at = places_of(chains[d])
                slope[0] += e.sum()
                slope[-2] += e[1:].sum()
                slope[-1] += e[:-1].sum()
                for part, rows, gap in ((0, at, e), (1, at[:-1], e[1:]), (2, at[1:], e[:-1])):
                    slope[1 + part * OWN : 1 + (part + 1) * OWN] += np.bincount(rows.ravel(), np.repeat(gap, rows.shape[1]), OWN)
        grad = np.r_[slope, moved.ravel()] / total - pull * np.r_[out.weights, out.step.ravel()]
        first, second = 0.9 * first + 0.1 * grad, 0.98 * second + 0.02 * grad**2
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.98**k)) + 1e-8)
        out.weights, out.step = out.weights + move[:WIDTH], out.step + move[WIDTH:].reshape(2, 2)
    return out


def fit(chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, shares: np.ndarray, rounds: int = 60) -> LineField:
    """The field for documents given by the bins and lengths of their lines and a 0/1 label each.

    ``shares`` weighs a document in the final curve, so that classes count as they do among all labelled rows. With
    no documents, or of one label only, the field returns a constant: 0.5, or the label.
    """
    if len(set(labels.tolist())) < 2:
        return LineField(prior=float(labels[0]) if len(labels) else 0.5)
    target = [np.full(len(c), y) for c, y in zip(chains, labels, strict=True)]
    first = _fit_chain(chains, target, rounds)
    for d in np.flatnonzero(labels == 0):
        bad = 1 - first.marginals(chains[d])
        target[d] = np.where(bad >= 0.5 * bad.max(), 0, 1)  # the worst line is bad for certain
    out = _fit_chain(chains, target, rounds)
    means = np.array([(out.marginals(c) * s).sum() / s.sum() for c, s in zip(chains, sizes, strict=True)])
    out.curve = _logistic(means, labels, shares)
    return out


def _logistic(means: np.ndarray, labels: np.ndarray, shares: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps for a weighted logistic curve over the log-odds of ``means``, lightly pulled to the identity."""
    clipped = np.clip(means, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(clipped / (1 - clipped)), np.ones(len(means))], 1)
    w, pull, start = np.array([1.0, 0.0]), np.diag([1e-2, 1e-2]) * shares.sum() / 10, np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (shares * (labels - p)) - pull @ (w - start)
        w = w + np.linalg.solve((x * (shares * p * (1 - p))[:, None]).T @ x + pull, slope)
    return max(float(w[0]), 0.05), float(w[1])


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [line_counts(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bins": [b.astype(np.uint8).tobytes() for b, _ in found], "sizes": [s.tobytes() for _, s in found]})


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineField:
    """Fit the field on at most ``per_class`` labelled documents of each label, none of them held out.

    The sample takes the least hashes of doc_id of each label. Rows without a doc_id or with a label other than 0
    and 1 are left out; of repeated label rows the least label counts. The driver gets 20 bytes a line, no text.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(is_held_out(), F.lit(True)))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = dict(known.groupBy("quality").count().collect())
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]).withColumnsRenamed({"doc_id": "labelled"}))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id") == F.col("labelled"))
    got = rows.select("doc_id", "text", "quality").mapInPandas(_gathered, "doc_id long, quality int, bins binary, sizes binary").toPandas().sort_values(["doc_id", "bins"]).reset_index(drop=True)
    chains = [np.frombuffer(b, np.uint8).reshape(-1, len(EDGES)).astype(np.int64) for b in got["bins"]]
    sizes = [np.frombuffer(s, float) for s in got["sizes"]]
    y = got["quality"].to_numpy(int)
    shares = np.array([counts.get(q, 1) / max(1, (y == q).sum()) for q in y])
    return fit(chains, sizes, y, shares)


def quality_column(model: LineField, text: str | Column = "text") -> Column:
    """Score of each whole text, 0 to 1; null and empty texts are one empty line."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.quality(t) for t in batch], dtype=float)

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from 0.3 on).

    Only the text enters a score. Repeated rows get the same score each, a null doc_id is held out, an empty table
    gives an empty result. Without labels of both kinds every score is the only label there is, or 0.5.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality_column(model, F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_bad(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the field holds for good, all columns unchanged."""
    model = train(docs, labels)
    [score] = spare(docs, "score")
    marked = docs.withColumn(score, quality_column(model, F.col("text").cast("string")))
    return marked.where(F.col(score) >= THRESHOLD).drop(score)
