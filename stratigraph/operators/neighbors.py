"""Top-k neighbours by inner product: exact, approximate over cells, or refined from neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratigraph.session import ship
from stratigraph.storage import discard, materialize

#: Bytes of vectors that Spark holds as the searched side of a task; most bytes of centres that are sent to all tasks.
SEARCHED_BYTES, BROADCAST_BYTES = 256 << 20, 64 << 20
#: Rows of a block of a search, and of it that are scored at a time.
TILE_BLOCK, TILE_ROWS = 4096, 256
#: More than what a rough score of unit vectors is off by.
NOISE = 2e-5
NEIGHBOURS = "i long, rank int, j long, score double"


def adaptive_k(n: int, coeff: float = 0.4, cap: int = 150) -> int:
    """min(ceil(coeff * sqrt(n)), cap)."""
    return min(int(np.ceil(coeff * np.sqrt(n))), cap)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _packed(rows: DataFrame, blocks: int, block: str, ids: str, x: str) -> DataFrame:
    """One row a block: its number, its ids and its vectors end to end."""
    listed = F.collect_list(F.struct("id", "x"))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(block)).agg(listed.alias("all"))
    return packed.select(block, F.col("all.id").alias(ids), F.flatten("all.x").alias(x))


class _Best:
    """The ``k`` best of all blocks that a block of rows has met; ties by id.

    Blocks are scored roughly, in floats of 32 bits and with unit rows. What may be among the best is scored in full, each
    pair by itself, so equal vectors have equal scores wherever they lie in a block.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.size = np.sqrt((x**2).sum(1))
        self.size[self.size == 0] = 1
        self.unit = (x / self.size[:, None]).astype(np.float32)
        self.score, self.other = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, others: np.ndarray, y: np.ndarray, own: bool) -> None:
        most = np.sqrt((y**2).sum(1).max()) or 1.0
        there = (y / most).astype(np.float32).T
        for at in range(0, len(self.ids), TILE_ROWS):
            rows = slice(at, at + TILE_ROWS)
            rough = self.unit[rows] @ there
            if own:
                rough[self.ids[rows, None] == others] = -np.inf
            least = self.score[rows, -1] / (self.size[rows] * most)
            if len(others) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(rough, len(others) - self.k, 1)[:, len(others) - self.k])
            # a finite bound leaves the rows themselves out
            bound = np.maximum(least - NOISE, -2).astype(np.float32)
            row, place = np.divmod(np.flatnonzero(rough >= bound[:, None]), len(others))
            row += at
            score = [np.einsum("ij,ij->i", self.x[row[low : low + 8192]], y[place[low : low + 8192]]) for low in range(0, len(row), 8192)]
            self.more.append((row, others[place], np.concatenate([np.zeros(0), *score])))
            self.waiting += len(row)
            if self.waiting > max(self.score.size // 2, 1_000_000):
                self.settle()

    def meet_some(self, rows: np.ndarray, others: np.ndarray, y: np.ndarray) -> None:
        """Only these rows meet ``others``, each pair scored in full."""
        for at in range(0, len(rows), TILE_ROWS):
            own = rows[at : at + TILE_ROWS]
            scores = self.x[own] @ y.T
            scores[self.ids[own, None] == others] = -np.inf
            least = self.score[own, -1]
            if len(others) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(scores, len(others) - self.k, 1)[:, len(others) - self.k])
            row, place = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            self.more.append((own[row], others[place], scores[row, place]))
            self.waiting += len(row)
            if self.waiting > max(self.score.size // 2, 1_000_000):
                self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        row, other, score = (np.concatenate(c) for c in zip(*self.more, strict=True))
        order = np.argsort(row.astype(np.uint16), kind="stable")
        row, other, score = row[order], other[order], score[order]
        starts = np.searchsorted(row, np.arange(len(self.ids) + 1))
        for at in range(0, len(self.ids), TILE_ROWS):
            rows, low, high = slice(at, at + TILE_ROWS), starts[at], starts[min(at + TILE_ROWS, len(self.ids))]
            wide = int(np.diff(starts[at : at + TILE_ROWS + 1]).max(initial=0))
            if not wide:
                continue
            n = len(self.ids[rows])
            scores, others = np.full((n, wide), -np.inf), np.zeros((n, wide), np.int64)
            cell = (row[low:high] - at, np.arange(low, high) - starts[row[low:high]])
            scores[cell], others[cell] = score[low:high], other[low:high]
            scores, others = np.c_[self.score[rows], scores], np.c_[self.other[rows], others]
            best = np.lexsort((others, -scores), axis=1)[:, : self.k]
            self.score[rows], self.other[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(others, best, 1)
        self.more, self.waiting = [], 0

    def result(self) -> pa.RecordBatch:
        self.settle()
        row, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array((place + 1).astype(np.int32)), pa.array(self.other[row, place]), pa.array(self.score[row, place])], names=["i", "rank", "j", "score"])


def top_neighbors(df: DataFrame, k: int, id_col: str = "id", col: str = "x", broadcast_bytes: int = SEARCHED_BYTES, block_rows: int = TILE_BLOCK) -> DataFrame:
    """(i, rank from 1, j, score): the ``k`` rows of largest inner product for each row, without itself.

    Rows are packed into blocks, one row of a table each. A task asks for one block: the searched blocks pass by it one
    after the other, and it keeps the best so far, so its memory is that of two blocks and ``k`` entries a row whatever the
    table's size. Vectors are shuffled once, none of them comes to the driver. Spark holds the searched side of a task;
    of more than ``broadcast_bytes`` it is divided, and the lists of the parts are merged.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("x"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or k < 1:
        return spark.createDataFrame([], NEIGHBOURS)
    held = min(block_rows, max(256, n // (2 * spark.sparkContext.defaultParallelism)))
    blocks = -(-n // held)
    parts = min(blocks, -(-n * max(width, 1) * 8 // max(broadcast_bytes, 1)))
    packed = materialize(_packed(rows, blocks, "a", "ids", "x"), "blocks")
    asking = packed.repartitionByRange(blocks, "a")
    sought = packed.select(F.col("a").alias("b"), F.col("ids").alias("others"), F.col("x").alias("y"))
    sought = sought.coalesce(1) if parts == 1 else sought.repartitionByRange(parts, "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for one in range(batch.num_rows):
                cell = lambda c: batch.column(c)[one].values.to_numpy()  # noqa: B023, E731
                a, b = batch.column("a")[one].as_py(), batch.column("b")[one].as_py()
                if a != at:
                    if best:
                        yield best.result()
                    at, best = a, _Best(cell("ids"), cell("x").reshape(len(cell("ids")), width), k)
                best.meet(cell("others"), cell("y").reshape(-1, width), a == b)
        if best:
            yield best.result()

    found = asking.hint("shuffle_replicate_nl").crossJoin(sought).mapInArrow(search, NEIGHBOURS)
    return found if parts == 1 else _best(found, k)


def _best(parts: DataFrame, k: int) -> DataFrame:
    """The k best of several lists of each row; a neighbour that several lists have counts once."""
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "j"))), 1, k)
    return parts.groupBy("i").agg(best.alias("best")).select("i", F.posexplode("best").alias("rank", "b")).select("i", (F.col("rank") + 1).cast("int").alias("rank"), "b.j", (-F.col("b.s")).alias("score"))


def _centres(rows: DataFrame, cells: int, sample: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``cells`` cells by k-means on at most ``sample`` rows, those of least hashed id."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = _matrix(got["x"])
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(part @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    return centres


def _lots(sizes: dict[int, int], order: list[int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first lot, lots): cells in order fill lots of at most ``most`` rows; a larger cell has lots of its own."""
    out, lot, held = [], 0, 0
    for cell in order:
        n = sizes.get(cell, 0)
        if held and held + n > most:
            lot, held = lot + 1, 0
        out.append((cell, lot, max(1, -(-n // most))))
        lot, held = (lot + out[-1][2], 0) if n > most else (lot, held + n)
    return out


def cell_neighbors(df: DataFrame, k: int, id_col: str = "id", col: str = "x", cells: int | None = None, probes: int = 8, sample: int = 50_000, block_rows: int = TILE_BLOCK, broadcast_bytes: int = SEARCHED_BYTES) -> DataFrame:
    """Approximate (i, rank, j, score): each row searches the ``probes`` nearest of ``cells`` cells.

    Every row is indexed in its nearest cell. Centres come from a bounded sample and are what is broadcast: 4 sqrt(N)
    of them if not given, as many as fit ``BROADCAST_BYTES`` at most. Cells are packed into blocks of at most ``block_rows``
    rows, neighbouring ones together, a larger cell into several. As in ``top_neighbors`` a task asks for one block, keeps
    the best so far, and the blocks that have a cell it asks for pass by; so a row is shuffled once and its list once
    at most for each part of ``broadcast_bytes``, however many cells it searches. Distances grow as N sqrt(N) instead of N^2.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("x"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], NEIGHBOURS)
    cells = max(1, min(cells or int(4 * np.sqrt(n)), n, sample, BROADCAST_BYTES // (8 * width)))
    centres = _centres(rows, cells, sample)
    shared, take = spark.sparkContext.broadcast(centres), min(probes, len(centres))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            x = _matrix(batch["x"])
            score = x @ centres.T - 0.5 * (centres**2).sum(1) if len(x) else np.zeros((0, len(centres)))
            near = np.argpartition(-score, take - 1, 1)[:, :take].astype(np.int32)
            yield pd.DataFrame({"cell": score.argmax(1).astype(np.int32), "asked": list(near), "id": batch["id"], "x": batch["x"]})

    base = materialize(rows.mapInPandas(placed, "cell int, asked array<int>, id long, x array<double>"), "cells")
    held = min(block_rows, max(256, n // (2 * spark.sparkContext.defaultParallelism)))
    sizes = {r["cell"]: r["n"] for r in base.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as centres
    ahead = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    lots = _lots(sizes, np.argsort(centres @ ahead, kind="stable").tolist(), held)
    blocks = lots[-1][1] + lots[-1][2]
    dealt = base.join(F.broadcast(spark.createDataFrame(lots, "cell int, lot int, lots int")), "cell")
    packed = dealt.groupBy((F.col("lot") + F.pmod(F.xxhash64("id"), F.col("lots"))).cast("int").alias("a")).agg(F.collect_list(F.struct("cell", "asked", "id", "x")).alias("all"))
    packed = materialize(packed.select("a", F.col("all.cell").alias("cells"), F.flatten("all.asked").alias("asked"), F.col("all.id").alias("ids"), F.flatten("all.x").alias("x")), "blocks")
    discard(base)
    parts = min(blocks, -(-n * max(width, 1) * 8 // max(broadcast_bytes, 1)))
    asking = packed.select("a", "ids", "x", "asked", F.array_distinct("asked").alias("wanted")).repartitionByRange(blocks, "a")
    sought = packed.select(F.col("ids").alias("others"), F.col("x").alias("y"), F.col("cells").alias("of"), F.array_distinct("cells").alias("kinds"))
    sought = sought.coalesce(1) if parts == 1 else sought.repartition(parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for one in range(batch.num_rows):
                cell = lambda c: batch.column(c)[one].values.to_numpy()  # noqa: B023, E731
                if (a := batch.column("a")[one].as_py()) != at:
                    if best:
                        yield best.result()
                    at, best, asked = a, _Best(cell("ids"), cell("x").reshape(len(cell("ids")), width), k), cell("asked")
                    by = np.argsort(asked, kind="stable")
                    asked = asked[by]
                others, y, of = cell("others"), cell("y").reshape(-1, width), cell("of")
                for c in np.unique(of):
                    low, high = np.searchsorted(asked, [c, c + 1])
                    if low < high:
                        best.meet_some(by[low:high] // take, others[of == c], y[of == c])
        if best:
            yield best.result()

    found = asking.hint("shuffle_replicate_nl").join(sought, F.arrays_overlap("wanted", "kinds")).mapInArrow(search, NEIGHBOURS)
    return found if parts == 1 else _best(found, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each row with their rank; Spark limits each partition's groups before the shuffle."""
    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def _pools(near: DataFrame, most: int, turn: int) -> DataFrame:
    """(v, p, new): each row with its neighbours and at most ``most`` of the rows it is a neighbour of.

    A row that many have as a neighbour keeps the least hashed one of each of ``most`` slots, so a hub is no larger group.
    """
    draw = F.xxhash64(F.lit(turn), "i")
    back = near.groupBy(F.col("j").alias("v"), F.pmod(draw, F.lit(most)).alias("slot")).agg(F.min_by(F.struct(F.col("i").alias("p"), "new"), draw).alias("of"))
    ahead = near.select(F.col("i").alias("v"), F.col("j").alias("p"), "new")
    return ahead.union(back.select("v", "of.p", "of.new")).groupBy("v", "p").agg(F.max("new").alias("new"))


def descent_neighbors(df: DataFrame, k: int, id_col: str = "id", col: str = "x", lists: int | None = None, probes: int = 4, rounds: int = 8, settled: float = 0.001) -> DataFrame:
    """Approximate (i, rank, j, score) by refining a neighbour graph: neighbours of a row are likely neighbours of each other.

    Lists of ``lists`` entries (2 k, 30 at least, if not given) start from a search of ``probes`` cells. In each round the
    neighbours of a row and as many rows that have it as theirs are held against each other, pairs without a new member
    left out, and what betters a list goes into it. Rounds end when fewer than ``settled`` of all entries changed. A row
    takes part in at most (2 ``lists``)^2 / 2 comparisons a round whatever N is, and a task holds one such group at a time.
    A table of no more rows than that is searched exactly: that compares fewer pairs than one round and shuffles no groups.
    """
    ship(df.sparkSession)
    width = lists or max(2 * k, 30)
    if 1 < df.count() <= 2 * width**2:
        return top_neighbors(df, k, id_col, col)
    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("x")), "descent")
    start = cell_neighbors(rows, width, probes=probes).select("i", "j", "score", F.lit(True).alias("new"))
    near = materialize(start, "descent")

    def meet(pool: pd.DataFrame) -> pd.DataFrame:
        ids, x, fresh, least = pool["p"].to_numpy(), _matrix(pool["x"]), pool["new"].to_numpy(bool), pool["least"].to_numpy()
        scores = x @ x.T
        better = (fresh[:, None] | fresh[None]) & (scores >= least[:, None]) & (ids[:, None] != ids[None])
        scores = np.where(better, scores, -np.inf)
        take = min(width, len(ids))
        best = np.argpartition(-scores, take - 1, 1)[:, :take]
        value = np.take_along_axis(scores, best, 1)
        row, place = np.nonzero(value > -np.inf)
        return pd.DataFrame({"i": ids[row], "j": ids[best[row, place]], "score": value[row, place]})

    for turn in range(rounds):
        # a list that is not full yet takes any row
        least = near.groupBy("i").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("i").alias("id"), F.when(F.col("n") >= width, F.col("least")).alias("least"))
        told = rows.join(least, "id", "left").select(F.col("id").alias("p"), "x", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = _pools(near, width, turn).join(told, "p").groupBy("v").applyInPandas(meet, "i long, j long, score double")
        both = near.select("i", "j", "score", F.lit(False).alias("new")).union(found.withColumn("new", F.lit(True)))
        # one score a pair, the one that came first, so a pair is new once
        merged = both.groupBy("i", "j").agg(F.min_by("score", F.struct("new", "score")).alias("score"), F.min("new").alias("new"))
        after = materialize(_ranked(merged, width).drop("rank"), "descent")
        discard(near)
        near = after
        changed, entries = near.agg(F.count_if("new"), F.count(F.lit(1))).first()
        if changed <= settled * entries:
            break
    return _ranked(near, k).select("i", F.col("rank").cast("int").alias("rank"), "j", "score")
