"""Product codes of vectors: Lloyd rounds whose sums are maintained from changes.

Vectors become integers and are cut into equal parts, each with a codebook of its own. A table in the shared folder
holds, beside each vector, the assignment of the round before. A round reads it, assigns every part to its nearest
entry and writes the next table; then only parts whose assignment changed contribute: plus at the new entry, minus at
the old one, summed in the task before anything is shuffled. Running integer sums and counts are kept on the driver:
PARTS * ENTRIES rows, whatever the number of vectors, and so are the codebooks that go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.names import spare
from stratigraph.session import ship
from stratigraph.storage import discard, materialize

#: Parts of a vector, entries of a codebook, rounds, and the factor before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components must be smaller than this, so that distances of 1000-component parts stay below 2^63.
LIMIT = 1 << 26
#: Rows of a block in a task, and labels that are sent to all rows.
BLOCK_ROWS, SENT_LABELS = 4096, 200_000
#: Shares of a label's rows where its sum is joined instead of sent.
SALT = 32


def finite(vector: str | Column) -> Column:
    """True for vectors that are there and hold neither nulls nor values that are not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; exact: in floats below 2^53, in integers beyond."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column a part; ties go to the lower index."""
    codes = np.zeros((len(x), len(books)), np.int16)
    far = np.zeros((len(x), len(books)), np.int64)
    for part, (piece, book) in enumerate(zip(np.split(x, len(books), 1), books, strict=True)):
        d = _squares(piece, book)
        codes[:, part] = d.argmin(1)
        far[:, part] = np.take_along_axis(d, codes[:, part : part + 1].astype(np.int64), 1)[:, 0]
    return codes, far


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(low, BLOCK_ROWS)


def _replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)


def _assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows (..., x, now, before, error)`` with the assignment to ``books``; ``before`` is what ``now`` was."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            codes, far = nearest(_matrix(batch.column("x"), batch.num_rows).astype(np.int64), books)
            yield _replaced(batch, {"before": batch.column("now"), "now": _lists(codes, pa.int16()), "error": pa.array(far.sum(1))})

    return rows.mapInArrow(work, rows.schema)


def _changes(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(slot, count, sums) of all entries whose parts changed: what ``now`` adds less what ``before`` took along."""
    parts, (entries, width) = len(books), books[0].shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for batch in _blocks(batches):
            x = _matrix(batch.column("x"), batch.num_rows).astype(np.int64)
            now, before = (_matrix(batch.column(c), batch.num_rows).astype(np.int64) for c in ("now", "before"))
            for part, piece in enumerate(np.split(x, parts, 1)):
                moved = np.flatnonzero(now[:, part] != before[:, part])
                with_one = np.c_[np.ones(len(moved), np.int64), piece[moved]]
                np.add.at(sums, part * entries + now[moved, part], with_one)
                old = before[moved, part] >= 0
                np.subtract.at(sums, part * entries + before[moved[old], part], with_one[old])
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _lists(sums[at], pa.int64())], names=["slot", "sums"])

    told = rows.select("x", "now", "before").mapInArrow(work, "slot int, sums array<bigint>")
    return told.groupBy("slot").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(width + 1)]).alias("sums"))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): rows (vec_id, label, now: the codes, error) of every kept vector, and the final entries.

    Rows whose vector is null or holds nulls or values that are not finite are dropped. The ``entries`` smallest vec_ids
    start the codebooks, equal ids by their components, null ids last. An unused entry stays as it is. Repeated rows
    are coded alike and each counts. All vectors must be of one length that ``parts`` divides and their integers below
    ``LIMIT``, else ValueError; an empty table gives empty rows and no codebooks. Only vec_id, label and embedding are read.
    """
    ship(vectors.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("int"))
    large = F.exists("embedding", lambda x: F.abs(scale * x.cast("double")) >= LIMIT)
    none = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda _: F.lit(-1).cast("short"))
    good = vectors.where(finite("embedding"))
    width = good.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.max(large)).first()
    if width[0] is None:
        empty = vectors.limit(0).select("vec_id", "label", F.lit(None).cast("array<smallint>").alias("now"), F.lit(0).cast("long").alias("error"))
        return empty, []
    if width[0] != width[1] or width[0] % parts or width[2]:
        raise ValueError(f"vectors have {width[0]} to {width[1]} components, {parts} parts; components below {LIMIT // scale} wanted: {not width[2]}")
    rows = materialize(good.select("vec_id", "label", whole.alias("x"), none.alias("now"), none.alias("before"), F.lit(0).cast("long").alias("error")), "codes")
    first = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()], np.int64).reshape(-1, width[0])
    books = np.split(first, parts, 1)
    sums = np.zeros((parts, *books[0].shape), np.int64)
    counts = np.zeros((parts, len(first)), np.int64)
    for at in range(rounds + 1):
        after = materialize(_assigned(rows, books), "codes")
        discard(rows)
        rows = after
        if at == rounds:
            break
        for r in _changes(rows, books).collect():  # at most one row an entry
            part, entry = divmod(r["slot"], len(first))
            counts[part, entry] += r["sums"][0]
            sums[part, entry] += np.array(r["sums"][1:], np.int64)
        books = [np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], book) for book, n, total in zip(books, counts, sums, strict=True)]
    return rows.select("vec_id", "label", "now", "error"), books


def _with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal labels, null being one of them."""
    sums = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes")
    label, salt = spare(rows, "of", "salt")
    told = sums.withColumnRenamed("label", label)
    if told.count() <= SENT_LABELS:
        return rows.join(F.broadcast(told), F.col("label").eqNullSafe(F.col(label)), "left").drop(label)
    # a label may hold a third of all rows, so its rows are dealt over SALT tasks
    spread = rows.withColumn(salt, F.pmod(F.xxhash64("vec_id", "now"), F.lit(SALT)))
    told = told.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return spread.join(told, F.col("label").eqNullSafe(F.col(label)) & (F.col(salt) == F.col("share")), "left").drop(label, salt, "share")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that ``encode`` keeps."""
    rows, books = encode(vectors)
    told = ",".join(str(x) for book in books for x in book.ravel().tolist())
    code = F.array_join(F.transform("now", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return _with_label_error(rows).select(
        F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"), "error", F.col("label_error").cast("long").alias("label_error"), F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256")
    )
