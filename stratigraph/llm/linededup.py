"""Line deduplication over a corpus, in DataFrame operations only.

Occurrences (key hash, document, position) are dealt by range over (hash, document) and sorted inside each partition
by document and position, so a very frequent key is spread over several partitions instead of landing in one.
Streaming over that order gives, without another exchange, one row for every key and document: its first occurrence
and the rest. Those rows are counted per key with partial sums; the document that keeps the key is the greatest.
What returns to the documents is a compressed keep bitmap per document, never text: 64-line words in which a set bit
keeps the line; words that keep every line are left out. The bitmaps are written and measured. Up to ``SENT_BYTES``
they go to the documents, whose texts then stay where they were read; beyond that both sides are dealt by document and
the bitmaps of a partition are hashed, so that no text is sorted either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.names import own_columns, spare
from stratigraph.storage import materialize

#: Least length of a key in code points, least number of documents.
MIN_CHARS, MIN_DOCS = 20, 3
#: Most bytes of bitmaps that are sent to every executor.
SENT_BYTES = 32 << 20
#: ASCII white space: space, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str | Column) -> Column:
    """Array of the lines of a whole text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, rid, pos) of every line that counts; rid tells apart rows that share a doc_id."""
    keyed = F.transform(lines_of("text"), lambda line, at: F.struct(at.alias("pos"), line_key(line).alias("key")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), F.explode(keyed).alias("line"))
    long_enough = rows.where(F.char_length("line.key") >= min_chars)
    return long_enough.select(F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(1), "line.key").alias("h2"), "doc_id", "rid", F.col("line.pos").alias("pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (doc_id, rid, bitmap map<word, bits>, n_dropped).

    A key of at least ``min_chars`` code points that at least ``min_docs`` different doc_ids hold keeps its lines in
    the greatest of them only. Rows that share a doc_id are one document; a null doc_id is the least of all.
    """
    order = ["h1", "h2", "doc_id"]
    # written first, as dealing by range reads its input twice: once for the bounds
    ranged = materialize(_occurrences(docs, min_chars), "lines").repartitionByRange(*order).sortWithinPartitions(*order, "rid", "pos")
    per_doc = materialize(ranged.groupBy(*order).agg(F.collect_list(F.struct("rid", "pos")).alias("places")), "lines")
    repeated = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last_doc")).where(F.col("docs") >= min_docs)
    # written first, so that both sides of the join come straight from a table and Spark can split a frequent key
    repeated = materialize(repeated, "lines")
    dropped = per_doc.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    dropped = dropped.select("doc_id", F.inline("places"))
    words = dropped.groupBy("doc_id", "rid", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy("doc_id", "rid").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))).alias("bitmap"),
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
    )


def _kept(text: Column, bitmap: Column) -> Column:
    """The lines whose bit is set, joined by line feeds; a word that the bitmap lacks keeps all its lines."""
    bit = lambda at: F.getbit(F.coalesce(F.element_at(bitmap, F.floor(at / 64).cast("int")), F.lit(-1).cast("long")), at % 64)
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), lambda line, at: bit(at) == 1), "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, names: tuple[str, ...] = ("kept_text", "n_lines", "n_dropped", "keep_bitmap")) -> DataFrame:
    """``docs`` with four added columns: the text that stays, lines before, lines dropped, bitmap (null: all lines stay)."""
    kept, lines, dropped, bitmap = names
    one, rid, gone = spare(docs, "id", "rid", "gone")
    marks = materialize(bitmaps.select(F.col("doc_id").alias(one), F.col("rid").alias(rid), F.col("bitmap").alias(bitmap), F.col("n_dropped").alias(gone)), "bitmaps")
    rows, words = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(bitmap)), F.lit(0))).first()
    marks = F.broadcast(marks) if 100 * rows + 16 * words <= SENT_BYTES else marks.hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(marks[one]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == marks[rid])
    text = F.coalesce("text", F.lit(""))
    return docs.join(marks, same, "left").withColumns({
        kept: _kept(F.col("text"), F.col(bitmap)),
        lines: (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        dropped: F.coalesce(gone, F.lit(0).cast("long")),
    }).drop(one, rid, gone)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, kept_text, n_lines (before), n_dropped, keep_bitmap.

    Null and empty texts have one empty line, which stays. Only columns doc_id and text are read. Repeated rows get
    the same result each. An empty table gives an empty result. A document whose lines all go gets an empty text.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return apply_bitmaps(plain, keep_bitmaps(plain, min_chars, min_docs)).drop("text")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the same rows and columns, text without repeated lines and n_chars, if there, counted anew."""
    plain = docs.select("doc_id", "text")
    names = spare(docs, "kept", "lines", "dropped", "bitmap")
    marked = apply_bitmaps(docs.select(*own_columns(docs)), keep_bitmaps(plain), tuple(names))
    new = {"text": F.when(F.col("text").isNotNull(), F.col(names[0]))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length(names[0]).cast(docs.schema["n_chars"].dataType))
    return marked.withColumns(new).select(*own_columns(docs))
