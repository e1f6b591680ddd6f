"""Sequence clean-up, composition and consensus, as column expressions and group-bys."""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols of an aligned sequence, and residue order of the composition vector. Fixed values.
ALPHABET = ".-RHKDESTNQCGPAVILMFYW"
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"


def std_gaps(s: str | Column, gap: str = ".") -> Column:
    return F.replace(s, F.lit(gap), F.lit("-"))


def x_to_gaps(s: str | Column) -> Column:
    """Upper case, X becomes a gap."""
    return F.replace(F.upper(s), F.lit("X"), F.lit("-"))


def is_alphabet(s: str | Column) -> Column:
    """1 if all upper-cased symbols belong to the alphabet, else 0."""
    return F.upper(s).rlike(r"\A[.\-RHKDESTNQCGPAVILMFYW]*\z").cast("int")


def remove_gaps(s: str | Column, gap: str = ".") -> Column:
    return F.replace(s, F.lit(gap), F.lit(""))


def remove_insertions(s: str | Column) -> Column:
    """Without lower-case letters, dots and stars."""
    return F.regexp_replace(s, r"[a-z.*]", "")


def model_ready(s: str | Column) -> Column:
    """U, Z, O and B's rare kin become X, residues stand apart by blanks."""
    return F.array_join(F.split(F.translate(s, "UZO", "XXX"), ""), " ")


def truncate(s: str | Column, n: int = 1022) -> Column:
    return F.substring(s, 1, n)


def composition(s: str | Column) -> Column:
    """Share of each residue in fixed order; all unknown symbols count as X; an empty string gives NaN.

    The text is bound once; residues are single bytes, so each is counted by the bytes that removing it saves.
    """
    text = F.col(s) if isinstance(s, str) else s

    def shares(x: Column) -> Column:
        n = x["n"]
        held = F.transform(F.array(*[F.lit(c) for c in RESIDUES[:-1]]), lambda c: F.octet_length(x["t"]) - F.octet_length(F.replace(x["t"], c, F.lit(""))))
        counts = F.transform(F.array(held), lambda h: F.array_append(h, n - F.aggregate(h, F.lit(0), lambda a, v: a + v)))
        return F.transform(F.get(counts, F.lit(0)), lambda c: F.when(n == 0, F.lit(float("nan"))).otherwise(c / F.greatest(n, F.lit(1))))

    return F.get(F.transform(F.array(F.struct(text.alias("t"), F.char_length(text).alias("n"))), shares), F.lit(0))


def header_labels(header: str | Column) -> tuple[Column, Column]:
    """(species, true label): fields 0 and 4 of a header; the first without > and blanks around."""
    parts = F.split(header, r"\|", -1)
    return F.trim(F.ltrim(F.get(parts, F.lit(0)), F.lit(">"))), F.get(parts, F.lit(4))


def within_length(df: DataFrame, family: str, seq: str, most: int = 2048) -> DataFrame:
    """Rows of families whose sequences all have at most ``most`` symbols."""
    longest = df.groupBy(family).agg(F.max(F.char_length(seq)).alias("__m")).where(F.col("__m") <= most)
    return df.join(longest.select(family), family, "left_semi")


def within_alignment(df: DataFrame, family: str, seq: str, most: int = 1024) -> DataFrame:
    """Rows of families with at most ``most`` sequences of at most ``most`` symbols."""
    good = df.groupBy(family).agg(F.max(F.char_length(seq)).alias("__m"), F.count(F.lit(1)).alias("__n")).where((F.col("__m") <= most) & (F.col("__n") <= most))
    return df.join(good.select(family), family, "left_semi")


def msa_stats(df: DataFrame, family: str, pos: str, seq: str) -> DataFrame:
    """(family, n_sequences, last_length, longest)."""
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("n_sequences"), F.max_by(F.char_length(seq), F.col(pos)).alias("last_length"), F.max(F.char_length(seq)).alias("longest"))


def shuffled(s: str | Column, p: float = 0.8, seed: int = 0) -> Column:
    """int(p * length) seeded swaps of positions drawn with replacement; the letters stay the same."""

    def swap(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            rng, out = random.Random(zlib.crc32(text.encode()) ^ seed), list(text)
            for _ in range(int(p * len(out))):
                a, b = rng.randrange(len(out)), rng.randrange(len(out))
                out[a], out[b] = out[b], out[a]
            return "".join(out)

        return texts.map(one)

    return F.pandas_udf(swap, T.StringType())(s)


#: Columns of an alignment that are grouped as one piece of text.
CHUNK = 64


def consensus(df: DataFrame, family: str, rec: str, seq: str, ignore_gaps: bool = True) -> DataFrame:
    """(family, consensus): the commonest symbol of each column; ties go to the one of the earliest record.

    Gaps count only if a column has nothing else, or always with ``ignore_gaps`` off. Families whose sequences differ
    in length raise an error; an empty table gives an empty result.

    Sequences are cut into pieces of ``CHUNK`` columns, and equal pieces are counted before the exchange. Only pieces of
    which a family has more than one are taken apart into symbols.
    """
    size = F.char_length(seq)
    sizes = df.groupBy(family).agg(F.min(size).alias("least"), F.max(size).alias("most"))
    cut = F.when(size > 0, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(F.lit("")))
    pieces = df.where(F.col(seq).isNotNull()).select(family, rec, F.posexplode(cut).alias("block", "piece"))
    counted = pieces.groupBy(family, "block", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(rec).alias("first"))
    ends = counted.groupBy(family, "block").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    alike = ends.where("low = high").select(family, "block", F.col("low").alias("best"))
    mixed = counted.join(ends.where("low <> high").select(family, "block"), [family, "block"], "left_semi")
    cells = mixed.select(family, "block", "n", "first", F.posexplode(F.split("piece", "")).alias("pos", "ch"))
    counts = cells.groupBy(family, "block", "pos", "ch").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    gap = (F.col("ch") == "-").cast("int") if ignore_gaps else F.lit(0)
    best = counts.groupBy(family, "block", "pos").agg(F.min_by("ch", F.struct(gap, -F.col("n"), "first")).alias("ch"))
    voted = best.groupBy(family, "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda c: c["ch"]), "").alias("best"))
    joined = alike.union(voted).groupBy(family).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "best"))), lambda c: c["best"]), "").alias("consensus"))
    even = F.when(F.col("least") != F.col("most"), F.raise_error(F.concat(F.lit("unequal lengths in "), F.col(family).cast("string"))).cast("boolean")).otherwise(True)
    return joined.join(sizes.where(even).select(family), family)
