"""Embedding providers: a name gives a function from a table of sequences to vectors by layer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.operators.sequences import composition

#: (rows with id and sequence) -> (id, layer, x, error)
Provider = Callable[[DataFrame], DataFrame]
PROVIDERS: dict[str, Provider] = {}
SCHEMA = "id long, layer int, x array<double>, error string"


def provider(name: str) -> Callable[[Provider], Provider]:
    def add(f: Provider) -> Provider:
        PROVIDERS[name] = f
        return f

    return add


@provider("composition")
def by_composition(rows: DataFrame) -> DataFrame:
    """Shares of the 21 residues of the whole sequence as layer 0; no model is needed."""
    return rows.select("id", F.lit(0).alias("layer"), composition("sequence").alias("x"), F.lit(None).cast("string").alias("error"))


def pooled(embed: Callable[[list[str]], list[list[list[list[float]]]]], batch_residues: int = 4096) -> Provider:
    """Provider around a model: ``embed`` gives, for a batch of sequences, layers x positions x width; positions are averaged.

    Sequences of a partition are sorted by length and batched up to ``batch_residues``; one that fails alone gives an
    error row instead of a vector.
    """

    def run(rows: DataFrame) -> DataFrame:
        def one(ids: list[int], texts: list[str]) -> list[tuple]:
            try:
                return [(i, k, [sum(c) / len(layer) for c in zip(*layer, strict=True)], None) for i, found in zip(ids, embed(texts), strict=True) for k, layer in enumerate(found)]
            except Exception as why:  # a model's failure is a row, so that the others stay
                if len(ids) == 1:
                    return [(ids[0], -1, None, str(why)[:300])]
                return [r for i, t in zip(ids, texts, strict=True) for r in one([i], [t])]

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                ids, texts, size = [], [], 0
                out: list[tuple] = []
                for i, t in sorted(zip(part["id"], part["sequence"], strict=True), key=lambda r: -len(r[1])):
                    if ids and size + len(t) > batch_residues:
                        out += one(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(int(i))
                    texts.append(t)
                    size += len(t)
                out += one(ids, texts) if ids else []
                yield pd.DataFrame(out, columns=["id", "layer", "x", "error"])

        return rows.select("id", "sequence").mapInPandas(batches, SCHEMA)

    return run


def embed(rows: DataFrame, name: str) -> DataFrame:
    """Vectors of the named provider."""
    if name not in PROVIDERS:
        raise ValueError(f"no embedding provider {name}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name](rows)
