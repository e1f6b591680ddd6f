"""Preparation of embedding vectors: centring, PCA, scaling, unit length, centroids."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.functions.vector import norm, unit


def l2_normalize(df: DataFrame, col: str = "x", out: str = "x") -> DataFrame:
    """The column ``out`` with vectors of unit length; the norm is computed once a row."""
    return df.withColumn("__n", norm(col)).withColumn(out, unit(col, "__n")).drop("__n")


def column_moments(df: DataFrame, col: str = "x") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population deviation, rows) of each dimension: one pass, two arrays of the vectors' width to the driver."""
    got = df.select(array_to_vector(col).alias("v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = int(got["count"])
    mean, var = (np.array(got[k].toArray()) for k in ("mean", "variance"))
    return mean, np.sqrt(var * (n - 1) / max(n, 1)), n


def _array(values: np.ndarray) -> object:
    return F.array(*[F.lit(float(v)) for v in values])


def standardize(df: DataFrame, col: str = "x", out: str = "x") -> DataFrame:
    """Each dimension minus its mean, over its population deviation (1 where that is 0)."""
    mean, dev, n = column_moments(df, col)
    if not n:
        return df.withColumn(out, F.col(col))
    dev = np.where(dev < 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1), 1.0, dev)
    return df.withColumn(out, F.zip_with(F.zip_with(col, _array(mean), lambda v, m: v - m), _array(dev), lambda v, s: v / s))


def project(df: DataFrame, k: int, col: str = "x", out: str = "x") -> DataFrame:
    """Scores on the first ``k`` principal components; centred first, as the fitted model does not subtract the mean."""
    mean, _, _ = column_moments(df, col)
    centred = df.withColumn("__v", array_to_vector(F.zip_with(col, _array(mean), lambda v, m: v - m)))
    fitted = PCA(k=k, inputCol="__v", outputCol="__p").fit(centred.select("__v"))
    return fitted.transform(centred).withColumn(out, vector_to_array("__p")).drop("__v", "__p")


def prepare_embeddings(df: DataFrame, pca_dim: int = 400, scale: bool = True, normalize: bool = True, col: str = "x") -> DataFrame:
    """Adds ``x_pca`` (before scaling) and replaces ``x``: PCA only if 0 < pca_dim < width, then scaling, then unit length."""
    first = df.select(F.size(col)).first()
    width = first[0] if first else 0
    out = project(df, pca_dim, col, "x_pca") if 0 < pca_dim < width else df.withColumn("x_pca", F.col(col))
    out = standardize(out, "x_pca", col) if scale else out.withColumn(col, F.col("x_pca"))
    return l2_normalize(out, col, col) if normalize else out


def centroids(df: DataFrame, label: str = "cluster", col: str = "x") -> DataFrame:
    """(label, n, total array, centroid array) of each label from 0 on; sums stay in the JVM, by position."""
    parts = df.where(F.col(label) >= 0).select(label, F.posexplode(col).alias("pos", "v"))
    sums = parts.groupBy(label, "pos").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "v")))
    return sums.groupBy(label).agg(F.max("n").alias("n"), F.transform(rows, lambda r: r["v"]).alias("total")).withColumn("centroid", F.transform("total", lambda v: v / F.col("n")))
