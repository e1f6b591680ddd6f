"""Result tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the summary: source column and name in the file. Fixed values.
SUMMARY = {
    "level": "level", "n_clusters": "n_clusters", "n_unassigned": "n_singletons", "precision": "pairwise_P", "recall": "pairwise_R", "f1": "pairwise_F1",
    "tp": "TP", "fp": "FP", "fn": "FN", "tn": "TN", "ami": "AMI", "v_measure": "V_measure", "homogeneity": "Homogeneity", "completeness": "Completeness", "combined_score": "score",
    "oto_precision": "oto_P", "oto_recall": "oto_R", "oto_f1": "oto_F1", "otm_precision": "otm_P", "otm_recall": "otm_R", "otm_f1": "otm_F1", "ntm_precision": "ntm_P", "ntm_recall": "ntm_R", "ntm_f1": "ntm_F1",
}


def summary_row(level: str, metrics: DataFrame) -> DataFrame:
    """The 24 summary columns of one evaluated level; missing numbers are 0."""
    named = metrics.withColumn("level", F.lit(level))
    return named.select(*[(F.coalesce(c, F.lit(0.0)) if t == "double" else F.col(c)).alias(SUMMARY[c]) for c, t in ((c, dict(named.dtypes)[c]) for c in SUMMARY)])


def save_results(levels: DataFrame, path: str) -> None:
    """One row a level, as Parquet and as tab-separated text; missing numbers become 0.0, floats get four places."""
    levels.write.mode("overwrite").parquet(f"{path}/levels.parquet")
    shown = [F.format_string("%.4f", F.coalesce(F.col(c), F.lit(0.0))).alias(c) if t in ("double", "float") else F.col(c) for c, t in levels.dtypes]
    levels.select(*shown).coalesce(1).write.mode("overwrite").csv(f"{path}/levels.tsv", sep="\t", header=True)


def save_csv(df: DataFrame, path: str) -> None:
    """A result table as parts with a header line each and no index column."""
    df.write.mode("overwrite").csv(path, header=True)


def save_report(metrics: DataFrame, path: str) -> None:
    """One text line for each layer: precision, recall, F1, purity, entropy."""
    line = F.format_string("layer %s: precision %.4f recall %.4f f1 %.4f purity %.4f entropy %.4f", F.col("layer").cast("string"), "precision", "recall", "f1", "purity", "entropy")
    metrics.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
