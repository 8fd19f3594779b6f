"""Error analysis (R9): majority-label prediction, misclassified rows, confusion matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.reports import majority_label, top_categories
from taxolens.schema import CLUSTER, ROW_ID, TRUTH


def predict_majority(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """Attach ``predicted_label`` = cluster's majority label; noise → 'Noise'.

    The cluster→label map has one row per cluster; AQE broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise.
    """
    m = majority_label(df, truth, cluster).withColumnRenamed(CLUSTER, "_c")
    return (df.join(m, df[cluster] == m["_c"], "left").drop("_c")
            .withColumn("predicted_label", F.coalesce("majority_label", F.lit("Noise")))
            .drop("majority_label"))


def is_error(truth: str = TRUTH, pred: str = "predicted_label"):
    """prediction differs from truth; a null truth always counts as an error."""
    return ~F.col(pred).eqNullSafe(F.col(truth))


def misclassified(pred: DataFrame, truth: str = TRUTH) -> DataFrame:
    return pred.filter(is_error(truth))


def error_rate(pred: DataFrame, truth: str = TRUTH) -> DataFrame:
    """Errors / all rows."""
    return pred.agg(F.avg(F.when(is_error(truth), 1.0).otherwise(0.0)).alias("error_rate"))


def error_examples(pred: DataFrame, n: int = 500, extra_cols=("ProductName", "Brand"),
                   truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """R9 CSV: first n misclassified rows in row order with the reference's columns."""
    cols = [F.col(truth).alias("true_label"), "predicted_label", F.col(cluster).alias("cluster"), "Title"]
    cols += [c for c in extra_cols if c in pred.columns]
    return misclassified(pred, truth).orderBy(ROW_ID).limit(n).select(*cols)


def confusion_matrix(pred: DataFrame, top_n: int = 20, truth: str = TRUTH) -> DataFrame:
    """Long-form confusion counts over the top-n true categories, zero-filled.

    The top-n list is at most ``top_n`` rows, so the label grid is built by
    exploding that bounded list — never by joining row sets.
    """
    top = top_categories(pred, top_n, truth).select(TRUTH)
    names = [r[0] for r in top.collect()]  # ≤ top_n strings
    sub = pred.filter(F.col(truth).isin(names) & F.col("predicted_label").isin(names))
    counts = (sub.groupBy(F.col(truth).alias(TRUTH), "predicted_label")
              .agg(F.count(F.lit(1)).alias("n")))
    grid = top.select(TRUTH, F.explode(F.array(*[F.lit(x) for x in names])).alias("predicted_label"))
    return (grid.join(counts, [TRUTH, "predicted_label"], "left")
            .select(TRUTH, "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
