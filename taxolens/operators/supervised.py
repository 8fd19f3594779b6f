"""T3 supervised control: multinomial logistic regression on an 80/20 hash split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.metrics import contingency, external_metrics
from taxolens.schema import ROW_ID, SEED, TRUTH


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: a row is in the test set when its seeded hash falls below test_size.

    Order- and partition-independent; null labels are dropped first (F3).
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(ROW_ID).cast("string"))), 1, 8), 16, 10)
         .cast("double") / float(16 ** 8))
    return df.filter(F.col(TRUTH).isNotNull()).withColumn("is_test", u < test_size)


def run_baseline(df: DataFrame, features: str = "features", test_size: float = 0.2, seed: int = SEED,
                 max_iter: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Returns (one-row metrics, test predictions).

    regParam = 1/n_train with elasticNet 0 and no standardisation equals an
    L2 penalty of C = 1 on the summed loss (the reference's defaults).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    split = train_test_split(df, test_size, seed).withColumn("_v", array_to_vector(features))
    idx = StringIndexer(inputCol=TRUTH, outputCol="_y", stringOrderType="alphabetAsc").fit(split)
    data = idx.transform(split).persist()
    train = data.filter(~F.col("is_test"))
    n_train = train.count()
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", maxIter=max_iter,
                            regParam=1.0 / max(1, n_train), elasticNetParam=0.0, standardization=False)
    model = lr.fit(train)
    pred = model.transform(data.filter(F.col("is_test")))
    pred = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=idx.labels).transform(pred)
    pred = pred.select(ROW_ID, TRUTH, "predicted_label")
    cont = contingency(pred.withColumnRenamed("predicted_label", "cluster"), TRUTH, "cluster")
    ext = external_metrics(cont, ["nmi", "ari"])
    acc = pred.agg(F.avg(F.when(F.col(TRUTH) == F.col("predicted_label"), 1.0).otherwise(0.0)).alias("purity"),
                   F.lit(len(idx.labels)).alias("n_clusters"))
    from taxolens.operators.metrics import join_single_rows
    metrics = join_single_rows(acc, ext).select(
        "purity", "nmi", "ari", F.lit(0.0).alias("silhouette"), "n_clusters",
        F.lit(0.0).alias("noise_ratio"), F.lit("LogisticRegression(Default)").alias("best_params"))
    return metrics, pred
