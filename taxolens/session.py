"""Session construction and lineage cutting.

Library code never sets cluster-level settings; ``local_session`` is for
tests, the bench and the smoke entry point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "taxolens") -> SparkSession:
    """A local session configured like a small cluster (AQE on, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is
    used as is. Only when it is unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="taxolens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) of an iterative state."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for the state of a loop whose rounds join or cogroup.

    A checkpoint keeps its plan's estimate of size, and a join's is the product of its sides': over the rounds it
    grows to numbers of millions of digits, which take the driver's memory and time. The plan of persisted rows has
    their measured size.
    """
    kept = df.persist()
    try:
        kept.count()
        return cut_lineage(kept.select("*"))
    finally:
        kept.unpersist()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``taxolens`` importable in Python workers (Arrow UDF closures refer to it).

    Zips the package once per SparkContext and registers it with ``addPyFile``;
    Spark copies the archive to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import taxolens
    pkg = os.path.dirname(os.path.abspath(taxolens.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="taxolens-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
