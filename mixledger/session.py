"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(name: str = "mixledger", cores: str | int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster job brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.driver.extraJavaOptions": "-Xss8m",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder, so a lost executor costs a re-read.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local session without one gets
    a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over every core, for work that costs far more per row than moving the row does.

    Few bytes of distinct labels would otherwise be coalesced into one or two tasks.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
