"""The session that the engine is meant to run in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow transfer, ANSI arithmetic and UTC; everything else is the cluster's."""
    builder = SparkSession.builder.appName("passant")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = current.get()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/passant-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in a shared folder, for plans that read it several times; df itself where no such folder is set."""
    try:
        path = shared_folder(df.sparkSession)
    except ValueError:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, task_mb: float = 2, least: int = 0) -> DataFrame:
    """df partitioned by keys, in as many parts as the files it reads have task_mb (a file's columns are several times larger
    in memory), so that what a task sorts or counts doesn't grow with the table. Smaller inputs go by the session's settings, or
    in so many parts at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = -(-sum(x for x in sizes if x < 1 << 50) // int(task_mb * (1 << 20)))  # rows from the driver have no size
    return df.repartition(max(n, least), *keys) if least or n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)
