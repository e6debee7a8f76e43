"""Scans and sinks: JSON lines, JSON arrays, zip archives, corpora, resumable and keyed tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passant.functions import text as X
from passant.schemas import CORPUS_LINE


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object a line; blank lines are skipped. Without a schema it is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """name, content (text) of an archive's members, one archive a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(z.namelist()):
                        if not name.endswith("/"):
                            yield pd.DataFrame({"name": [f"/{name}"], "content": [z.read(name).decode()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "name string, content string")


def corpus(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """pid, title, body, text of corpus lines {"id", "contents"}, and columns to keep: the title is the first line without
    its quotes."""
    row = F.from_json(column, CORPUS_LINE)
    return lines.where(F.trim(column) != "").select(*keep, row.alias("r")).select(*keep, F.col("r.id").cast("string").alias("pid"), X.title_of(F.col("r.contents")).alias("title"), X.body_of(F.col("r.contents")).alias("body"), F.col("r.contents").alias("text"))


def write_table(df: DataFrame, path: str, by: str = "dataset", force: bool = False) -> None:
    """Partitioned by a column; partitions that exist stay as they are, so a run that broke off goes on where it stopped.

    force: they are replaced instead, and only those that df holds.
    """
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    if not there or force:
        df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        return
    done = spark.read.parquet(path).select(F.col(by).cast(df.schema[by].dataType)).distinct()
    df.join(done, by, "left_anti").write.partitionBy(by).mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, label_source: str | None = None) -> DataFrame:
    """A feature table; a label source, where it is a partition column, prunes files."""
    df = spark.read.parquet(path)
    return df if label_source is None else df.where(F.col("label_source") == label_source)


def write_labelled(pairs: DataFrame, path: str) -> None:
    """JSON lines, one a query, with its passages in place order (query_id, query, place, and what describes a passage)."""
    rest = [c for c in pairs.columns if c not in ("query_id", "query")]
    nested = pairs.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in rest if c != "place"]))).alias("passages"))
    nested.write.mode("overwrite").json(path)


def write_stats(stats: DataFrame, df: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    df.write.mode("overwrite").parquet(f"{path}/df")


def read_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/df")


def seen_ids(tables: list[DataFrame]) -> DataFrame:
    """key: dataset:query_id of earlier items, each once."""
    out = None
    for t in tables:
        keys = t.select(F.concat_ws(":", "dataset", F.col("query_id").cast("string")).alias("key"))
        out = keys if out is None else out.unionByName(keys)
    return out.distinct()
