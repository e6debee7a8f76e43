"""Scores of pairs by several methods, kept between runs: a method that broke off goes on at the pairs it lacks.

Scores are appended in parts, each a folder of its own. A part counts once the manifest names it, and the manifest is a
table that is appended to after the part is written. A run that ends between the two leaves a folder nobody reads, and its
pairs are scored again. Missing pairs are dealt out in slices by hash, one part each, so that a long method loses one
slice's work at most.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "method string, part string, n long, seconds double"
Scorer = Callable[[DataFrame], DataFrame]


class ScoreCache:
    """keys name a pair; pairs are rows of them, with whatever a method needs beside."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("query_id", "passage_id")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def manifest(self) -> DataFrame:
        """method, part, n, seconds: a row for each published part."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest") if there else self.spark.createDataFrame([], MANIFEST)

    def scores(self, method: str, like: DataFrame) -> DataFrame:
        """keys and score of the pairs that a method has scored. like: pairs, for the keys' types."""
        parts = [r["part"] for r in self.manifest().where(F.col("method") == method).select("part").distinct().collect()]  # a name for each part
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.select(*self.keys).schema) + ", score double"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def missing(self, method: str, pairs: DataFrame) -> DataFrame:
        """The pairs a method lacks, each once."""
        return pairs.dropDuplicates(self.keys).join(self.scores(method, pairs).select(*self.keys), self.keys, "left_anti")

    def write_part(self, method: str, scored: DataFrame) -> tuple[str, int]:
        """A part (not published yet) and its number of rows."""
        part = f"{uuid.uuid4().hex}"
        scored.select(*self.keys, F.col("score").cast("double").alias("score")).write.parquet(f"{self.path}/parts/{part}")
        return part, self.spark.read.parquet(f"{self.path}/parts/{part}").count()

    def publish(self, method: str, part: str, n: int, seconds: float) -> None:
        self.spark.createDataFrame([(method, part, n, seconds)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def run(self, method: str, pairs: DataFrame, scorer: Scorer, slices: int = 8) -> DataFrame:
        """keys and score of all pairs; scorer (rows of pairs -> rows with score) sees those that the method lacks only."""
        at = F.pmod(F.xxhash64(*self.keys), F.lit(slices))
        lacking = self.missing(method, pairs).withColumn("_slice", at)
        waiting = sorted(r["_slice"] for r in lacking.select("_slice").distinct().collect())
        for s in waiting:
            began = time.time()
            part, n = self.write_part(method, scorer(self.missing(method, pairs).where(at == s)))
            self.publish(method, part, n, time.time() - began)
        return self.scores(method, pairs).join(pairs.select(*self.keys).distinct(), self.keys, "left_semi")

    def timing(self) -> DataFrame:
        """method, n, seconds over all parts, broken runs' too."""
        return self.manifest().groupBy("method").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))

    def table(self, methods: Sequence[str], pairs: DataFrame) -> DataFrame:
        """pairs' keys with a column for each method; null where it has no score yet."""
        own = pairs.select(*self.keys).distinct()
        return reduce(lambda left, m: left.join(self.scores(m, pairs).withColumnRenamed("score", m), self.keys, "left"), methods, own)
