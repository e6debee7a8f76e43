"""A growing corpus: micro-batches of passages are scored and merged into each query's best k so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passant.functions import text as X
from passant.operators import retrieval


def merged(kept: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """The best k of both; merging is associative, so batches may come in any order."""
    return retrieval.top_k(kept.select("query_id", "pid", "score").unionByName(more.select("query_id", "pid", "score")), k)


def score_batch(corpus: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, pid, score of a batch under fixed corpus statistics (weights: query_id, term, idf, avgdl)."""
    tokens = corpus.select("pid", X.tokenize(F.col("text")).alias("toks")).select("pid", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    tf = tokens.groupBy("pid", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(weights, "term").groupBy("query_id", "pid").agg(F.sum(retrieval.weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def stream_top_k(spark: SparkSession, stream: DataFrame, weights: DataFrame, k: int, out: str, checkpoint: str) -> DataFrame:
    """Run the stream (pid, text) over what has arrived; returns the table of bests. Each batch writes a new version from
    the one before, so a batch that is run again gives the same table. A restart without new rows returns the table of the
    last committed batch; a stream that never had a row, an empty table."""

    def merge(batch: DataFrame, number: int) -> None:
        found = score_batch(batch, weights)
        last = f"{out}/version={number - 1}"
        before = spark.read.parquet(last) if number else found.limit(0)
        merged(before, found, k).write.mode("overwrite").parquet(f"{out}/version={number}")

    query = stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    last = _committed(spark, checkpoint)
    if last is None:
        kinds = [f"query_id {weights.schema['query_id'].dataType.simpleString()}", f"pid {stream.schema['pid'].dataType.simpleString()}", "score double", "rank int"]
        return spark.createDataFrame([], ", ".join(kinds))
    return spark.read.parquet(f"{out}/version={last}")


def stream_bm25(spark: SparkSession, stream: DataFrame, queries: DataFrame, k: int, out: str, checkpoint: str) -> DataFrame:
    """Exact BM25 top-k of all passages (pid, text) so far while the corpus statistics change with every batch.

    What is kept of a batch is how often its passages hold the queries' terms, and its size, in a folder of its own; no text
    and no other term. After each batch, the table of bests is ranked anew from what is kept, under the statistics of all
    rows so far, so version n equals a run over everything up to batch n. A batch that is run again writes the same folders.
    A pid arrives once. Returns the last committed version; a restart goes on from it.
    """
    terms = retrieval.vocabulary(queries).cache()

    def merge(batch: DataFrame, number: int) -> None:
        tokens = retrieval.tokens_of(batch)
        retrieval.term_frequencies(tokens, terms).write.mode("overwrite").parquet(f"{out}/terms/batch={number}")
        tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("length")).write.mode("overwrite").parquet(f"{out}/sizes/batch={number}")
        so_far = F.col("batch") <= number
        tf = spark.read.parquet(f"{out}/terms").where(so_far).drop("batch")
        n = F.sum("n")
        sizes = spark.read.parquet(f"{out}/sizes").where(so_far).agg(n.alias("n_docs"), (F.sum("length") / F.greatest(n, F.lit(1))).alias("avgdl"))
        retrieval.ranked(tf, terms, sizes, k).write.mode("overwrite").parquet(f"{out}/version={number}")

    query = stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    try:
        query.awaitTermination()
    finally:
        terms.unpersist()
    last = _committed(spark, checkpoint)
    if last is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, pid {stream.schema['pid'].dataType.simpleString()}, score double, rank int")
    return spark.read.parquet(f"{out}/version={last}")


def _committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The number of the stream's last committed batch, by the names in its commit log."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n) for n in names if n.isdigit()), default=None)
