"""Exact deduplication as a stateful stream, in DataFrame operations only.

A streaming aggregation keeps, in RocksDB on the executors' disks and without expiry, one state row for each
digest: the stable identifier (the largest doc_id) and the content locator (file and row) of the row that stays, and
how many rows there are. Every micro-batch appends the state rows it changed; as the stable identifier and the count
only grow, the latest version of a digest is their maximum, and a batch that is run again overwrites its own folder.

Digests that were hit more than once are then checked on their full bytes: their rows' texts are grouped by digest
and whole text, salted and pre-aggregated, so that a hot group neither meets in one task nor moves more than once a
task. Should a digest stand for two texts, its rows are regrouped by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.llm.common import Scan, located, materialize, only_rows, scan_of, shared_dir, whole_text

#: State on disk; many small stores would each reserve disk ahead of what they write, and memory outside the heap. All
#: stores of an executor share a bounded cache, have small write buffers, and those of an ended query are closed soon.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
SALTS = 32


def _located(docs: DataFrame) -> DataFrame:
    place = docs.metadataColumn("_metadata")
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return docs.select(_digest(F.col("text")).alias("digest"), at.alias("at"), whole_text(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(whole_text(text), 256))


def build_state(scan: Scan, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over the files of a scan and return its state: digest, at (doc_id, file, row), group_size."""
    docs, folder, names = scan
    spark = docs.sparkSession
    base = shared_dir(spark)
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        reader = spark.readStream.schema(docs.schema).option("pathGlobFilter", names)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = _located(reader.parquet(folder)).groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("group_size"))

        def append(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/versions/batch={number}")

        state.writeStream.outputMode("update").foreachBatch(append).trigger(availableNow=True).option("checkpointLocation", f"{base}/stream").start().awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    written = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(f"{base}/versions")
    return written.groupBy("digest").agg(F.max("at").alias("at"), F.max("group_size").alias("group_size"))


def _classes(docs: DataFrame, state: DataFrame) -> DataFrame:
    """For each digest hit more than once, its distinct whole texts with the row that stays and the count of rows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    hits = state.where("group_size > 1").select("digest", salts.alias("salt"))
    rows = _located(docs).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    return rows.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "text").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; others are not read).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays
    (a null doc_id counts as smallest; among rows that repeat that doc_id, the last by file and row). An empty table
    gives an empty result.
    """
    return _rows(*_decide(scan_of(docs, ("doc_id", "text")), files_per_batch)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def kept_rows(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    One row of each group of equal texts, null and empty being equal: the one with the largest doc_id (a null doc_id
    counts as smallest), of rows that repeat it the last by file and row. An empty table gives an empty result.
    """
    scan = scan_of(docs)
    _, state, split = _decide(scan, files_per_batch)
    if split is not None:
        state = state.join(split.select("digest").distinct(), "digest", "left_anti").unionByName(split.select("digest", "at", "group_size"))
    rows, file, row = located(scan.docs)
    stay = state.select(F.col("at.file").alias(file), F.col("at.row").alias(row))
    return only_rows(rows, file, row, stay).drop(file, row)


def _decide(scan: Scan, files_per_batch: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs, the state, and the classes of digests that stand for more than one text (None: there are none)."""
    docs = scan.docs
    if not docs.inputFiles():
        empty = _located(materialize(docs.select("doc_id", "text"))).select("digest", "at", F.lit(1).cast("long").alias("group_size")).limit(0)
        return docs, empty, None
    state = materialize(build_state(scan, files_per_batch))
    # the texts are needed for the check only, not in what it returns
    many = _classes(docs, state).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if not many.take(1):
        return docs, state, None
    many = materialize(many)
    return docs, state, materialize(_classes(docs, state).join(many, "digest", "left_semi"))


def _rows(docs: DataFrame, state: DataFrame, split: DataFrame | None) -> DataFrame:
    rows = _located(docs)
    if split is None:
        joined = rows.select("digest", "at").join(state.withColumnRenamed("at", "keep"), "digest")
    else:
        alone = state.join(split.select("digest").distinct(), "digest", "left_anti").withColumnRenamed("at", "keep")
        joined = rows.select("digest", "at").join(alone, "digest").unionByName(rows.join(split.withColumnRenamed("at", "keep"), ["digest", "text"]).drop("text"))
    return joined.select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("at.file") == F.col("keep.file")) & (F.col("at.row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
