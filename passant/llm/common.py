"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; without that setting, an error, as a
    machine's own folder would lose what executors write."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and (current := context._jsc.sc().getCheckpointDir()).isDefined():
        base = current.get()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/passant-{uuid.uuid4().hex}"


def materialize(df: DataFrame, where: str | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scan(NamedTuple):
    """A scan of Parquet files, the folder that holds them and a filter on their names that selects just them."""

    docs: DataFrame
    folder: str
    names: str


def scan_of(docs: DataFrame, columns: tuple[str, ...] = ()) -> Scan:
    """docs as a plain Parquet scan of one file or one whole folder, so that every row has a file and an index and a
    stream reads the same files. Anything else (a list of files, another format, partitions in folder names, reader
    options, a path with glob characters, a computed frame) is written first, of which only the columns given are needed."""
    where = _root(docs)
    if where is None:
        docs = materialize(docs.select(*columns) if columns else docs)
        where = _root(docs)
    files = docs.inputFiles()
    if len(files) == 1 and _bare(unquote(files[0])) == _bare(where):
        return Scan(docs, *where.rsplit("/", 1))
    return Scan(docs, where, "*")


def _bare(path: str) -> str:
    return path.partition(":")[2].lstrip("/")


def _root(docs: DataFrame) -> str | None:
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    relation = plan.relation()
    options = relation.options().keySet().mkString("|").lower()
    paths = relation.location().rootPaths().mkString("\n").split("\n")
    plain = relation.fileFormat().toString() == "Parquet" and relation.partitionSchema().isEmpty() and options in ("", "path") and relation.location().getClass().getSimpleName() == "InMemoryFileIndex"
    return paths[0] if plain and len(paths) == 1 and not set("[]{}*?\\%") & set(paths[0]) else None


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs (a scan) with the file and index of each row, and the names of these two columns, which docs doesn't have."""
    file, row = fresh(docs, "_file"), fresh(docs, "_row")
    where = docs.metadataColumn("_metadata")
    return docs.select("*", where["file_path"].alias(file), where["row_index"].alias(row)), file, row


#: Bitmaps of 32 768 rows (4 KB each) that are broadcast at most.
MOST_MARKS = 16_384


def only_rows(docs: DataFrame, file: str, row: str, stay: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of docs (with their file and index) that stay names by file and row, without moving them.

    What stays is a bitmap for each file and 32 768 rows, which is broadcast after it was counted; beyond the bound rows
    are joined by shuffle. Names of docs can't clash with what is joined.
    """
    names = {c: fresh(docs, c) for c in ("_in", "_bucket", "_marks")}
    bucket, bit = F.bitmap_bucket_number(F.col(row)), F.bitmap_bit_position(F.col(row))
    marks = materialize(stay.groupBy(F.col(file).alias(names["_in"]), bucket.alias(names["_bucket"])).agg(F.bitmap_construct_agg(bit).alias(names["_marks"])))
    if marks.limit((most or MOST_MARKS) + 1).count() > (MOST_MARKS if most is None else most):
        return docs.join(stay.select(file, row), [file, row], "left_semi").select(*docs.columns)
    byte = F.conv(F.hex(F.substr(F.col(names["_marks"]), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = docs.join(F.broadcast(marks), (F.col(file) == F.col(names["_in"])) & (bucket == F.col(names["_bucket"])))
    return joined.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), bit % 8)), F.lit(2)) == 1).drop(*names.values())


def fresh(docs: DataFrame, name: str) -> str:
    """name, with underscores in front until no column is called so (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def whole_text(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """The first 128 bits of SHA-256 over the UTF-8 bytes, as binary."""
    return F.substring(F.unhex(F.sha2(whole_text(text), 256)), 1, 16)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array without nulls."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def runs_of(offsets: np.ndarray, limit: int):
    """Consecutive row ranges (i, j) whose bytes stay below limit, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
