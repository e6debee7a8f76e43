"""Streamed zip archives against Python's own reader."""

import json
import os
import random
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from passant.operators import retrieval
from passant.sources import archives, files


def lines_of(path):
    with zipfile.ZipFile(path) as z:
        return [x.decode() for x in z.read(z.namelist()[0]).split(b"\n") if x.strip()]


def write(path, text, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("lines.jsonl", text)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_splits_and_archives(spark, tmp_path, small_splits):
    """Bytes survive: every split and chunk border, line feeds inside the stream, carriage returns, any script."""
    rng = random.Random(1)
    for k in range(3):
        text = "\n".join(rng.choice(["", "   ", "\r", "é日本" * 3, rng.randbytes(rng.randint(1, 300)).hex() + "\r"]) for _ in range(9000 if k < 2 else 3))
        write(tmp_path / f"{k}.zip", text + "\n" * k)
    chunks = archives.archive_chunks(spark, f"file://{tmp_path}/*.zip", chunk=5000)
    assert chunks.select("archive", "block").distinct().count() > 10
    for k in range(3):
        data = b"".join(r["data"] for r in chunks.where(F.col("archive").endswith(f"/{k}.zip")).orderBy("block", "seq").collect())
        whole = (tmp_path / f"{k}.zip").read_bytes()
        assert data in (whole, whole + b"\n")
    got = archives.inflated_lines(chunks).collect()
    for k in range(3):
        own = sorted((r["place"], r["value"]) for r in got if r["archive"].endswith(f"/{k}.zip"))
        assert [v for _, v in own] == lines_of(tmp_path / f"{k}.zip") and [p for p, _ in own] == list(range(len(own)))


def test_well_compressed_and_long_lines(spark, tmp_path):
    text = "\n".join(["a" * 30_000_000, *["same line"] * 200_000, "last without a line feed"])
    write(tmp_path / "c.zip", text)
    got = archives.zipped_lines(spark, f"file://{tmp_path}/c.zip", 4)
    assert got.rdd.getNumPartitions() == 4
    assert got.agg(F.count("*"), F.max(F.length("value")), F.sum(F.length("value").cast("long"))).first()[:] == (200_002, 30_000_000, 30_000_000 + 9 * 200_000 + 24)


def test_pieces_are_bounded():
    import zlib

    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = deflate.compress(b"x\n" * 40_000_000) + deflate.flush()
    state = archives.Inflater()
    sizes = [len(x) for x in state.feed(archives.SIGNATURE + bytes(4) + b"\x08\x00" + bytes(20) + body)]
    assert sum(sizes) == 40_000_000 and max(sizes) <= archives.BYTES_A_BATCH and state.last() == []


def test_what_is_no_deflated_archive(spark, tmp_path):
    write(tmp_path / "stored.zip", "line\n", zipfile.ZIP_STORED)
    (tmp_path / "short.zip").write_bytes(b"PK")
    (tmp_path / "other.zip").write_bytes(os.urandom(100))
    for name in ("stored", "short", "other"):
        with pytest.raises(PythonException, match="deflated"):
            archives.zipped_lines(spark, f"file://{tmp_path}/{name}.zip").collect()
    (tmp_path / "empty.zip").write_bytes(b"")
    write(tmp_path / "blank.zip", "\n  \n")
    assert archives.zipped_lines(spark, f"file://{tmp_path}/empty.zip").count() == archives.zipped_lines(spark, f"file://{tmp_path}/blank.zip").count() == 0


def test_round_trip_and_ranking(spark, tmp_path):
    """What is written as archives is read by any other reader, and ranks as the table does."""
    rows = [(i, f'"T{i}"\n{" ".join(random.Random(i).choice("paris rome cats dogs rivers".split()) for _ in range(30))}') for i in range(400)]
    docs = spark.createDataFrame(rows, "pid long, text string")
    lines = docs.select(F.concat(F.lit("a"), (F.col("pid") % 3).cast("string")).alias("archive"), F.col("pid").alias("place"), F.to_json(F.struct(F.col("pid").cast("string").alias("id"), F.col("text").alias("contents"))).alias("value"))
    chunks = archives.deflated_chunks(lines, chunk=500)
    for name in ("a0", "a1", "a2"):
        (tmp_path / f"{name}.zip").write_bytes(b"".join(r["data"] for r in chunks.where(F.col("archive") == name).orderBy("seq").collect()))
    got = files.corpus(archives.zipped_lines(spark, f"file://{tmp_path}/*.zip"))
    assert sorted((int(r["pid"]), r["text"]) for r in got.collect()) == rows
    questions = spark.createDataFrame([(1, "cats in Paris"), (2, "rivers")], "query_id long, query string")
    rank = lambda c: sorted((r["query_id"], int(r["pid"]), round(r["score"], 9), r["rank"]) for r in retrieval.bm25_top_k(c, questions).collect())
    assert rank(got.withColumn("pid", F.col("pid").cast("long"))) == rank(docs)
    assert json.loads(archives.inflated_lines(chunks).where("archive = 'a0' AND place = 1").first()["value"])["id"] == "3"
