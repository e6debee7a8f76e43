"""Decisions of a stage hold for rows, not for all rows of a doc_id."""

from passant.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string"


def test_a_near_copy_goes_though_its_doc_id_stays_elsewhere(spark):
    words = [f"w{i}" for i in range(400)]
    first, second = " ".join(words[:200]), " ".join(words[200:])
    # doc_id 2 is the smallest of the second component, and a copy of doc_id 1 in the first
    rows = [(1, first), (2, first + " "), (2, second), (3, second + " "), (None, first + "  "), (None, "alone without an id"), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], SCHEMA)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.kept_rows(docs).collect())
    assert kept == sorted([("1", first), ("2", second), ("None", "alone without an id"), ("4", "same")])


def test_a_row_is_sampled_by_its_own_cell(spark):
    rows = [(i, "word " * n, "en", s) for i in range(300) for n, s in ((5, "small"), (1500, "large"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r["doc_id"], r["n_tokens"]) for r in mixing.mix(docs).where("kept").collect())
    got = sorted((r["doc_id"], len(r["text"].split())) for r in mixing.kept_rows(docs).collect())
    assert got == want and len({d for d, _ in got}) * 2 > len(got)


def test_rows_are_picked_by_bitmap_or_by_join(spark, tmp_path):
    """Rows of several files, of which one has more than a bitmap's rows; the first and last row of each; clashing names."""
    from pyspark.sql import functions as F

    from passant.llm.common import located, only_rows

    spark.range(100_000).select("id", F.lit(1).alias("_in"), F.lit(2).alias("_MARKS"), F.lit(3).alias("_bucket")).repartitionByRange(2, F.when(F.col("id") < 90_000, 0).otherwise(1)).write.parquet(f"{tmp_path}/t")
    docs, file, row = located(spark.read.parquet(f"{tmp_path}/t"))
    want = docs.where("id % 7 = 0 OR id IN (1, 32767, 32768, 32769, 65536, 89999, 90000, 99999)")
    ids = sorted(r["id"] for r in want.collect())
    for most in (None, 0):
        got = only_rows(docs, file, row, want.select(file, row), most)
        assert got.columns == docs.columns and sorted(r["id"] for r in got.collect()) == ids
    assert only_rows(docs, file, row, want.limit(0)).count() == 0
