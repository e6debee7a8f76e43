"""The pipeline's stages against brute force, one after the other, and the registered queries."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from test_near_texts import plain_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        path = f"file://{tmp_path}/{number}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        assert kept <= set(before) and kept
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and all(before[r["doc_id"]] == r for r in after)
        if name == "quality_classifier":
            labels = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SF}/labels.parquet')").fetchall()}
            good = [d for d, q in labels.items() if q == 1]
            assert np.mean([d in kept for d in good]) > 0.9
        elif name == "exact_dedup":
            last = {}
            for d, r in before.items():
                digest = hashlib.sha256((r["text"] or "").encode()).digest()
                last[digest] = max(last.get(digest, -1), d)
            assert kept == set(last.values())
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            members, _ = plain_components([(d, before[d]["text"]) for d in ids])
            assert kept == {ids[min(m)] for m in members}
        elif name == "best_fit_packing":
            places = defaultdict(int)
            for r in after:
                places[r["sequence_id"]] += r["length"]
            assert kept == set(before) and max(places.values()) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op") or n == "pipeline"))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in result.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in got.collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
