"""Retrieval against brute force, retriever features, metrics and their properties."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passant.operators import metrics, retrieval

DOCS = ["Paris is the capital of France", "Cats sleep all day", "France borders Spain", "The capital city", "dogs and cats", "Paris Paris Paris"] * 5
ASKED = {"a": "capital of France", "b": "cats", "c": "zzz"}


def brute(k):
    stop = set(__import__("passant.functions.text", fromlist=["x"]).STOPWORDS)
    toks = [[w for w in d.lower().split() if w not in stop] for d in DOCS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for q, text in ASKED.items():
        terms = list(dict.fromkeys(w for w in text.lower().split() if w not in stop))
        hits = []
        for i, t in enumerate(toks):
            c, s = Counter(t), 0.0
            for w in terms:
                df = sum(w in x for x in toks)
                if c[w]:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if any(c[w] for w in terms):
                hits.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(hits)[:k]]
    return out


def test_bm25_is_exact(spark):
    corpus = spark.createDataFrame(list(enumerate(DOCS)), "pid long, text string")
    asked = spark.createDataFrame(list(ASKED.items()), "query_id string, query string")
    got = retrieval.bm25_top_k(corpus, asked, 4).collect()
    assert {q: [r["pid"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in ASKED} == brute(4)


@pytest.mark.parametrize(
    ("scores", "norm", "rank", "gap"),
    [([2, 8, 4], [0.25, 1, 0.5], [2, 0, 1], [0, 0.5, 0.25]), ([5, 5, 1], [1, 1, 0.2], [0, 1, 2], [0, 0.8, 0]), ([0, 0], [0, 0], [0, 1], [0, 0])],
)
def test_candidate_scores(spark, scores, norm, rank, gap):
    rows = spark.createDataFrame([("q", i, float(s)) for i, s in enumerate(scores)], "query_id string, pid int, score double")
    got = retrieval.candidate_scores(rows).orderBy("pid").collect()
    assert [r["bm25_norm"] for r in got] == pytest.approx(norm)
    assert [r["rank"] for r in got] == rank
    assert [r["score_gap"] for r in got] == pytest.approx(gap)


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id string, passage_id int, y double, score double")


def test_constant_queries(spark):
    rows = scored(spark, [("flat", 0, 1.0, 0.1), ("flat", 1, 1.0, 0.2), ("same", 0, 0.0, 1.0), ("same", 1, 1.0, 1.0), ("single", 0, 1.0, 1.0)])
    assert [(r["query_id"], r["spearman"]) for r in metrics.per_query_scores(rows).collect()] == [("same", 0.0)]
    assert metrics.per_query_scores(rows, strict=True).count() == 0


def test_pooled_is_not_within(spark):
    rng = np.random.default_rng(1)
    rows = [(f"q{q}", p, float(q + 0.1 * rng.normal()), float(q + 0.1 * rng.normal())) for q in range(30) for p in range(6)]
    got = metrics.ranking_summary(scored(spark, rows)).first()
    assert got["rho"] > 0.9 and abs(got["spearman"]) < 0.3


def test_affine_calibration_keeps_spearman(spark):
    rng = np.random.default_rng(2)
    rows = scored(spark, [(f"q{i % 5}", i, float(rng.normal()), float(rng.normal())) for i in range(40)])
    a = metrics.per_query_scores(rows).orderBy("query_id").collect()
    b = metrics.per_query_scores(rows.withColumn("score", 3 * F.col("score") + 1)).orderBy("query_id").collect()
    assert [r["spearman"] for r in a] == pytest.approx([r["spearman"] for r in b], abs=1e-12)


def test_empty_tables(spark):
    empty = scored(spark, [])
    assert metrics.per_query_scores(empty).count() == 0
    assert metrics.global_spearman(empty).first()["rho"] == 0.0
    assert metrics.mrr(empty.withColumn("rank", F.lit(1))).first()["mrr"] == 0.0


def test_groups_are_sorted_once_and_keep_nulls(spark):
    """One shuffle and one sort, whatever is ranked; window after window of sorts grew with the table."""
    rows = spark.createDataFrame([(q, p, None if p == 3 else float(p % 4), float("nan") if p == 5 else float(p // 2)) for q in (1, 2, None) for p in range(9)], "query_id int, passage_id int, y double, score double")
    got = metrics.per_query_scores(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    found = {r["query_id"]: tuple(r)[1:] for r in got.collect()}
    assert len(found) == 3 and found[1] == found[2] == found[None]
    # by hand: scores 0 0 1 1 2 nan 3 3 4 and y 0 1 2 null 0 1 2 3 0; the NaN is the best score
    rs, ry = [1.5, 1.5, 3.5, 3.5, 5, 9, 6.5, 6.5, 8], [3, 5.5, 7.5, 1, 3, 5.5, 7.5, 9, 3]
    assert abs(found[1][0] - float(np.corrcoef(rs, ry)[0, 1])) < 1e-12 and found[1][2] == 0.0


def test_terms_are_counted_where_documents_lie(spark, monkeypatch):
    """Tables of terms and of scores are those of a part's documents, and parts follow the size of the input; they were
    those of a scan's split or of a fixed number of tasks, and were shuffled by document and term."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("pid"), "text")
    asked = spark.createDataFrame([(1, "the river and a house")], "query_id int, query string")
    plan = retrieval.bm25_top_k(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((pid|query_id)#\d+L?, (dl|pid)#", plan)
    whole = retrieval.tokens_of(docs)
    monkeypatch.setattr(retrieval, "TASK_MB", 0.001)
    many = retrieval.tokens_of(docs)
    assert many.rdd.getNumPartitions() > 50 > whole.rdd.getNumPartitions()
    assert many.agg(F.sum("dl")).first() == whole.agg(F.sum("dl")).first()
