"""Blocked dense retrieval against all cosines."""

import numpy as np
import pytest

from passant.operators import dense


def plain(queries, passages, k, own=False):
    out = []
    for qid, q in queries:
        found = []
        for pid, d in passages:
            if qid is None or pid is None or (own and pid == qid) or len(q or []) != len(d or []):
                continue
            a, b = np.array(q or [], float), np.array(d or [], float)
            ok = np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()
            a, b = (v / np.abs(v).max() if ok else v for v in (a, b))
            found.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) + 0.0 if ok else 0.0, pid))
        out += [(qid, pid, round(-s, 6) + 0.0, r) for r, (s, pid) in enumerate(sorted(found)[:k])]
    return sorted(out)


def given(df):
    return sorted((r["query_id"], r["pid"], round(r["score"], 6) + 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_cosines(spark, monkeypatch, kind, most):
    """Several blocks on both sides, ties, copies; broadcast or product of partitions."""
    monkeypatch.setattr(dense, "QUERIES", 7)
    monkeypatch.setattr(dense, "PASSAGES", 20)
    rng = np.random.default_rng(1)
    name = (lambda i: i) if kind == "long" else (lambda i: f"n{i:03}")
    passages = [(name(i), rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(150)]
    queries = [(name(i), passages[i][1]) for i in range(0, 150, 5)]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} {kind}, {b} array<double>").repartition(3)
    for own in (False, True):
        got = dense.top_k(frame(queries, "query_id", "q"), frame(passages, "pid", "d"), 6, other_ids=own, most_values=most)
        assert given(got) == plain(queries, passages, 6, own)


def test_messy_vectors(spark):
    nan = float("nan")
    passages = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [2.0, 1e-3]), (7, [1.0, 0.0, 0.0]), (8, [1e300, 1e300]), (None, [1.0, 0.0])]
    queries = [(10, [1.0, 1.0]), (11, None), (12, [0.0, 1.0, 0.0]), (13, [1.0] * 4), (None, [1.0, 1.0])]
    a, b = spark.createDataFrame(queries, "query_id int, q array<double>"), spark.createDataFrame(passages, "pid int, d array<double>")
    assert given(dense.top_k(a, b, 3)) == plain(queries, passages, 3)
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert dense.top_k(x, y, 3).count() == 0
    with pytest.raises(ValueError):
        dense.top_k(a.selectExpr("cast(query_id AS double) AS query_id", "q"), b, 3)


def test_few_results_are_shuffled(spark, monkeypatch):
    """k results for each query and block at most."""
    monkeypatch.setattr(dense, "PASSAGES", 100)
    rng = np.random.default_rng(2)
    passages = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(2000)], "pid long, d array<double>").repartition(2)
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(10)], "query_id long, q array<double>")
    assert dense.blocks(passages, "pid", "d", 100).count() == 20
    plan = dense.top_k(queries, passages, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning(query_id") == 1
    assert plan.count("WindowGroupLimit") == 2  # each task cuts to k before the shuffle
    score = rng.normal(size=(10, 100))
    assert all(len(p) == 3 for p in dense.best_of_block(score, np.arange(100), 3))
