"""Out-of-fold probes against ridges fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passant.operators import probes


def table(spark, width, queries=40, size=4, seed=0, more=()):
    rng = np.random.default_rng(seed)
    direction = rng.normal(size=width)
    rows = []
    for q in range(queries):
        level = rng.normal(size=width) * 3
        for p in range(size if q else 40):  # one query has many rows
            x = (rng.normal(size=width) + level).astype(np.float32)
            rows.append((q, p, x.tolist(), float(x @ direction / np.sqrt(width) + rng.normal() * 0.1), q % 4 != 0))
    return spark.createDataFrame([*rows, *more], "query_id int, passage_id int, h array<float>, y double, train boolean")


def plain(rows, width):
    """The same from matrices of the rows themselves; rows are dicts with fold."""
    def centred(part):
        out = np.zeros((len(part), width + 1))
        for q in {r["query_id"] for r in part}:
            at = [i for i, r in enumerate(part) if r["query_id"] == q]
            x = np.array([[*part[i]["h"], part[i]["y"]] for i in at], float)
            out[at] = x - x.mean(axis=0)
        return out

    want = {}
    for f in {r["fold"] for r in rows}:
        x = centred([r for r in rows if r["fold"] is not None and r["fold"] != f])
        sd = np.sqrt((x[:, :-1] ** 2).mean(axis=0)) + 1e-6
        z = x[:, :-1] / sd
        w = np.linalg.solve(z.T @ z + 10.0 * len(x) * np.eye(width), z.T @ x[:, -1]) / sd
        own = [r for r in rows if r["fold"] == f]
        for r, s in zip(own, centred(own)[:, :-1] @ w, strict=True):
            want[r["query_id"], r["passage_id"]] = s
    return want


@pytest.mark.parametrize(("width", "tile", "block"), [(5, 512, 1024), (7, 3, 2), (12, 4, 3)])
def test_out_of_fold_scores(spark, monkeypatch, width, tile, block):
    monkeypatch.setattr(probes, "TILE", tile)
    monkeypatch.setattr(probes, "ROWS", block)
    got = [r.asDict() for r in probes.with_probe(table(spark, width).repartition(5), "h", "y", "train", 3).collect()]
    assert {r["fold"] for r in got if r["train"]} == {1, 2, 3} and {r["fold"] for r in got if not r["train"]} == {None}
    want = plain(got, width)
    assert len(want) == len(got) and all(r["probe"] == pytest.approx(want[r["query_id"], r["passage_id"]], rel=1e-7, abs=1e-9) for r in got)
    rho = np.corrcoef([r["probe"] for r in got], [r["y"] - np.mean([s["y"] for s in got if s["query_id"] == r["query_id"]]) for r in got])[0, 1]
    assert rho > 0.7  # rows it never saw


def test_messy_rows(spark):
    more = [(90, 0, None, 1.0, True), (90, 1, [1.0], 1.0, False), (91, 0, [1.0] * 5, None, True), (None, 0, [0.5] * 5, 1.0, False)]
    got = {(r["query_id"], r["passage_id"]): r for r in probes.with_probe(table(spark, 5, more=more), "h", "y", "train", 3).collect()}
    assert got[90, 0]["probe"] is None and got[90, 1]["probe"] is None and got[91, 0]["probe"] == 0.0 and got[None, 0]["probe"] == 0.0
    empty = probes.with_probe(table(spark, 5).limit(0), "h", "y", "train")
    assert empty.count() == 0 and {"fold", "probe"} <= set(empty.columns)


def test_a_wide_probe(spark):
    """The width of a large model's hidden states: tiles of columns, no plan that grows with the width."""
    width = 3584
    rows = table(spark, width, queries=24)
    got = probes.with_probe(rows, "h", "y", "train", 2)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000
    held = [r.asDict() for r in got.collect()]
    want = plain(held, width)
    assert all(r["probe"] == pytest.approx(want[r["query_id"], r["passage_id"]], rel=1e-6, abs=1e-8) for r in held)
