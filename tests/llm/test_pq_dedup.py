"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from passant.llm import pq_dedup


def plain(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs of rows (vec_id, embedding, label)."""
    fits = [r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    dim = max((len(r[1]) for r, f in zip(rows, fits, strict=True) if f), default=1)
    x = np.array([[*r[1], *[0.0] * (dim - len(r[1]))] if f else [0.0] * dim for r, f in zip(rows, fits, strict=True)], np.float64)
    norm = np.linalg.norm(x, axis=1)
    x = x / np.where(norm > 0, norm, 1)[:, None]
    label = np.array([str(r[2]) for r in rows])
    link = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root, todo = list(range(len(rows))), set(range(len(rows)))
    while todo:
        stack = [todo.pop()]
        members = []
        while stack:
            i = stack.pop()
            members.append(i)
            near = [j for j in np.flatnonzero(link[i]).tolist() if j in todo]
            todo -= set(near)
            stack += near
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            root[i] = min(ids, default=None)
    return sorted(((r[0], int(link[i].sum()), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=str)


def given(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def near_copies(seed, n, dim, noise):
    """Random unit vectors, and chains and stars of copies with noise around some, so that links cross cells."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    more = [base]
    for _ in range(3):
        at = rng.integers(0, len(base), n // 2)
        step = rng.normal(size=(n // 2, dim))
        step *= rng.uniform(0, noise, (n // 2, 1)) / np.linalg.norm(step, axis=1)[:, None]
        more.append((np.concatenate(more)[at] + step) * rng.uniform(0.1, 9, (n // 2, 1)))
    x = np.concatenate(more).astype(np.float32)
    return [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "n", "dim", "noise", "cell", "block"), [(1, 300, 64, 0.5, 40, 16), (2, 300, 6, 0.4, 10, 8), (3, 200, 2, 0.3, 16, 64), (4, 30, 64, 0.4, 512, 1024)])
def test_no_link_is_lost(spark, monkeypatch, seed, n, dim, noise, cell, block):
    monkeypatch.setattr(pq_dedup, "CELL", cell)
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "MOST_ASKS", 3)
    rows = near_copies(seed, n, dim, noise)
    want = plain(rows)
    assert sum(r[1] for r in want) > 50
    assert given(pq_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))) == want


def test_one_label_and_one_group_hold_most_rows(spark, monkeypatch):
    """A vector with very many copies is one entry; a dense group is cut into blocks that several tasks compare."""
    monkeypatch.setattr(pq_dedup, "BLOCK", 64)
    monkeypatch.setattr(pq_dedup, "MOST_ASKS", 4)
    rng = np.random.default_rng(5)
    hot, centre = rng.normal(size=32), rng.normal(size=32)
    rows = [(i, hot.tolist(), 1) for i in range(2000)]
    rows += [(2000 + i, (centre + rng.normal(size=32) * 0.02).tolist(), 1) for i in range(600)]
    rows += [(2600 + i, rng.normal(size=32).tolist(), i % 5) for i in range(300)]
    assert given(pq_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == plain([(i, np.float32(v).tolist(), k) for i, v, k in rows])


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0], 1), (3, [1.0, 0.1], 2), (4, [-1.0, -0.0], 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.05], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1),
        (3, [1.0, 0.1], 2), (12, [3e38, 1e30], 1), (13, [1e-40, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", key string, root int")
    assert given(pq_dedup.near_duplicates(df)) == plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0
    assert given(pq_dedup.near_duplicates(df.where("vec_id = 7"))) == [(7, 0, 7, True)]


def test_double_vectors(spark):
    rows = near_copies(9, 60, 5, 0.5)
    df = spark.createDataFrame([(i, v, f"l{k}") for i, v, k in rows], "vec_id long, embedding array<double>, label string")
    assert given(pq_dedup.near_duplicates(df)) == plain([(i, v, f"l{k}") for i, v, k in rows])


def test_few_cells_are_asked():
    """Half the radius leaves most cells out, and the bound of look-ups most entries."""
    rng = np.random.default_rng(2)
    x = pq_dedup._unit(rng.normal(size=(6000, 8)))
    q = pq_dedup.Quantiser(x[:3000], 64)
    cell, codes, left = q.encode(x)
    reach = math.sqrt(2 - 2 * 0.93)
    asked = near = within = 0
    for c in range(len(q.centres)):
        here = x[cell == c]
        asked += (q.heights(here, c) <= reach / 2).sum()
        d = q.look_up(here, c, codes[cell == c]) - left[cell == c]
        exact = np.sqrt(pq_dedup._squares(here, here))
        assert (d <= exact + 1e-9).all()
        near, within = near + (d <= reach).sum(), within + (exact <= reach).sum()
    assert asked < 0.35 * len(x) * len(q.centres) and near < 2 * within
