"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passant.llm import contracts, periodic

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=12):
    """By definition: maximal stretches of each period, of which no smaller one is a period of the stretch."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(doc_id, words):
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6), st.sampled_from([2, 5, 12]))
def test_lanes(documents, least):
    assert periodic.runs_of([np.array(d, np.int64) for d in documents], least) == [plain_runs(d, least) for d in documents]


def repetitive(rng, n, alphabet):
    """Stretches of several periods, periods of periods, with some words changed."""
    words: list[int] = []
    while len(words) < n:
        unit = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 10, 40, 64, 65, 90, 150]))]
        if rng.random() < 0.3:
            unit = (unit * rng.randint(2, 4))[: rng.randint(20, 200)]
        words += (unit * rng.randint(1, 6))[: rng.randint(1, 500)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = alphabet
    return words[:n]


@pytest.mark.parametrize("seed", range(12))
def test_sieved_lags(seed, monkeypatch):
    """Long documents only, sieved, against the definition."""
    monkeypatch.setattr(periodic, "SIEVED", 100)
    rng = random.Random(seed)
    documents = [repetitive(rng, rng.randint(130, 900), rng.choice([1, 2, 5, 300])) for _ in range(4)]
    assert periodic.runs_of([np.array(d, np.int64) for d in documents]) == [plain_runs(d) for d in documents]


def test_very_long_and_repetitive():
    """Work that grows with the square of the words would not end."""
    n = 400_000
    assert periodic.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    assert periodic.runs_of([np.arange(n) % 70_001]) == [[(0, n, 70_001)]]
    words = np.random.default_rng(3).integers(0, 5000, n)
    words[200_000:300_000] = words[100_000:200_000]
    assert (100_000, 200_000, 100_000) in periodic.runs_of([words])[0]


def test_messy_rows(spark, messy, rows, empty):
    got = periodic.collapse_runs(messy).collect()
    words = {}
    for r in rows:
        words.setdefault(str(r[0]), []).append(WORD.findall(r[1] or ""))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]]) for r in got) == sorted((k, len(w), plain_runs(w)) for k, every in words.items() for w in every)
    assert {"THE THE THE", "junk %%% $$$"} & {r["collapsed"] for r in got} and len(got) == len(rows)
    assert periodic.collapse_runs(empty).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", "  nbsp stays", "one\ttwo\x0bthree\x0cfour\r\nfive " * 5]
    rows = [*enumerate(texts), (None, "x " * 40), (0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in contracts.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digests(d, plant(d, WORD.findall(t or ""))) for d, t in rows), key=str)
