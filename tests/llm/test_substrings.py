"""Suffix-sort and fixed-block deduplication against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from passant.llm import block_dedup, repeats, suffix_dedup


def brute(sequences, window):
    seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def expected(rows, window, tokens, join):
    sequences = [tokens(r[1] or "") for r in rows]
    out = []
    for r, s, gone in zip(rows, sequences, brute(sequences, window), strict=True):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = hashlib.sha256(join([t for t, g in zip(s, gone, strict=True) if not g])).hexdigest()
        out.append((str(r[0]), len(s), sum(gone), spans, kept))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


WORDS = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("window", [40, 200])
def test_bytes(messy, rows, window):
    assert got(suffix_dedup.remove_repeats(messy, window, digests=True)) == expected(rows, window, lambda t: list(t.encode()), bytes)


@pytest.mark.parametrize("window", [6, 35])
def test_words(messy, rows, window):
    assert got(block_dedup.remove_repeats(messy, window, digests=True)) == expected(rows, window, WORDS, lambda w: " ".join(w).encode())


@pytest.mark.parametrize("hot", [20_000, 10, 1])
def test_many_copies_of_a_passage(spark, monkeypatch, hot):
    """A passage that every text holds, in texts that are otherwise different; and texts that differ in one place."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SALTS", 5)
    monkeypatch.setattr(repeats, "RESOLVED", 500)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(80))
    base = [word() for _ in range(120)]
    rows = [(i, f"{' '.join(word() for _ in range(15))} {passage} {' '.join(word() for _ in range(15))}") for i in range(40)]
    rows += [(100 + i, " ".join([*base[: i * 3], word(), *base[i * 3 + 1 :]])) for i in range(30)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffix_dedup.remove_repeats(df, 200, digests=True)) == expected(rows, 200, lambda t: list(t.encode()), bytes)
    assert got(block_dedup.remove_repeats(df, 35, digests=True)) == expected(rows, 35, WORDS, lambda w: " ".join(w).encode())


def test_real_output_and_empty(messy, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0 and block_dedup.remove_repeats(empty).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(messy, 200).where("doc_id in (1, 3)").collect()}
    assert kept == {1: b"", 3: b"one"}


def test_equal_fingerprints_of_different_windows(messy, rows, monkeypatch):
    """Fingerprints of a few values: tokens themselves decide what is equal."""
    monkeypatch.setattr(block_dedup, "Prints", lambda values, which=0: repeats.Prints(values & np.uint64(1), which))
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400)
    start, windows = np.array([0, 200]), np.array([192, 192])
    flags = block_dedup.block_hits(words.astype(np.uint64) * np.uint64(2), words, start, start, windows, np.zeros(2, np.int64), 9)
    seen = Counter(tuple(words[a + i : a + i + 9]) for a in start for i in range(192))
    assert flags.tolist() == [seen[tuple(words[a + i : a + i + 9])] > 1 for a in start for i in range(192)]


def test_long_texts_in_stretches(monkeypatch):
    """A text longer than a stretch has the anchors it would have as a whole."""
    values = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    finder = suffix_dedup.finder(50)
    whole = finder.anchors(values, np.array([0, 5000]))
    monkeypatch.setattr(repeats, "STRETCH", 700)
    parts = finder.anchors(values, np.array([0, 5000]))
    spread = lambda a: {int(s) + i: int(p) for p, s, n in zip(a[1], a[2], a[3], strict=True) for i in range(n)}
    assert spread(whole) == spread(parts) and len(spread(whole)) == 4951


@pytest.mark.parametrize("resolve", [suffix_dedup.radix_passes, block_dedup.block_hits])
def test_resolvers_against_brute_force(resolve):
    rng = np.random.default_rng(1)
    window, parts = 9, [rng.integers(0, 2, rng.integers(12, 18)).astype(np.uint64) + np.uint64(1) for _ in range(40)]
    start = np.cumsum([0, *map(len, parts)])[:-1]
    windows = np.array([len(p) - window + 1 for p in parts])
    kind = np.arange(40) % 3
    exact = np.concatenate(parts).astype(np.uint8 if resolve is suffix_dedup.radix_passes else np.int64)
    values = repeats.mixed(np.concatenate(parts))
    anchor = start + window - 1  # in every window of a stretch at another place
    flags = resolve(values, exact, start, anchor, windows, kind, window=window)
    at = np.cumsum(windows) - windows
    seen = Counter()
    keys = []
    for i, p in enumerate(parts):
        for j in range(windows[i]):
            place = (window - 1 - j,) if resolve is suffix_dedup.radix_passes else ()
            keys.append((kind[i], *place, tuple(p[j : j + window])))
            seen[keys[-1]] += 1
    assert flags.tolist() == [seen[k] > 1 for k in keys] and len(at) == 40
