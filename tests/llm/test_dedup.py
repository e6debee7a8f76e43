"""Exact streaming dedup and SimHash near-dedup against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from passant.llm import simhash, stream_dedup


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1] or "", []).append(r[0])
    return out


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_exact(messy, rows, files_per_batch):
    got = stream_dedup.exact_dedup(messy, files_per_batch).collect()
    groups = groups_of(rows)
    want = sorted((str(r[0]), str(max((d for d in groups[r[1] or ""] if d is not None), default=None)), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(str(r["doc_id"]) == str(r["keep_id"]) for r in kept)


def test_exact_keeps_columns(messy, rows):
    kept = stream_dedup.kept_rows(messy)
    assert kept.columns == messy.columns and kept.count() == len(groups_of(rows))


def by_row(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in stream_dedup.exact_dedup(df).collect())


def plain_dedup(rows):
    groups = groups_of(rows)
    return sorted((str(d), str(max(groups[t or ""])), len(groups[t or ""]), d == max(groups[t or ""])) for d, t in rows)


def test_exact_reads_the_files_it_is_given(spark, tmp_path):
    """Two of a folder's three files, a JSON scan, a reader option, a path with a space and one with glob characters."""
    rows = [(i, f"text {i % 4}") for i in range(12)]
    for n, folder in enumerate(("plain", "with space", "with[x]glob")):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").write.parquet(f"{tmp_path}/{folder}")
        df = spark.read.parquet(f"{tmp_path}/{folder.replace('[', '?').replace(']', '?')}" if n == 2 else f"{tmp_path}/{folder}")
        assert by_row(df) == plain_dedup(rows) and stream_dedup.kept_rows(df).count() == 4
    files = sorted(str(p) for p in (tmp_path / "plain").glob("*.parquet"))
    for some in (files[:2], files[:1]):
        df = spark.read.parquet(*some)
        held = [tuple(r) for r in df.collect()]
        assert 0 < len(held) < 12 and by_row(df) == plain_dedup(held)
        assert sorted(r["text"] for r in stream_dedup.kept_rows(df).collect()) == sorted({t for _, t in held})
    df = spark.read.option("pathGlobFilter", files[0].rpartition("/")[2]).parquet(f"{tmp_path}/plain")
    assert by_row(df) == plain_dedup([tuple(r) for r in df.collect()])
    spark.createDataFrame(rows, "doc_id long, text string").write.json(f"{tmp_path}/json")
    df = spark.read.schema("doc_id long, text string").json(f"{tmp_path}/json")
    assert by_row(df) == plain_dedup(rows) and stream_dedup.kept_rows(df).count() == 4


def test_kept_rows_of_null_and_repeated_ids(spark):
    """A decision is a row's: other rows with its doc_id, or without one, stand for themselves."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (None, "d"), (3, None), (4, "")]
    kept = [tuple(r) for r in stream_dedup.kept_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(2, "a"), (1, "b"), (None, "c"), (None, "d"), (4, "")]))


def test_equal_digests_of_different_texts(spark, messy, monkeypatch):
    """A digest of few values: whole texts decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(stream_dedup, "_digest", lambda text: F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 1)))
    df = spark.createDataFrame([(i, f"text {i % 9}") for i in range(30)], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in stream_dedup.exact_dedup(df).collect()}
    sizes = {k: len([i for i in range(30) if i % 9 == k]) for k in range(9)}
    assert got == {(i, max(j for j in range(30) if j % 9 == i % 9), sizes[i % 9]) for i in range(30)}
    assert stream_dedup.kept_rows(df).count() == 9


def plain_fingerprint(text):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashed = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(fps, radius=3):
    fps = np.asarray(fps, np.uint64)
    return simhash.components(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius))


def test_simhash(messy, rows):
    got = simhash.near_duplicates(messy).collect()
    fps = [plain_fingerprint((r[1] or "").encode()) for r in rows]
    label = plain_components(fps)
    least = {c: min((r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None), default=None) for c in set(label)}
    want = sorted((str(r[0]), f, str(least[c])) for r, f, c in zip(rows, fps, label, strict=True))
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in got) == want


def test_hot_key_and_chain(spark, monkeypatch):
    """More fingerprints under one key than a cell holds, and a long chain of links."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(4)
    near = np.unique((np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))).astype(np.uint64))
    chain = np.array([(1 << (2 * i)) - 1 for i in range(32)], np.uint64)
    every = np.unique(np.concatenate([near, chain, rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.connected(simhash.links(df, 3)).collect()}
    label = plain_components(every)
    ours = {}
    for x in every.view(np.int64).tolist():
        ours.setdefault(roots.get(x, x), set()).add(x)
    theirs = {}
    for x, c in zip(every.view(np.int64).tolist(), label, strict=True):
        theirs.setdefault(c, set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=60), st.integers(0, 5), st.integers(0, 1000))
def test_bit_sliced_comparison(groups, radius, seed):
    rng = np.random.default_rng(seed)
    group = np.sort(np.array(groups))
    fp = rng.integers(0, 1 << 10, len(group)).astype(np.uint64)
    label = simhash.linked(fp, group, radius)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & (group[:, None] == group[None, :])
    assert label.tolist() == simhash.components(len(fp), *np.nonzero(near)).tolist()


def test_key_lengths_grow():
    assert [simhash._block_count(n, 3) for n in (10, 10**6, 10**8, 10**12)] == sorted(simhash._block_count(n, 3) for n in (10, 10**6, 10**8, 10**12))


def test_empty(empty):
    assert stream_dedup.exact_dedup(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
