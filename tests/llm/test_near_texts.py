"""Near-duplicate texts at a Jaccard similarity, against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest

from passant.llm import near_texts


def shingle_set(text, words=5):
    found = (text or "").encode().lower().split()
    return frozenset(b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)) or frozenset([b" ".join(found)] if found else [])


def similar(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b)


def plain_components(rows, least=0.8):
    """For each row (doc_id, text) the places of the rows that are connected to it, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if similar(sets[i], sets[j], least)]
    for i, j in pairs:
        root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return [members[find(i)] for i in range(len(rows))], pairs


def expected(rows):
    members, _ = plain_components(rows)
    return sorted(((d, min((rows[i][0] for i in m if rows[i][0] is not None), default=None)) for (d, _), m in zip(rows, members, strict=True)), key=str)


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed, n, copies, share, length=200):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(length // 2, length * 2))]
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, share * rng.random())) for _ in range(rng.randint(0, copies))]
    return list(enumerate(texts))


def test_all_close_pairs_and_no_other(spark):
    rows = corpus(1, 60, 6, 0.06)
    got = sorted((tuple(r) for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    component = dict(got)
    members, pairs = plain_components(rows)
    assert len(pairs) > 100
    assert np.mean([component[i] == component[j] for i, j in pairs]) >= 0.98
    for i, m in enumerate(members):  # nothing links below the similarity
        assert component[i] in m


def test_recall_on_a_table(spark):
    """Every pair of sf0.01's documents at 0.8 or more."""
    table = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"])
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    got = sorted((tuple(r) for r in near_texts.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()), key=str)
    want = expected(rows)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.002 * len(rows)


def test_one_group_holds_most_rows(spark, monkeypatch):
    """A dense group is cut into cells, of candidates as of verification."""
    monkeypatch.setattr(near_texts, "CELL", 50)
    monkeypatch.setattr(near_texts, "CELL_BYTES", 20_000)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(400)] + [(1000 + i, t) for i, t in corpus(4, 30, 1, 0.02)]
    got = sorted((tuple(r) for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = expected(rows)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 4


def test_messy_rows(spark, messy, rows, empty):
    pairs = [(r[0], r[1]) for r in rows]
    got = sorted((tuple(r) for r in near_texts.near_duplicates(messy).collect()), key=str)
    assert got == expected(pairs)
    kept = near_texts.kept_rows(messy)
    assert kept.columns == messy.columns
    members, _ = plain_components(pairs)
    assert kept.count() == len({tuple(m) for m in members})
    assert near_texts.near_duplicates(empty).count() == near_texts.kept_rows(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_verified(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(40)]
    root = near_texts.verified(sets, np.stack([near_texts.sketch(s) for s in sets]), 0.8)
    as_sets = [set(s.tolist()) for s in sets]
    label = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if similar(as_sets[i], as_sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert root.tolist() == label


def test_keys_grow_slowly():
    few, many = near_texts.choices(10_000, 0.8), near_texts.choices(10_000_000, 0.8)
    assert len(many) < 6 * len(few) and len(many[0]) == len(few[0]) + 10
