"""Raking, packing and pivot search."""

import math
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from passant.llm import mixing, packing, pivot_search

IDS = public_tokenizers.path("byte_bpe_50k.json")


def test_mix_matches_its_sql(spark, messy, rows):
    got = mixing.mix(messy)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    result = con.execute(mixing.oracle())
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in got.collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())


def bounded_targets(share, temper, rate):
    """The tempered shares whose sum, each cut at all its group has, is the total: bisection on their common factor."""
    power = {c: x**temper for c, x in share.items()}
    total, low, high = sum(share.values()), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(share[c] / rate, mid * x) for c, x in power.items()) < total else (low, mid)
    return {c: min(share[c] / rate, high * x) for c, x in power.items()}


@pytest.mark.parametrize("tokens", [[100.0, 5, 30, 40, 7, 60, 10, 90], [1e6, 900.0, 3e5, 4e4, 1e5, 2e5, 6e4, 1.0]])
@pytest.mark.parametrize("rate", [0.5, 0.8])
def test_raking_meets_its_targets(tokens, rate):
    places = [(s, g, t) for s in "ab" for g in "xy" for t in "pq"]
    factor = mixing.rake(tokens, places, rounds=400, rate=rate)
    assert all(0 < f * rate <= 1 + 1e-12 for f in factor)
    weights = [f * t for f, t in zip(factor, tokens, strict=True)]
    for axis, name in enumerate(mixing.AXES):
        share, weight = defaultdict(float), defaultdict(float)
        for t, w, p in zip(tokens, weights, places, strict=True):
            share[p[axis]] += t
            weight[p[axis]] += w
        want = bounded_targets(share, mixing.TEMPER[name], rate)
        assert mixing._targets(share, sum(tokens), mixing.TEMPER[name], rate) == pytest.approx(want, rel=1e-9)
        assert weight == pytest.approx(want, rel=1e-3, abs=1e-4 * sum(tokens))


def test_samples_have_the_target_marginals(spark):
    """A hot source, a tiny one that is wanted more than it has, and cells at their bound: the production rounds meet the
    targets in expectation, and the documents drawn come near them."""
    rows = [(i, "w " * (20 + i % 200), "en" if i % 10 else "fr", "tiny" if i % 500 == 1 else "hot" if i % 3 else f"s{i % 4}") for i in range(20_000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    report = mixing.marginals(mixed).collect()
    total = sum(r["tokens"] for r in report if r["axis"] == "source")
    for axis, name in enumerate(mixing.AXES):
        share = {r["category"]: r["tokens"] for r in report if r["axis"] == name}
        want = bounded_targets(share, mixing.TEMPER[name], mixing.RATE)
        for r in (r for r in report if r["axis"] == name):
            assert r["target"] == pytest.approx(mixing.RATE * want[r["category"]], rel=1e-9)
            assert r["expected"] == pytest.approx(r["target"], abs=1e-5 * total)
            assert abs(r["drawn"] - r["expected"]) < 5 * 220 * math.sqrt(r["tokens"] / 120) + 1
    tiny = next(r for r in report if r["category"] == "tiny")
    assert tiny["drawn"] == tiny["tokens"]  # all of it


def test_mix_by_frames_is_the_same(messy):
    near, far = (sorted((str(r["doc_id"]), r["factor"], r["kept"]) for r in mixing.mix(messy, rounds=3, most_cells=n).collect()) for n in (100_000, 1))
    assert near == far


def test_mix_keeps_columns(messy, empty):
    assert mixing.kept_rows(messy).columns == messy.columns
    assert mixing.mix(empty).count() == mixing.marginals(mixing.mix(empty)).count() == 0


def check_packing(spark, rows, packed, capacity):
    ids = {}
    t = Tokenizer.from_file(IDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[str(r["doc_id"])].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in rows:
        ids.setdefault(str(doc_id), []).append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    assert set(ids) == set(by_doc)
    for k, every in ids.items():
        want = []
        for seq in every:
            head = len(seq) % capacity or capacity
            cuts = [0, *range(head, len(seq), capacity), len(seq)]
            want += [(i, a, b - a, zlib.crc32(np.array(seq[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[k]) == sorted(want)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u00a0 "])
def test_packing_long_white_space(spark, blank):
    """Runs of white space that the faster library can't split."""
    rows = [(0, "x" + blank * (2_000_000 // len(blank)) + "y"), (1, blank * 1_000_000), (2, "two words"), (None, None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), IDS, 2048).collect()
    check_packing(spark, rows, packed, 2048)


def test_packing_ranks_rows_without_ids_apart(spark, monkeypatch):
    """All rows have no id, or the same one, and the same length: salts are even all the same."""
    monkeypatch.setattr(packing, "SALT_ROWS", 100)
    rows = [(None if i % 2 else 7, f"word {i % 10}") for i in range(4000)]
    pieces = packing.materialize(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), IDS, 64))
    ranked = packing.ranked(pieces)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(4000))
    window = next(x for x in ranked._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in x)
    assert "salt" in window
    located, file, row = packing.located(pieces)
    assert located.groupBy(packing.F.pmod(packing.F.xxhash64(file, row), packing.F.lit(40))).count().agg(packing.F.max("count")).first()[0] < 200


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, messy, rows, capacity, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    packed = packing.pack(messy, IDS, capacity).collect()
    n = check_packing(spark, [(r[0], r[1]) for r in rows], packed, capacity)
    total = sum(r["length"] for r in packed)
    assert -(-total // capacity) <= n <= total / capacity * 1.25 + 1


def test_ids_without_ranks(tmp_path):
    import shutil

    alone = tmp_path / "only.json"
    shutil.copy(IDS, alone)
    for text in ("plain text", "<|endoftext|> x", "é日\n\n  y"):
        assert packing.ByteLevelIds(str(alone)).ids(text).tolist() == packing.ByteLevelIds(IDS).ids(text).tolist()


def fits(plan, histogram, capacity):
    """Every piece has one place, and no sequence overflows; the number of sequences."""
    filled, placed = defaultdict(list), defaultdict(int)
    for length, rank, n, first, each, offset in plan.runs:
        assert rank == placed[length]
        placed[length] += n
        for i in range(n):
            filled[first + i // each].append((offset + i % each * length, length))
    assert placed == {k: v for k, v in histogram.items() if v}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == plan.sequences
    return plan.sequences


def optimum(items, capacity):
    """Fewest bins by exhaustive search."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                place(i + 1, bins)
                bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


@settings(deadline=None, max_examples=120)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_valid_and_reduction_keeps_the_optimum(items):
    items = sorted(items, reverse=True)
    histogram = {x: items.count(x) for x in items}
    n = fits(packing.plan_packing(histogram, 20), histogram, 20)
    best = optimum(items, 20)
    assert n <= best * 11 / 9 + 1
    count, plan = dict(histogram), packing.Plan()
    packing.reduce_dominated(count, 20, plan)
    rest = sorted((x for x, k in count.items() for _ in range(k)), reverse=True)
    assert plan.sequences + (optimum(rest, 20) if rest else 0) == best


def test_large_histograms_are_planned_by_counts():
    rng = np.random.default_rng(0)
    histogram = {int(x): int(n) for x, n in enumerate(rng.integers(0, 10**9, 2049)) if x}
    plan = packing.plan_packing(histogram, 2048)
    total = sum(k * v for k, v in histogram.items())
    assert len(plan.runs) < 100_000 and plan.sequences < total / 2048 * 1.01
    placed = defaultdict(int)
    for length, _, n, *_ in plan.runs:
        placed[length] += n
    assert placed == {k: v for k, v in histogram.items() if v}


def test_packing_nothing(empty):
    assert packing.pack(empty, IDS).count() == 0


def plain_top(vectors, k, every):
    usable = [(i, tuple(math.floor(64 * Fraction(float(x))) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in usable if i != q)[:k]
        out += [(q, rank, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, i) in enumerate(best, 1)]
    return out


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 0.3]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]  # one very common vector: ties
    return rows + [(None, [0.1] * 6), (301, None), (302, [0.1, None, 0.2]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (320, []), (340, [0.2, 0.3]), (20, [0.7] * 6), (20, [-0.7] * 6)]


SIZES = {"SAMPLE": 30, "BLOCK": 3, "ANNULUS": 4, "PIVOTS": 4, "CELL": 16}


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    if small:
        for name, value in SIZES.items():
            monkeypatch.setattr(pivot_search, name, value)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").repartition(5)
    df = df.selectExpr("*", *[f"'clash' AS {c}" for c in ("v", "pivot", "distance", "cell", "block", "own", "near", "asks", "square", "score", "rank", "query_id")])
    got = sorted(tuple(r) for r in pivot_search.top_k(df, 5, 20).collect())
    assert got == sorted(plain_top([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors()], 5, 20))
    assert pivot_search.top_k(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_search_with_components_of_any_size(spark, monkeypatch, small):
    """Products beyond exact doubles, beyond longs and beyond 38 digits, beside ordinary ones."""
    if small:
        for name, value in SIZES.items():
            monkeypatch.setattr(pivot_search, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 10.0 ** float(rng.choice([-1, 0, 6, 8, 12, 40, 150]))).tolist()) for i in range(90)]
    rows += [(100, [1.0, 2.0, 3.0, 4.0]), (101, [1e300] * 4), (102, [-1e300] * 4), (120, [1e15 + 1, 0.5, -1e15, 3.0]), (140, [1e300, -1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in pivot_search.top_k(df, 7, 20).collect()) == sorted(plain_top(rows, 7, 20))


def test_search_leaves_out_annuli(monkeypatch):
    """Queries stop at the triangle-inequality bound where the data have clusters, and find the same."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 64 + rng.normal(size=(4000, 8)))
    square = float((x * x).sum(1).max())
    lifted = pivot_search._lifted(x, square)
    pivot = lifted[:1]
    distance = pivot_search._distances(lifted, pivot)[:, 0]
    order = np.argsort(distance)
    q, ids = x[:100], np.arange(4000)
    best = pivot_search.Best(100, 5, np.full(100, -np.inf))
    to_pivot = pivot_search._distances(np.concatenate([q, np.zeros((100, 1))], axis=1), pivot)[:, 0]
    made = pivot_search.expand(best, q, ids[:100], lambda f, live: pivot_search._reach(f, q[live], square), to_pivot, x[order], ids[order], distance[order])
    score = q @ x.T
    score[np.arange(100), np.arange(100)] = -np.inf
    want = {(i, int(j)) for i in range(100) for j in np.lexsort((ids, -score[i]))[:5]}
    assert set(zip(*(a.tolist() for a in best.settle()[:2]), strict=True)) == want
    assert made < 0.9 * 100 * 4000


def test_search_with_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pivot_search.top_k(df).collect())
    assert got == [(0, 1, 21, 4096), (0, 2, 21, 4096), (0, 3, 20, 0), (20, 1, 21, 4096), (20, 2, 21, 4096), (20, 3, 0, 0), (20, 4, 0, 0)]
