"""Quality scores, secrets and token counts."""

import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passant.llm import quality, secret_scan, token_counts

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert set(got["held_out"]) == {True, False}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    auc = np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))
    assert auc > 0.97 and (held["predicted"] == held["quality"]).mean() > 0.93
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3).astype(int)).all()


def plain_features(text):
    """The features from their names, on characters and lists."""
    raw = text.encode()
    words = re.findall(rb"[^ \t-\r]+", raw)
    if not words:
        return [0.0] * 23 + [1.0]
    n, size = len(words), len(raw)
    share = lambda test: sum(1 for b in raw if test(b)) / size
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122
    mark = lambda b: 33 <= b <= 126 and not letter(b) and not 48 <= b <= 57 and b not in b".,;:!?'\"()-"
    lines = [x for x in raw.split(b"\n") if x.strip()]
    parts = [raw[i : i + 65536] for i in range(0, size, 65536)]
    follow = [(words[i], words[i + 1]) for i in range(n - 1)]
    marks = sum(map(mark, raw))
    return [
        math.log(n), size / n, sum(len(w) > 12 for w in words) / n, sum(len(w) <= 2 for w in words) / n, len(set(words)) / n, max(words.count(w) for w in set(words)) / n,
        share(letter), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in b" \t\n\v\f\r"), marks / size, share(lambda b: b > 127),
        sum(raw.count(c) for c in b"!.?") / n, raw.count(b",") / n, sum(len(w) > 2 and w.isupper() for w in words) / n, min(1.0, marks / n), float(marks > 0.02 * size), math.log(len(lines) + 1),
        1 - len(set(lines)) / len(lines), math.log(n / len(lines) + 1), sum(len(zlib.compress(p, 1)) / len(p) for p in parts) / len(parts), (len(follow) - len(set(follow))) / n, sum(a == b for a, b in follow) / n, 0.0,
    ]


def test_features_are_their_plain_forms(rows):
    for text in {r[1] or "" for r in rows} | {"A,b;\x0b c!\n\n\x85 \u00a0 D", "x" * 70_000 + " y"}:
        assert quality.features(text.encode()) == pytest.approx(plain_features(text), rel=1e-9, abs=1e-12)


def test_quality_equals_a_refit_by_hand(spark):
    """Scores of whole tables against a model fitted outside Spark on the same pairs: labelled rows chosen with zlib's
    CRC, and weights at which the penalised loss, summed pair by pair, has no slope in any direction (it is convex)."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    ids = sorted(good)
    x, y = np.array([plain_features(texts[i]) for i in ids]), np.array([good[i] for i in ids])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1.0

    def widened(v):
        z = np.minimum(6, np.maximum(-6, (v - mean) / scale))
        return np.hstack([z, z**2])

    z, model = widened(x), quality.train(docs, labels)
    few, many = sorted([np.flatnonzero(y == 0), np.flatnonzero(y == 1)], key=len)
    other = np.random.default_rng(7).choice(many, len(few) * 24)
    sign = 1 if y[many[0]] == 1 else -1
    pairs = np.array([sign * (z[other[24 * i + j]] - z[f]) for i, f in enumerate(few) for j in range(24)])
    loss = lambda w: np.logaddexp(0, -pairs @ w).sum() + 0.5 * w @ w
    for k in range(len(model.weights)):
        step = np.zeros(len(model.weights))
        step[k] = 1e-4
        assert abs(loss(model.weights + step) - loss(model.weights - step)) / 2e-4 < 1e-3
    strength = z @ model.weights
    cut = np.quantile(strength, np.mean(y == 0))
    slope = 2 / np.abs(strength - cut).mean()
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.classify(docs, labels).collect()}
    all_ids = sorted(texts)
    strengths = widened(np.array([plain_features(texts[i]) for i in all_ids])) @ model.weights
    for i, s in zip(all_ids, strengths, strict=True):
        want = 1 / (1 + math.exp(-np.clip(slope * (s - cut) + math.log(0.3 / 0.7), -30, 30)))
        assert got[i][0] == pytest.approx(want, abs=1e-7) and got[i][1] == int(got[i][0] >= 0.3)


def test_quality_on_messy_tables(spark, messy, empty, rows):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (20, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(messy, labels).count() == len(rows)
    assert {r["score"] for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.kept_rows(messy, labels.limit(0)).columns == messy.columns


def test_a_label_of_very_many_rows(spark):
    """A labelled doc_id that most rows have is one row of the sample; the text's column may be called Text."""
    texts = [(i % 7 if i % 3 else 500, f"good words {i}" if i % 2 else "junk %% %% 11") for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, Text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(500, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, good, threshold: (seen.append(len(x)), fit(x, good, threshold))[1]
    try:
        kept = quality.kept_rows(docs, labels)
    finally:
        quality.fit = fit
    assert seen[0] <= 8 and kept.columns == ["doc_id", "Text"] and kept.count() <= 3000


def test_training_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.train(docs, labels, most_labels=60), quality.train(docs, labels, most_labels=60)
    assert np.array_equal(a.weights, b.weights) and not np.array_equal(a.weights, quality.train(docs, labels).weights)


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets(spark, messy, rows):
    more = ["\U0001f600 secret: 'abcdef123' password==xyzxyz", "api_key=short api-key=longenough", "apikey : \"A/b+c=d.e\" " * 3, "AKIAAKIA" + "B" * 20, "x" + "f" * 24 + "é" + "0" * 23, "Ｔoken=abcdefgh toKen=abcdefgh"]
    both = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = sorted((str(d), plain_spans(t or "")) for d, t in [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(more))])
    for most in (None, 1):  # all bitmaps at once, or files in groups
        got = secret_scan.find_secrets(both.repartition(5), most_marks=most).collect()
        assert sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in got) == want


def test_candidates_are_those_of_brute_force(spark, messy, rows):
    texts = [(r[1] or "") for r in rows] + ["a Token and a SECRET", "passing words", "pass word", "api_key, apikey", "tok oke ken", "AKIA akia", "aki kia"]
    queries = {r.kind: q for r in secret_scan.BASE_RULES if (q := secret_scan.trigram_query(r.pattern))}
    df = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
    index = secret_scan.postings(df, sorted({t for q in queries.values() for c in q for t in c}))
    assert index.columns == ["trigram", "at"]
    got = {(r["at"], k) for r in secret_scan.candidates(index, queries).collect() for k in r["kinds"]}
    want = {(i, k) for i, t in enumerate(texts) for k, q in queries.items() if any(all(x in t.lower() for x in c) for c in q)}
    assert got == want and {k for _, k in want} == {"assign", "access"}


def test_very_many_matches_in_a_text(spark):
    """100 000 matches, of which every third is too short; offsets at the borders of blocks."""
    import time

    text = "".join(f"é token={'a' * (5 + (i % 3 > 0) * (i % 50 + 1))} " for i in range(100_000))
    docs = spark.createDataFrame([(0, text), (1, "token=abcdef " * 512), (2, "token=abcdef " * 513)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find_secrets(docs).collect()}
    assert time.time() - began < 90
    assert got[0] == plain_spans(text) and sum(k == 0 for _, k, _ in got[0]) == 66_666
    assert got[1] == [(13 * i, 0, 13 * i + 12) for i in range(512)] and got[2] == [(13 * i, 0, 13 * i + 12) for i in range(513)]


def test_no_text_is_moved(spark):
    """Of the plan's exchanges none carries a text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = secret_scan.find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange (hash|range|single)", plan)


def test_secrets_without_python(spark, messy, empty):
    plan = secret_scan.find_secrets(messy)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert secret_scan.find_secrets(empty).count() == 0


@pytest.mark.parametrize(("pattern", "want"), [("abcd", [{"abc", "bcd"}]), ("AKIA[A-Z]+", [{"aki", "kia"}]), ("[0-9]+", []), ("(abc|xyz)+q", [{"abc"}, {"xyz"}]), ("ab?c*def", [{"def"}]), ("(?:foo)?bar", [{"bar"}])])
def test_trigram_queries(pattern, want):
    assert secret_scan.trigram_query(pattern) == frozenset(map(frozenset, want))


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="abcok e_twdprs", max_size=25))
def test_trigram_queries_are_sound(text):
    for pattern in ("token", "pass(word|wd)", "(ab|cd)?ok", "a(bc)+d", "sec?ret[ab]s"):
        query = secret_scan.trigram_query(pattern)
        if query and re.search(pattern, text):
            assert any(all(t in text for t in clause) for clause in query)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts(spark, messy, empty, rows, pieces):
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(pieces.encode(r[1] or ""))) for r in rows)
    for long_chars in (1 << 22, 150):  # the second deals long texts out by chunks
        got = token_counts.count_tokens(messy, MODEL, 100, long_chars).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_counts_of_all_documents(pieces):
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM read_parquet('{SF}/documents.parquet')").fetchall()]
    t = token_counts.transducer(MODEL)
    assert [t.count(x) for x in texts] == [len(p) for p in pieces.encode(texts)]


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab the  in\n\t,.éß日<0x>▁1290'\"&eŕ😀", max_size=40), st.integers(1, 9))
def test_transducer_and_its_chunks(text, size):
    t = token_counts.transducer(MODEL)
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL) if not hasattr(test_transducer_and_its_chunks, "sp") else test_transducer_and_its_chunks.sp
    test_transducer_and_its_chunks.sp = processor
    want = len(processor.encode(text))
    assert t.count(text) == want
    assert t.count(text, size) == want
    prepared = t.prepare(text)
    if prepared:  # any grouping of the maps gives the same
        maps = t.maps(prepared, size, t.start)
        one = maps[0]
        for m in maps[1:]:
            one = t.compose(one, m)
        assert one == t.scan(maps) and list(one) == [t.start]


@pytest.mark.parametrize("space", [1, 2, 3, 15, 16, 17, 31, 32, 33, 47, 48, 49, 100, 1000, 4097])
def test_runs_of_spaces(pieces, space):
    """Runs of any length before words that take their last space and words that don't, and at the end."""
    t = token_counts.transducer(MODEL)
    for after in ("the", "x", "日本", "é", "\n", "0", "", "%%", "xqzzt", "<0x0A>", "▁", "\U0001f600", "of the", "thethe"):
        for before in ("", "a", "\n", "9"):
            text = before + " " * space + after + " " * (space // 2) + after
            assert t.count(text) == len(pieces.encode(text)), (before, after)


def test_texts_without_a_cut(spark, pieces):
    """Long words and runs, for which no state is known at a chunk's start, in one task and in many."""
    texts = ["ab" * 40_000, "x" + "e" * 70_000, " " * 90_000 + "the", "the" * 9_000, "日" * 5_000, "1" * 20_000 + "\n" + "the " * 9_000]
    t = token_counts.transducer(MODEL)
    assert [t.count(x, 5000) for x in texts] == [t.count(x) for x in texts] == [len(pieces.encode(x)) for x in texts]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, 100, 6000).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(pieces.encode(x))) for i, x in enumerate(texts)]


def test_recycled_states(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_STATES", 50)
    t = token_counts.Transducer(*token_counts._vocabulary(MODEL))
    text = "Several ordinary words, and unusual ones: xqzzt & ñandú " * 3
    assert t.count(text) == len(pieces.encode(text)) and F is not None
