"""Queries that read whole texts and all rows, against Python where SQL can't follow."""

import re
import string
import unicodedata
from collections import Counter

import duckdb
import pytest

from passant.functions.text import STOPWORDS
from passant.plans import catalog

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()


def normal(text):
    text = re.sub(r"\b(a|an|the)\b", " ", unicodedata.normalize("NFD", text).lower().strip())
    return "".join(c for c in text if c not in string.punctuation).split()


def span(needle, tokens):
    return bool(needle) and any(tokens[i : i + len(needle)] == needle for i in range(len(tokens) - len(needle) + 1))


def turn_pairs():
    turns = sorted(table("conversations", "conv_id, turn, text"))
    return {f"{c}:{t}": (x, y) for (c, t, x), (other, _, y) in zip(turns, turns[1:], strict=False) if c == other and x is not None and y is not None}


def scores(pair):
    p, g = map(normal, pair)
    common = sum((Counter(p) & Counter(g)).values())
    f1 = 2 * common / (len(p) + len(g)) if p and g else 0.0
    return float(p == g), float(span(g, p)), f1, 0.5 * span(g, p) + 0.5 * f1


def test_every_pair_is_scored(spark):
    pairs = turn_pairs()
    assert any(not x.isascii() or not y.isascii() for x, y in pairs.values())
    got = {r["pair_id"]: (r["exact"], r["relaxed"], r["f1"], r["acc"]) for r in catalog.queries()["f14_f20_qa_scores"](spark, SF).collect()}
    assert set(got) == set(pairs)
    assert all(got[k] == pytest.approx(scores(v), abs=1e-6) for k, v in pairs.items())


def test_every_pair_has_a_utility(spark):
    acc = {k: scores(v)[3] for k, v in turn_pairs().items()}
    base = {}
    for k, a in acc.items():
        base[k.split(":")[0]] = min(a, base.get(k.split(":")[0], a))
    got = {r["pair_id"]: r["u_true"] for r in catalog.queries()["f22_utility_label"](spark, SF).collect()}
    assert got == pytest.approx({k: a - base[k.split(":")[0]] for k, a in acc.items()}, abs=1e-6)


@pytest.mark.parametrize("name", ["f21_set_f1", "a12_exact_match_mean"])
def test_no_pair_is_dropped(spark, name):
    got = catalog.queries()[name](spark, SF).collect()
    assert (got[0]["n"] if "n" in got[0] else len(got)) == len(turn_pairs())


def test_containment_of_whole_texts(spark):
    pairs = {(r["query_id"], r["passage_id"]): r["text"] for r in catalog._pairs(spark, SF).collect()}
    golds = {k: normal(x) for k, x in table("benchmark", "item_id, text")}
    got = {(r["query_id"], r["passage_id"]): r["label"] for r in catalog.queries()["f28_answer_containment"](spark, SF).collect()}
    assert got == {(q, p): float(span(golds[q], normal(x))) for (q, p), x in pairs.items()} and any(got.values())


def test_questions_are_whole_texts(spark):
    got = {r["query_id"]: r["claim"] for r in catalog.queries()["f12_statement"](spark, SF).collect()}
    assert all(" ".join(x.split()[1:]).rstrip("?").strip() in got[k] for k, x in table("benchmark", "item_id, text"))
    terms = {r["query_id"]: set(r["terms"].split()) for r in catalog.queries()["f2_query_terms"](spark, SF).collect()}
    assert all({w for w in re.findall(r"\w+", x.lower()) if w not in STOPWORDS} == terms[k] for k, x in table("benchmark", "item_id, text") if x.isascii())
