"""Answer metrics, overlaps and parsers of answers on hand-made rows."""

import ast
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from passant.functions import text as X
from passant.operators import labels


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


@pytest.mark.parametrize(
    ("prediction", "golds", "exact", "relaxed", "f1"),
    [
        ("The answer is Paris.", ["Paris"], 0.0, 1.0, 0.5),
        ("withering", ["it"], 0.0, 0.0, 0.0),
        ("paris paris paris", ["paris"], 0.0, 1.0, 0.5),
        ("The  Paris!", ["paris"], 1.0, 1.0, 1.0),
        ("", ["paris"], 0.0, 0.0, 0.0),
        ("paris", [""], 0.0, 0.0, 0.0),
        ("anéan", ["ane an"], 0.0, 0.0, 0.0),
    ],
)
def test_qa_scores(spark, prediction, golds, exact, relaxed, f1):
    rows = spark.createDataFrame([("x", prediction, golds)], "pair_id string, prediction string, golds array<string>")
    got = labels.qa_scores(rows).first()
    assert (got["exact"], got["relaxed"]) == (exact, relaxed)
    assert got["f1"] == pytest.approx(f1)
    assert got["acc"] == pytest.approx(0.5 * relaxed + 0.5 * f1)


def test_normalize_is_decomposed(spark):
    # decomposed, the accents end words, so articles before them go
    got = one(spark, t="Th\u00e9  an\u00e9an, A b-c").select(labels.normalized(F.col("t")).alias("n")).first()["n"]
    assert got == "\u0301 ane\u0301 bc"


@pytest.mark.parametrize(("answer", "n", "want"), [("[3] > [1] > [3] > [9]", 4, [-1.0, -4.0, 0.0, -4.0]), ("none", 2, [-2.0, -2.0])])
def test_parse_ranking(spark, answer, n, want):
    rows = spark.createDataFrame([(answer, n)], "a string, n int")
    assert rows.select(X.parse_ranking(F.col("a"), F.col("n")).alias("s")).first()["s"] == want


@pytest.mark.parametrize(("q", "want"), [("What is love?", "love is described in this text."), ("what is?", "This text answers: what is."), ("Tell me", "This text answers the question: Tell me.")])
def test_statement(spark, q, want):
    assert one(spark, q=q).select(X.statement(F.col("q")).alias("s")).first()["s"] == want


def test_prompts(spark):
    row = spark.createDataFrame([("q?", ["a"], ["a", "b"])], "q string, one array<string>, two array<string>")
    got = row.select(X.answer_prompt(F.col("q"), F.col("one")).alias("one"), X.answer_prompt(F.col("q"), F.col("two")).alias("two"), X.rag_prompt(F.col("q"), F.col("two")).alias("rag")).first()
    assert got["one"].endswith("Passage: a\n\nQuestion: q?\nAnswer:")
    assert "Passage 1: a\n\nPassage 2: b" in got["two"]
    assert got["rag"] == "Context:\n[1] a\n\n[2] b\n\nQuery: q?"


def test_parse_golds(spark):
    rows = spark.createDataFrame([("['a', 'b']",), ("plain",), ('["x"]',)], "t string")
    assert [r[0] for r in rows.select(X.parse_golds(F.col("t"))).collect()] == [["a", "b"], ["plain"], ["x"]]


def test_entropy(spark):
    row = spark.createDataFrame([([0.0, 0.0],)], "l array<double>").select(X.entropy(F.col("l")).alias("h")).first()
    assert row["h"] == pytest.approx(0.6931471805599453)


def plain_golds(text):
    """What the literal parser of the language says; what is no literal is one gold."""
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return [text]
    return [str(v).encode("utf-16", "surrogatepass").decode("utf-16") for v in (value if isinstance(value, (list, tuple)) else [value])]  # pairs are one character


def test_literal_lists(spark):
    """Random lists and tuples in either quoting, escapes, nested quotes, numbers, and texts that are no literals."""
    rng = random.Random(2)
    pick = "a b ' \" \\ , [ ] ( ) é 日 \U0001f600 \n \t \x07 \x85 Paris 1".split(" ") + [" "]
    texts = ["[]", "()", "[,]", "[1,]", "(1)", "(1,)", "('a')", "'a', 'b'", "['a' 'b'", "['a',, 'b']", "plain", "", " ['x'] ", "[True, None, -3, 2.50, 10.0, 0]", "['\\x41\\u00e9\\101\\q']", "['it\\'s', \"it's\"]", "[\n'a',\n'b'\n]", "5", "['a\nb']"]
    for _ in range(400):
        items = [rng.choice([rng.randint(-50, 50), True, None, "".join(rng.choice(pick) for _ in range(rng.randint(0, 8)))]) for _ in range(rng.randint(0, 5))]
        texts.append(repr(items if rng.random() < 0.7 else tuple(items)))
        texts.append(json.dumps([str(x) for x in items], ensure_ascii=rng.random() < 0.5))
    texts += ["".join(rng.choice("['\",] ab1\\") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    unsure = lambda t: re.search(r"['\"]\s*['\"]|[bBrRuUfF]['\"]|[0-9]\s*[eEjJ_xob]|\\\\[uUNx]|\+", t) and t not in texts[:20]  # noqa: E731  joined or marked strings aren't lists of golds
    texts = [t for t in texts if not unsure(t)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.parse_golds(F.col("t"))).collect()]
    wrong = [(t, g, plain_golds(t)) for t, g in zip(texts, got, strict=True) if g != plain_golds(t)]
    assert not wrong, wrong[:5]
