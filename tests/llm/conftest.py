import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASHING = ("th", "seed", "seeds", "n", "fp", "key", "keep_id", "kept", "copies", "digest", "at", "salt", "rank", "score", "component_id", "group_size", "file", "row", "length", "good", "low", "topic", "factor", "_file", "_row", "_stay", "_metadata", "kinds", "trigram", "more")


def messy_rows():
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, shared passages, secrets."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), prose(150)
    texts = [None, "", "   \n\t", "one", "two words", base, base, base + " tail", base.replace(" ", "  ", 3), prose(6000), passage + "\n" + prose(40), prose(30) + " " + passage, prose(20) + " " + passage + " " + prose(20)]
    texts += ["é" * 300, "é" * 300 + "x", "日本語 " * 40, 'password = "hunter22" and TOKEN: abcdefgh', "AKIA" + "A1" * 9, "0123456789abcdef" * 3, "token=token:abcdefgh"]
    texts += ["junk %%% $$$ " * 30, "THE THE THE " * 20, "a" * 1000, (prose(25) + "\n") * 5, "<|endoftext|> inside", *[prose(rng.randint(5, 80)) for _ in range(20)]]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (5, base, "en", "s1", len(base)), (None, "row without an id", None, None, None), (None, base, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def rows():
    return messy_rows()
