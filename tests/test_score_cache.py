"""Caches that survive broken runs, and batches of like cost."""

import random

import pytest
from pyspark.sql import functions as F

from passant.functions import scorers
from passant.operators.score_cache import ScoreCache


def pairs(spark, n=200):
    return spark.range(n).select((F.col("id") % 10).alias("query_id"), F.col("id").alias("passage_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))


class Broken(RuntimeError):
    pass


def by_length(rows):
    return rows.withColumn("score", F.length("text") + F.col("passage_id") / 1000)


def test_a_run_that_dies_before_it_publishes(spark, tmp_path, monkeypatch):
    """A part is written and the run ends: nobody reads it, its pairs are scored again, and no pair is there twice."""
    cache, asked = ScoreCache(spark, f"file://{tmp_path}/c"), pairs(spark)
    seen = []

    def scorer(rows):
        seen.append(sorted(r["passage_id"] for r in rows.select("passage_id").collect()))
        return by_length(rows)

    publish = ScoreCache.publish

    def dies(self, *args):
        if len(seen) == 3:
            raise Broken
        publish(self, *args)

    monkeypatch.setattr(ScoreCache, "publish", dies)
    with pytest.raises(Broken):
        cache.run("m", asked, scorer, 4)
    monkeypatch.setattr(ScoreCache, "publish", publish)
    assert cache.manifest().count() == 2 and cache.scores("m", asked).count() == len(seen[0]) + len(seen[1]) < 200
    again = ScoreCache(spark, f"file://{tmp_path}/c").run("m", asked, scorer, 4)
    assert sorted((r["passage_id"], r["score"]) for r in again.collect()) == sorted((r["passage_id"], r["score"]) for r in by_length(asked).collect())
    assert seen[3] == seen[2] and len(seen) == 5  # the two published slices weren't asked for again
    assert cache.timing().first()["n"] == 200


def test_more_pairs_and_methods(spark, tmp_path):
    cache, few, many = ScoreCache(spark, f"file://{tmp_path}/c"), pairs(spark, 50), pairs(spark, 80)
    assert cache.run("a", few.unionByName(few), by_length, 2).count() == 50
    counted = []
    got = cache.run("a", many, lambda rows: (counted.append(rows.count()), by_length(rows))[1], 2)
    assert got.count() == 80 and sum(counted) == 30
    cache.run("b", few, lambda rows: rows.withColumn("score", F.lit(1)), 1)
    table = cache.table(["a", "b"], many)
    assert table.columns == ["query_id", "passage_id", "a", "b"] and table.where("b IS NULL").count() == 30 and table.where("a IS NULL").count() == 0
    assert cache.run("b", few, lambda rows: pytest.fail("nothing is missing")).count() == 50
    assert cache.scores("other", few).count() == 0 and cache.run("b", few.limit(0), by_length).count() == 0


def test_batches_waste_little():
    rng = random.Random(1)
    for budget, most in ((4000, 32), (300, 8)):
        lengths = sorted(int(rng.lognormvariate(5, 1)) + 1 for _ in range(3000))
        cuts = scorers.length_batches(lengths, budget, most)
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == 3000
        padded = sum(lengths[b - 1] * (b - a) for a, b in cuts)
        assert padded <= 1.1 * sum(lengths)
        assert all(b - a <= most and (b - a == 1 or lengths[b - 1] * (b - a) <= budget) for a, b in cuts)
    assert scorers.length_batches([], 10, 2) == []


def test_answers_keep_their_rows(spark):
    """Lengths of the whole table are sorted, not those of a partition; every row gets its own answer."""

    def echo():
        def model(prompts):
            assert max(map(len, prompts)) <= 1.1 * max(1, min(map(len, prompts))) and len(prompts) <= 32
            return [p[::-1] for p in prompts]

        return model

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 300, 2000, rng.randint(1, 900)]))), [i, i + 1]) for i in range(800)] + [(800, None, None)]
    df = spark.createDataFrame(rows, "i int, prompt string, extra array<int>").repartition(7)
    got = {r["i"]: (r["prompt"], r["extra"], r["answer"]) for r in scorers.generate(df, "prompt", "answer", echo).collect()}
    assert got == {i: (p, e, p if p is None else p[::-1]) for i, p, e in rows}
    spans = scorers.generate(df, "prompt", "answer", echo).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.length("prompt")).alias("lo"), F.max(F.length("prompt")).alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:], strict=False))
