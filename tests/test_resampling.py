"""Bootstrap and sign flips in parts, against enumeration, coverage and the binomial law."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passant.operators import resampling, stats


def test_draws_of_all_parts_are_multinomial():
    """The parts' draws add up to n in every replicate, and have the mean and variance of a multinomial."""
    sizes, n, reps = [5, 9, 0, 30, 16, 0, 0, 40], 100, 20_000
    node = {(3, i): s for i, s in enumerate(sizes)}
    for level in (2, 1, 0):
        node |= {(level, i): node[level + 1, 2 * i] + node[level + 1, 2 * i + 1] for i in range(1 << level)}
    drawn = {}
    for part, size in enumerate(sizes):
        if size:
            path = [(level, part >> (3 - level), node[level, part >> (3 - level) & ~1], node[level, part >> (3 - level) | 1]) for level in (1, 2, 3)]
            drawn[part] = resampling.draws_of(path, n, reps, "g", 1)
    assert (sum(drawn.values()) == n).all()
    for part, d in drawn.items():
        p = sizes[part] / n
        assert abs(d.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / reps) and abs(d.var() / (n * p * (1 - p)) - 1) < 0.06
    a, b = drawn[3], drawn[7]  # what one part has the others lack
    assert abs(np.cov(a, b)[0, 1] + n * 0.3 * 0.4) < 0.7


def test_replicates_draw_whole_rows(spark):
    """Sums of ones are n, in one part or in many; a column and its double are drawn together; other draws by another seed."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("q"), F.lit(1.0).alias("one"), F.col("id").cast("double").alias("v"), (F.col("id") * 2.0).alias("w"))
    for most in (None, 100):
        got = resampling.bootstrap_sums(rows, ["one", "v", "w"], ["q"], ["g"], 50, most=most)
        assert got.count() == 150 and got.where("one <> 1000 OR abs(w - 2 * v) > 1e-6").count() == 0
        assert got.select("v").distinct().count() > 140
    again = resampling.bootstrap_sums(rows.repartition(7), ["v"], ["q"], ["g"], 50, most=100).orderBy("g", "_rep").collect()
    assert again == got.select("g", "_rep", "v").orderBy("g", "_rep").collect()


@pytest.mark.parametrize("most", [None, 40])
def test_interval_is_that_of_the_bootstrap(spark, most):
    """Ends lie where a plain bootstrap's lie, to the noise of 2 000 draws, and cover the mean as often as they should."""
    rng = np.random.default_rng(4)
    data = [(g, q, float(x)) for g in range(60) for q, x in enumerate(rng.normal(size=80))]
    got = resampling.bootstrap_ci(spark.createDataFrame(data, "g int, q int, x double"), "x", ["q"], ["g"], 2000, most=most).collect()
    cover = 0
    for r in got:
        x = np.array([v for g, _, v in data if g == r["g"]])
        plain = np.quantile(rng.choice(x, (4000, 80)).mean(axis=1), [0.025, 0.975])
        assert abs(r["mean"] - x.mean()) < 1e-12 and r["n"] == 80
        assert np.abs(plain - [r["lo"], r["hi"]]).max() < 0.25 * x.std() / math.sqrt(80) * 1.6
        cover += r["lo"] <= 0 <= r["hi"]
    assert cover >= 50


def test_null_keys_and_values(spark):
    rows = [(None, 1, 1.0), (None, 2, 3.0), ("a", 1, 5.0), ("a", 2, None), ("a", 3, float("nan")), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, q int, x double")
    got = {r["g"]: r for r in resampling.bootstrap_ci(df, "x", ["q"], ["g"], 200).collect()}
    assert set(got) == {None, "a"} and got["a"][1:] == (5.0, 5.0, 5.0, 1) and got[None]["mean"] == 2.0
    assert {r["g"]: r["n"] for r in resampling.sign_flip(df, "x", ["q"], ["g"], 100).collect()} == {None: 2, "a": 1}
    assert resampling.bootstrap_ci(df.limit(0), "x", ["q"], ["g"], 10).count() == resampling.sign_flip(df.limit(0), "x", ["q"], ["g"], 10).count() == 0


@pytest.mark.parametrize("most", [None, 4])
def test_sign_flips_match_enumeration(spark, most):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(0.4, 1, 11), "b": rng.normal(0, 1, 3), "c": np.array([1.0, 1.0, 1.0, 1.0, -0.5]), "d": rng.integers(-3, 4, 13) * 0.5}
    df = spark.createDataFrame([(g, i, float(x)) for g, d in groups.items() for i, x in enumerate(d)], "g string, q int, x double")
    flips = 200_000
    for r in resampling.sign_flip(df, "x", ["q"], ["g"], flips, most=most).collect():
        d = groups[r["g"]]
        every = np.abs(np.array(list(itertools.product([-1, 1], repeat=len(d)))) @ d)
        p = (every >= abs(d.sum()) - 1e-9).mean()
        assert abs(r["p"] - p) < 5 * math.sqrt(p * (1 - p) / flips) + 1e-5 and r["mean"] == pytest.approx(d.mean())


def test_many_values_in_many_parts(spark):
    """A group far larger than a part: no task gets more than a part's worth, and p is the normal one."""
    df = spark.range(40_000).select(F.col("id").alias("q"), (F.randn(3) + 0.008).alias("x"))
    most = 1000
    parted = resampling._parted(df, (), ["q"], most)
    assert parted.groupBy("_part").count().agg(F.max("count")).first()[0] < 1.3 * most
    mean, sd = df.agg(F.avg("x"), F.stddev("x")).first()
    got = resampling.sign_flip(df, "x", ["q"], (), 20_000, most=most).first()
    assert abs(got["p"] - math.erfc(abs(mean) / sd * 200 / math.sqrt(2))) < 0.02
    ci = resampling.bootstrap_ci(df, "x", ["q"], (), 500, most=most).first()
    assert abs((ci["hi"] - ci["lo"]) / (2 * 1.96 * sd / 200) - 1) < 0.12


def test_clustered(spark):
    """Units are drawn and flipped whole; p by enumeration over the signs of units."""
    rng = np.random.default_rng(8)
    rows = [(m, q, float(rng.normal(0.3, 1))) for m in "xyz" for q in range(10) if (q + ord(m)) % 4]
    got = resampling.clustered(spark.createDataFrame(rows, "llm string, query_id int, d double"), replicates=4000, flips=50_000).first()
    cols = {m: np.array([[q, d] for k, q, d in rows if k == m]) for m in "xyz"}
    stat = lambda w, s: np.mean([np.sum(w[c[:, 0].astype(int)] * s[c[:, 0].astype(int)] * c[:, 1]) / np.sum(w[c[:, 0].astype(int)]) for c in cols.values()])
    one = np.ones(10)
    seen = stat(one, one)
    every = np.array([stat(one, np.array(s)) for s in itertools.product([-1.0, 1.0], repeat=10)])
    p = (np.abs(every) >= abs(seen) - 1e-12).mean()
    assert got["macro"] == pytest.approx(seen) and abs(got["p"] - p) < 0.01 and got["n_units"] == 10 and got["n_pairs"] == len(rows)
    boot = [stat(np.bincount(rng.integers(0, 10, 10), minlength=10).astype(float), one) for _ in range(4000)]
    assert np.abs(np.percentile(boot, [2.5, 97.5]) - [got["lo"], got["hi"]]).max() < 0.06


def test_hash_draws_are_not_counted_in_tables(spark):
    """Draws meet their rows in parts; they were counted in tables of every replicate and position of a whole group."""
    x = [float(v) for v in np.random.default_rng(8).normal(size=50)]
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(x)], "dataset string, query_id int, s double")
    got = stats.hash_bootstrap(rows, "s", "query_id", ["dataset"], 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*_pos#", plan) and "ShuffledHashJoin" in plan
    hashed = lambda rep, slot: int(hashlib.md5(f"{rep}:{slot}".encode()).hexdigest()[:8], 16) / 4294967296
    means = [np.mean([x[int(hashed(rep, slot) * 50)] for slot in range(1, 51)]) for rep in range(100)]
    assert (got.first()["lo"], got.first()["hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_columns_are_drawn_together(spark, monkeypatch):
    """A replicate's draws were made anew for every model and metric; now once for all columns that the same rows have."""
    rng = np.random.default_rng(9)
    data = [("ab"[q % 2] if q % 5 else None, q, *map(float, rng.normal(size=3)), None if q % 3 else 1.0 * q) for q in range(400)]
    df = spark.createDataFrame([*data, ("a", 900, None, float("nan"), None, None)], "g string, q int, x double, y double, z double, w double")
    df = df.withColumn("z", F.when(F.col("g") == "b", None).otherwise(F.col("z")))
    seen = []
    sums = resampling.bootstrap_sums
    monkeypatch.setattr(resampling, "bootstrap_sums", lambda values, *rest, **more: seen.append(values) or sums(values, *rest, **more))
    for few in (resampling.FEW, 0):
        monkeypatch.setattr(resampling, "FEW", few)
        for most in (None, 30):
            whole = resampling.bootstrap_cis(df, ["x", "y"], ["q"], ["g"], 2000, most=most).collect()
            got = resampling.bootstrap_cis(df, ["x", "y", "z", "w"], ["q"], ["g"], 2000, most=most).collect()
            assert len(whole) == 6 and len(got) == 11
            for r in [*whole, *got]:
                x = np.array([v[2 + r["_at"]] for v in data if v[0] == r["g"] and v[2 + r["_at"]] is not None])
                plain = np.quantile(rng.choice(x, (4000, len(x))).mean(axis=1), [0.025, 0.975])
                assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean()) and np.abs(plain - [r["lo"], r["hi"]]).max() < 0.4 * x.std() / math.sqrt(len(x))
    assert [v.count() for v in seen[:2]] == [400, 400 + 134]  # a row for all columns, and one for what others lack
    assert resampling.bootstrap_cis(df.limit(0), ["x", "y"], ["q"], ["g"], 10).count() == 0
