"""Splits, folds, guards, tests and models: vectors and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passant.operators import features, metrics, models, protocol, stats
from passant.plans import studies
from passant.schemas import FEATURES


def test_folds_cover_once_and_even(spark):
    rows = spark.createDataFrame([(f"q{i}",) for i in range(23)] * 2, "query_id string")
    folds = [r["fold"] for r in protocol.group_folds(rows, "query_id", 5).collect()]
    assert sorted(np.bincount(folds)[1:], reverse=True) == [5, 5, 5, 4, 4] and len(folds) == 23
    assert sorted(np.bincount(list(protocol.exact_group_folds([f"q{i}" for i in range(23)]).values()))[1:], reverse=True) == [5, 5, 5, 4, 4]


def test_split_keeps_queries_whole(spark):
    rows = spark.createDataFrame([(f"q{i}", p) for i in range(40) for p in range(3)], "query_id string, passage_id int")
    sides = protocol.hash_split(rows, F.col("query_id"), 0.3).groupBy("query_id").agg(F.countDistinct("is_test").alias("n"))
    assert sides.where("n > 1").count() == 0


def test_label_guard(spark):
    mixed = spark.createDataFrame([("a",), ("b",)], "label_source string")
    with pytest.raises(ValueError):
        protocol.require_one_label_source(mixed)
    with pytest.raises(ValueError):
        protocol.require_one_label_source(mixed.limit(0))
    assert protocol.require_one_label_source(mixed.limit(1)) == "a"


def test_leave_one_out_needs_two(spark):
    with pytest.raises(ValueError):
        protocol.leave_one_out(spark.createDataFrame([("a",)], "dataset string"))


def test_aligned_refuses_loss(spark):
    left = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, passage_id int")
    with pytest.raises(KeyError):
        protocol.aligned(left, left.limit(1).withColumn("z", F.lit(1)))


def test_holm(spark):
    tests = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.02)], "test string, p double")
    assert [r["p_holm"] for r in stats.holm(tests).orderBy("test").collect()] == pytest.approx([0.04, 0.03, 0.04])


def test_describe_finds_an_effect():
    d = np.random.default_rng(0).normal(0.5, 1, 60)
    got = stats.describe(d, flips=5000)
    assert got["p_permutation"] < 0.01 and got["p_t"] < 0.01 and got["p_wilcoxon"] < 0.01 and got["p_shapiro"] > 0.05
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803477074)
    assert stats.sign_test_p(np.array([1.0] * 8 + [-1.0])) == pytest.approx(0.0390625)


def test_signed_ranks_match_enumeration():
    d = np.array([0.3, -0.1, 0.8, 1.1, -0.5, 0.9, 1.4, 0.2])
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    sums = np.array([ranks[[bool(m >> i & 1) for i in range(8)]].sum() for m in range(256)])
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert stats.wilcoxon_p(d) == pytest.approx(min(1.0, 2 * (sums <= low).mean()))


def test_p_from_interval():
    got = stats.p_from_interval(0.2, 0.1, 0.4)
    assert got["asymmetry"] == pytest.approx(1 / 3) and got == stats.p_from_interval(0.2, 0.1, 0.4, None)
    assert stats.p_from_interval(0.2, 0.0, 0.3)["asymmetry"] == pytest.approx(1 / 3)
    assert stats.p_from_interval(0.2, 0.1, 0.3, 11)["p"] == pytest.approx(stats.t_tail(got["z"] * 1.5, 10))


def test_exact_bootstrap_is_numpy(spark):
    x = np.random.default_rng(3).normal(size=20)
    rows = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(x)], "dataset string, query_id int, s double")
    got = stats.exact_bootstrap(rows, "s", "query_id", ["dataset"], 200).first()
    rng = np.random.default_rng(0)
    means = [rng.choice(x, len(x), replace=True).mean() for _ in range(200)]
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_calibrator_never_inverts(spark):
    rows = spark.createDataFrame([(0.1, 0.9), (0.2, 0.7), (0.3, 0.8), (0.4, 0.2), (0.5, 0.1)], "base double, true double")
    got = models.linear_calibrator(rows).first()
    assert got["fell_back"] and got["alpha"] == 1.0 and got["beta"] == pytest.approx(0.54 - 0.3)
    flat = models.linear_calibrator(rows.withColumn("base", F.lit(1.0))).first()
    assert flat["fell_back"]


@pytest.fixture(scope="module")
def simpson(spark):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(30):
        for p in range(8):
            inside = rng.normal()
            rows.append((f"d{q % 3}", f"q{q}", p, 2.0 * q + inside, float(rng.normal()), -inside + 6.0 * q))
    return spark.createDataFrame(rows, "dataset string, query_id string, passage_id int, x1 double, x2 double, y double").cache()


@pytest.mark.parametrize("algorithm", ["ridge", "gbr"])
def test_centring_undoes_simpson(spark, simpson, algorithm):
    def rho(centre):
        model = models.Predictor(("x1", "x2"), algorithm, centre, {"alpha": 1.0, "n_estimators": 8, "max_depth": 3}).fit(simpson, "y", "query_id")
        out = model.predict(simpson, "query_id" if centre else None).withColumn("score", F.col("prediction"))
        return metrics.per_query_scores(out).agg(F.avg("spearman")).first()[0]

    assert rho(True) > 0.8 and rho(False) < 0.2


def test_centred_predictions_ignore_shifts(spark, simpson):
    model = models.Predictor(("x1", "x2"), "ridge", True).fit(simpson, "y", "query_id")
    moved = simpson.withColumn("x1", F.col("x1") + F.length("query_id") * 7.0)
    a, b = (model.predict(t, "query_id").orderBy("query_id", "passage_id").toPandas()["prediction"] for t in (simpson, moved))
    assert np.allclose(a, b)


def test_ridge_is_the_closed_form(spark, simpson):
    pdf = simpson.toPandas()
    x = pdf[["x1", "x2"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 100 * np.eye(2), z.T @ (pdf["y"] - pdf["y"].mean()))
    got = models.Predictor(("x1", "x2")).fit(simpson).predict(simpson).orderBy("query_id", "passage_id").toPandas()["prediction"]
    want = pd.Series(z @ w + pdf["y"].mean(), index=pd.MultiIndex.from_frame(pdf[["query_id", "passage_id"]])).sort_index()
    assert np.allclose(got, want)


def test_scrambled_labels_of_a_held_out_dataset_change_no_choice(spark, simpson):
    configs = [c for c in models.grid(ridge=(1.0,), trees=()) if c.algorithm == "ridge"]
    scrambled = simpson.withColumn("y", F.when(F.col("dataset") == "d0", -F.col("y")).otherwise(F.col("y")))
    names = ["d0", "d1", "d2"]
    assert models.nested_lodo(simpson, ("x1", "x2"), configs, names)[1]["d0"] == models.nested_lodo(scrambled, ("x1", "x2"), configs, names)[1]["d0"]


def test_guards(spark, simpson):
    with pytest.raises(ValueError):
        models.Predictor(("x1",), "forest").fit(simpson)
    with pytest.raises(ValueError):
        models.Predictor(("x1",), "ridge", True).fit(simpson)


@pytest.mark.parametrize("algorithm", ["ridge", "mlp", "gbr"])
def test_save_and_load(spark, simpson, tmp_path, algorithm):
    params = {"n_estimators": 3, "max_depth": 2} if algorithm == "gbr" else {"hidden": [8], "epochs": 3} if algorithm == "mlp" else {}
    model = models.Predictor(("x1", "x2"), algorithm, False, params).fit(simpson)
    model.save(spark, f"file://{tmp_path}/m")
    again = models.Predictor.load(spark, f"file://{tmp_path}/m")
    a, b = (m.predict(simpson).orderBy("query_id", "passage_id").toPandas()["prediction"] for m in (model, again))
    assert np.allclose(a, b)


def test_feature_matrix_has_all_columns(spark):
    pairs = spark.createDataFrame([("q", 1, "what is paris?", "Paris is big.", 2.0), ("q", 2, "what is paris?", "", 8.0)], "query_id string, passage_id int, query string, text string, score double")
    got = {r["passage_id"]: r for r in features.feature_matrix(pairs).collect()}
    assert set(FEATURES) <= set(got[1].asDict()) and got[2]["bm25_norm"] == 1.0 and got[1]["rank"] == 1.0
    protocol.require_finite(features.feature_matrix(pairs), FEATURES).count()


def test_prompts_respect_threshold(spark):
    ranked = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.5, 2)], "query_id string, passage_id int, utility double, place int")
    texts = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, passage_id int, text string")
    asked = spark.createDataFrame([("q", "why"), ("r", "how")], "query_id string, query string")
    got = {r["query_id"]: r["prompt"] for r in features.prompts(asked, ranked, texts, 3, 0.5).collect()}
    assert got == {"q": "Context:\n[1] a\n\nQuery: why", "r": "Context:\n\n\nQuery: how"}


def test_variants_and_out_of_fold_probes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(60):
        for p in range(5):
            h = rng.normal(size=6)
            rows.append((f"d{q % 3}", f"q{q}", p, float(h[0] + 0.1 * rng.normal()), float(rng.normal()), float(rng.normal()), float(h[0]), h.tolist()))
    table = spark.createDataFrame(rows, "dataset string, query_id string, passage_id int, y double, x1 double, ce double, soft double, hidden array<double>")
    assert len(studies.variants()) == 36
    rho = {}
    for variant in (studies.Variant("gbr(100,d2)"), studies.Variant("gbr(100,d2)", "mix", True, True)):
        got = studies.final(table, F.col("query_id"), variant, base=("x1",), algorithm="ridge")
        rho[variant.name] = metrics.per_query_scores(got).agg(F.avg("spearman")).first()[0]
    assert rho["gbr(100,d2)|mix|ce|probe"] > 0.8 > abs(rho["gbr(100,d2)|u"]) + 0.2
    macro, tests = studies.compare(got.unionByName(got.withColumns({"model": F.lit("other"), "score": -F.col("score")})), got.first()["model"], flips=50)
    assert macro.count() == 2 and tests.count() == 3
    with pytest.raises(KeyError):
        studies.swapped(table, table.limit(5), ["x1"])
