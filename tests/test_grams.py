"""Models of many training sets from one scan, against models fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passant.operators import grams, metrics, models, protocol

COLUMNS = ("a", "b", "c")


def table(spark, seed=0, datasets=("p", "q", "r", "s"), queries=12, size=5, simpson=False):
    """Each dataset has its own level; with simpson the column's slope inside queries is the opposite of that between."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, d in enumerate(datasets):
        for q in range(queries):
            level = rng.normal() * 4
            for i in range(size):
                x = rng.normal(size=3) + [level, k, 100]
                y = -x[0] + 3 * level if simpson else 0.5 * x[0] - x[1] * k + rng.normal()
                rows.append((d, f"{d}{q}", i, *map(float, x), float(y)))
    return spark.createDataFrame(rows, "dataset string, query_id string, passage_id int, a double, b double, c double, y double")


@pytest.mark.parametrize("centred", [False, True])
def test_subtracted_ridge_is_the_refitted_one(spark, centred):
    rows = table(spark)
    held = grams.cells(grams.by_query(rows, COLUMNS), 4, ["dataset"])
    whole = grams.total(held.values())
    for d in ("p", "r"):
        for cols in (None, (0, 2)):
            w, b = (whole - held[d,]).ridge(10.0, centred, cols)
            names = COLUMNS if cols is None else tuple(COLUMNS[i] for i in cols)
            model = models.Predictor(names, "ridge", centred, {"alpha": 10.0}).fit(rows.where(F.col("dataset") != d), "y", "query_id")
            scale = np.array([model.scale[c] for c in names])
            mean = np.array([model.mean[c] for c in names])
            want = np.array(model.state[0]) / scale
            assert np.allclose(w[list(cols or range(3))], want, rtol=1e-7, atol=1e-9) and (cols is None or w[1] == 0)
            assert b == pytest.approx(model.state[1] - want @ mean, abs=1e-7)


def test_cross_validation_never_sees_the_fold(spark):
    rows = table(spark, 1)
    config = models.Config("r", "ridge", True, (("alpha", 100.0),))
    one = models.cross_validated(rows, models.fit_predict(config, COLUMNS), "r", 3, 2)
    many = grams.cross_validated(rows, COLUMNS, [grams.Ridge("r", 100.0, True)], 3, 2)
    assert many.count() == 2 * rows.count()
    a, b = ({(r["repeat"], r["query_id"]): (r["spearman"], r["ndcg"], r["top1"]) for r in metrics.per_query_scores(x, ("repeat", "query_id")).collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_left_out_and_report(spark):
    rows = table(spark, 2)
    got = grams.left_out(rows, COLUMNS, [grams.Ridge("ridge", 100.0), *grams.subsets({"x": ("a",), "y": ("b", "c")}, COLUMNS)])
    base = grams.baselines(rows, {"dense": "a"}, got)
    means, pairs = grams.report(got.unionByName(base), "ridge", ["dataset"], 300)
    assert {r["model"] for r in means.select("model").distinct().collect()} == {"ridge", "all", "drop_x", "only_x", "drop_y", "only_y", "dense"}
    one = models.lodo(rows, models.fit_predict(models.Config("m", "ridge", False, (("alpha", 100.0),)), COLUMNS), "m", ("p", "q", "r", "s"))
    want = {r["dataset"]: r["spearman"] for r in metrics.per_query_scores(one, ("dataset", "query_id")).groupBy("dataset").agg(F.avg("spearman").alias("spearman")).collect()}
    own = {r["dataset"]: r for r in means.where("model = 'ridge' AND metric = 'spearman'").collect()}
    assert all(own[d]["mean"] == pytest.approx(want[d]) and own[d]["lo"] <= want[d] <= own[d]["hi"] and own[d]["n"] == 12 for d in want)
    d = {(r["dataset"], r["other"]): r["mean"] for r in pairs.where("metric = 'spearman'").collect()}
    dense = {r["dataset"]: r["mean"] for r in means.where("model = 'dense' AND metric = 'spearman'").collect()}
    assert all(d[k, "dense"] == pytest.approx(want[k] - dense[k]) for k in want)
    with pytest.raises(ValueError):
        grams.left_out(rows.where("dataset = 'p'"), COLUMNS, [grams.Ridge("ridge")])


def test_nested_selection_chooses_inside(spark):
    """Where only the slope inside queries carries over, centring wins, and the choice is that of loops over all pairs."""
    rows = table(spark, 3, simpson=True)
    configs = grams.ridge_grid((10.0, 1000.0))
    got = grams.nested(rows, COLUMNS, configs)
    assert {r["selected"] for r in got.summary().collect()} <= {"ridge(a=10)-centered", "ridge(a=1000)-centered"}
    loop = [models.Config(c.name, "ridge", c.centred, (("alpha", c.alpha),)) for c in configs]
    _, chosen = models.nested_lodo(rows, COLUMNS, loop, ("p", "q", "r", "s"))
    assert {r["dataset"]: r["selected"] for r in got.summary().collect()} == chosen
    macro = got.macro().first()
    assert macro["optimism"] == pytest.approx(macro["oracle"] - macro["nested"]) and macro["optimism"] >= 0
    assert got.predictions.count() == rows.count() and sum(r["datasets"] for r in got.frequency().collect()) == 4
    assert got.final().first()["model"].endswith("centered")
    assert all(r["oracle"] >= r["spearman"] for r in got.summary().collect())


def test_nested_selection_with_trees_and_ties(spark):
    rows = table(spark, 4, ("p", "q", "r"), 4, 4)
    trees = models.fit_predict(models.Config("gbr", "gbr", False, (("n_estimators", 1), ("max_depth", 1))), COLUMNS)
    got = grams.nested(rows, COLUMNS, [grams.Ridge("first", 10.0), grams.Ridge("same", 10.0)], {"gbr": trees})
    assert got.outer.count() == 9 and got.inner.count() == 9
    assert {r["selected"] for r in got.summary().collect()} <= {"first", "gbr"}  # a tie goes to the earlier one
    with pytest.raises(ValueError):
        grams.nested(rows.where("dataset <> 'p'"), COLUMNS, [grams.Ridge("first")])


def test_nulls_and_constant_columns(spark):
    rows = table(spark, 5).withColumn("b", F.lit(2.0)).withColumn("c", F.when(F.col("passage_id") == 0, None).otherwise(F.col("c")))
    got = grams.left_out(rows, COLUMNS, [grams.Ridge("ridge")])
    assert got.count() == rows.where("passage_id <> 0").count() and got.where("score IS NULL OR isnan(score)").count() == 0


def _queries(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{q % 3}", q, p, *map(float, rng.integers(0, 4, 3))) for q in range(60) for p in range(int(rng.integers(1, 9)))]
    return spark.createDataFrame(rows, "dataset string, query_id long, passage_id int, x1 double, x2 double, y double")


def test_folds_without_a_join(spark):
    for n in (3, 60):
        rows = _queries(spark).where(f"query_id < {n}")
        want = {(r["query_id"], r["repeat"]): r["fold"] for r in protocol.repeated_folds(rows).collect()}
        got = rows.select("query_id", F.posexplode(F.array(*protocol.fold_columns(rows))).alias("repeat", "fold")).distinct().collect()
        assert {(r["query_id"], r["repeat"]): r["fold"] for r in got} == want and len(got) == len(want)


def test_metrics_without_rows_for_each_model(spark):
    """The same as by predictions, while no row is multiplied by models, repeats or datasets held out."""
    rows, columns = _queries(spark), ("x1", "x2")
    configs = grams.subsets({"a": ("x1",), "b": ("x2",)}, columns)
    key = lambda r: tuple(str(r[c]) for c in ("model", "dataset", "query_id"))
    values = lambda df: {key(r): [r[m] for m in grams.METRICS] for r in df.collect()}
    long = metrics.per_query_scores(grams.cross_validated(rows, columns, configs), ("model", "dataset", "query_id", "repeat"))
    want = values(long.groupBy("model", "dataset", "query_id").agg(*[F.avg(m).alias(m) for m in grams.METRICS]))
    got = values(grams.cross_validated_metrics(rows, columns, configs))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    want = values(metrics.per_query_scores(grams.left_out(rows, columns, configs), ("model", "dataset", "query_id")))
    left = grams.left_out_metrics(rows, columns, configs)
    got = values(left)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert "Join" not in left._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_models_and_columns_in_one_pass(spark):
    """One row for a query and all models and plain columns: the same as apart, where each has rows that the other lacks."""
    rows, columns = _queries(spark), ("x1", "x2")
    rows = rows.withColumn("x1", F.when(F.col("query_id") % 7 == 3, None).otherwise(F.col("x1"))).withColumn("x2", F.when((F.col("query_id") % 5 == 1) & (F.col("passage_id") == 0), float("nan")).otherwise(F.col("x2")))
    rows = rows.withColumn("y", F.when(F.col("passage_id") == 2, None).otherwise(F.col("y"))).withColumn("query_id", F.when(F.col("query_id") == 8, None).otherwise(F.col("query_id")))
    rows = rows.withColumn("dataset", F.when(F.col("query_id") == 9, None).otherwise(F.col("dataset")))
    configs, plain = grams.subsets({"a": ("x1",), "b": ("x2",)}, columns), {"size": "x1", "price": "x2"}
    key = lambda r: tuple(str(r[c]) for c in ("model", "dataset", "query_id"))
    values = lambda df: {key(r): [r[m] for m in grams.METRICS] for r in df.collect()}
    base = values(grams.baseline_metrics(rows, plain))
    for apart, one in ((grams.cross_validated_metrics(rows, columns, configs), grams.cross_validated_wide(rows, columns, configs, plain)), (grams.left_out_metrics(rows, columns, configs), grams.left_out_wide(rows, columns, configs, plain))):
        want, got = values(apart) | base, {}
        for r in one.frame.collect():
            for n in one.names:
                if r[one.column(n, "spearman")] is not None:
                    got[n, str(r["dataset"]), str(r["query_id"])] = [r[one.column(n, m)] for m in grams.METRICS]
        assert got.keys() == want.keys() and len({k[1:] for k in got}) == one.frame.count()
        for k in want:
            assert all((a is None) == (b is None) and (a is None or np.allclose(a, b, equal_nan=True)) for a, b in zip(got[k], want[k], strict=True)), k


def test_rows_are_gathered_once(spark):
    """Folds, Gram matrices and metrics read a row for each dataset and query, where each of them shuffled all rows before."""
    rows = _queries(spark).withColumn("dataset", F.concat("dataset", (F.col("passage_id") % 2).cast("string")))
    rows = rows.withColumn("x1", F.when(F.col("passage_id") > 0, F.col("x1"))).repartition(3)
    groups = metrics.gathered(rows, ["dataset", "query_id"], ["x1"])
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and plan.count("Exchange") == 2  # the other is the test's own
    got, want = {(r["dataset"], r["query_id"]): r for r in groups.collect()}, {}
    for r in sorted(rows.collect(), key=lambda r: r["passage_id"]):
        want.setdefault((r["dataset"], r["query_id"]), []).append((r["y"], r["x1"]))
    assert got.keys() == want.keys() and all(list(zip(got[k]["_y"], got[k]["_i0"], strict=True)) == want[k] for k in want)
    assert sorted(q for (_, q), r in got.items() if r["_first"]) == list(range(60))
    stored = groups.withColumns({f"_u{i}": u for i, u in enumerate(protocol.fold_hashes("query_id", 4))})
    fold = protocol.fold_columns(stored, u=[F.col(f"_u{r}") for r in range(4)], once=F.col("_first"))
    folds = {(r["query_id"], r["repeat"]): r["fold"] for r in stored.select("query_id", F.posexplode(F.array(*fold)).alias("repeat", "fold")).collect()}
    assert folds == {(r["query_id"], r["repeat"]): r["fold"] for r in protocol.repeated_folds(rows).collect()}
    whole = rows.where("x1 IS NOT NULL")
    for r, held in enumerate(grams.cells_of(stored.withColumn("_c", F.col("query_id") % 3), 1, ["_c"])):
        want_grams = grams.cells(grams.by_query(whole.withColumn("_c", F.col("query_id") % 3), ["x1"], keys=("_c", "dataset", "query_id")), 2, ["_c"])
        assert r == 0 and {(f,) for f in held} == set(want_grams)
        for f, g in held.items():
            w = want_grams[f,]
            assert g.n == w.n and all(np.allclose(a, b) for a, b in ((g.sums, w.sums), (g.inside, w.inside), (g.every, w.every)))
