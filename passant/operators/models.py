"""Regressors on feature columns, calibration, and the cross-validation reports built from them.

Ridge regressions are closed forms of sums that Spark adds up in one pass; boosted trees are MLlib's. Fitted models
are small; what is scored is always a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passant.operators import metrics, protocol
from passant.schemas import GROUPS

Prediction = Callable[[DataFrame], DataFrame]


def moments(rows: DataFrame, columns: Sequence[str], y: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """n, means, X'X and X'y about the means, mean and centred square sum of y: one pass of partial sums, whatever n is."""
    names = [*columns, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    n, means = row[0], np.array([x or 0.0 for x in row[1 : 1 + len(names)]])
    full = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[1 + len(names) :], strict=True):
        full[i, j] = full[j, i] = (v or 0.0) * n
    k = len(columns)
    return n, means[:k], full[:k, :k], full[:k, k], float(means[k]), float(full[k, k])


@dataclass
class Predictor:
    """A regressor with optional centring by query; columns are scaled by their population standard deviation."""

    columns: tuple[str, ...]
    algorithm: str = "ridge"
    center_by_query: bool = False
    params: dict = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    state: object = None

    def _inputs(self, rows: DataFrame, group: str | None, more: Sequence[str] = ()) -> DataFrame:
        return protocol.centered(rows, [*self.columns, *more], group) if self.center_by_query else rows

    def _scaled(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c])

    def fit(self, rows: DataFrame, y: str = "y", group: str | None = None) -> Predictor:
        if self.algorithm not in ("ridge", "gbr", "xgboost", "mlp"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.center_by_query and group is None:
            raise ValueError("centring by query needs the group column")
        data = self._inputs(rows, group, [y])
        n, means, xx, xy, y_mean, _ = moments(data, self.columns, y)
        sd = np.sqrt(np.diag(xx) / max(n, 1))
        sd[sd < 1e-12] = 1.0
        self.mean, self.scale = dict(zip(self.columns, means.tolist(), strict=True)), dict(zip(self.columns, sd.tolist(), strict=True))
        if self.algorithm == "ridge":
            gram = xx / np.outer(sd, sd)
            w = np.linalg.solve(gram + self.params.get("alpha", 100.0) * np.eye(len(sd)), xy / sd)
            self.state = (w.tolist(), y_mean)
        elif self.algorithm == "mlp":
            self.state = _fit_mlp(data.select(*[self._scaled(c).alias(c) for c in self.columns], F.col(y).alias("_y")), len(self.columns), **self.params)
        else:
            p = self.params
            tree = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="prediction", maxIter=p.get("n_estimators", 300), maxDepth=p.get("max_depth", 6), stepSize=p.get("learning_rate", 0.05), subsamplingRate=p.get("subsample", 0.8), seed=p.get("seed", 42))
            self.state = tree.fit(self._assembled(data).select("_x", y))
        return self

    def _assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(self.columns), outputCol="_x", handleInvalid="keep").transform(rows)

    def predict(self, rows: DataFrame, group: str | None = None) -> DataFrame:
        """rows with prediction. Centring without a group takes the whole table as one query."""
        own = [f"_in_{c}" for c in self.columns]
        kept = rows.withColumns({o: F.col(c) for o, c in zip(own, self.columns, strict=True)})
        data = protocol.centered(kept, own, group) if self.center_by_query else kept
        z = [(F.col(o) - F.lit(self.mean[c])) / F.lit(self.scale[c]) for o, c in zip(own, self.columns, strict=True)]
        if self.algorithm == "ridge":
            w, b = self.state
            out = data.withColumn("prediction", reduce(lambda a, x: a + x, [F.lit(k) * c for k, c in zip(w, z, strict=True)], F.lit(b)))
        elif self.algorithm == "mlp":
            out = data.withColumn("prediction", _mlp_udf(self.state)(F.array(*z)))
        else:
            inputs = VectorAssembler(inputCols=own, outputCol="_x", handleInvalid="keep").transform(data)
            out = self.state.transform(inputs).drop("_x")
        return out.drop(*own)

    def save(self, spark: SparkSession, path: str) -> None:
        """The parameters as one JSON row, trees by MLlib's own writer."""
        meta = {k: getattr(self, k) for k in ("columns", "algorithm", "center_by_query", "params", "mean", "scale")}
        if isinstance(self.state, GBTRegressionModel):
            self.state.write().overwrite().save(f"{path}/trees")
        else:
            meta["state"] = self.state
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Predictor:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        out = Predictor(tuple(meta["columns"]), meta["algorithm"], meta["center_by_query"], meta["params"], meta["mean"], meta["scale"], meta.get("state"))
        if out.state is None:
            out.state = GBTRegressionModel.load(f"{path}/trees")
        return out


def _fit_mlp(rows: DataFrame, width: int, hidden: Sequence[int] = (256, 128, 64), alpha: float = 1e-4, epochs: int = 60, batch: int = 64, rate: float = 1e-3, seed: int = 42, most_rows: int = 200_000) -> list:
    """Weights of a ReLU network by Adam with early stopping, on most_rows rows at most (the smallest by a hash of their values)."""
    data = np.array(rows.orderBy(F.xxhash64(*rows.columns)).limit(most_rows).toPandas(), float)
    rng = np.random.default_rng(seed)
    x, y = data[:, :-1], data[:, -1]
    order = rng.permutation(len(x))
    hold, use = order[: len(x) // 10], order[len(x) // 10 :]
    sizes = [width, *hidden, 1]
    net = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]
    m, v = ([[np.zeros_like(p) for p in layer] for layer in net] for _ in range(2))
    best, patience, step = (np.inf, net), 0, 0
    for _ in range(epochs):
        rng.shuffle(use)
        for at in range(0, len(use), batch):
            part, step = use[at : at + batch], step + 1
            acts = [x[part]]
            for i, (w, b) in enumerate(net):
                z = acts[-1] @ w + b
                acts.append(np.maximum(z, 0) if i < len(net) - 1 else z)
            grad = (acts[-1][:, 0] - y[part])[:, None] / len(part)
            for i in reversed(range(len(net))):
                gw, gb = acts[i].T @ grad + alpha * net[i][0], grad.sum(0)
                grad = (grad @ net[i][0].T) * (acts[i] > 0)
                for j, g in enumerate((gw, gb)):
                    m[i][j] = 0.9 * m[i][j] + 0.1 * g
                    v[i][j] = 0.999 * v[i][j] + 0.001 * g * g
                    net[i][j] = net[i][j] - rate * (m[i][j] / (1 - 0.9**step)) / (np.sqrt(v[i][j] / (1 - 0.999**step)) + 1e-8)
        check = hold if len(hold) else use
        loss = float(((_mlp(net, x[check]) - y[check]) ** 2).mean())
        if loss < best[0] - 1e-6:
            best, patience = (loss, [[p.copy() for p in layer] for layer in net]), 0
        elif (patience := patience + 1) >= 10:
            break
    return [[p.tolist() for p in layer] for layer in best[1]]


def _mlp(net: Sequence, x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(net):
        x = x @ np.asarray(w) + np.asarray(b)
        x = np.maximum(x, 0) if i < len(net) - 1 else x
    return x[:, 0]


def _mlp_udf(net: Sequence):
    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(_mlp(net, np.stack(x.to_numpy()).astype(float)) if len(x) else [])

    return apply


def linear_calibrator(pairs: DataFrame, base: str = "base", true: str = "true", keys: Sequence[str] = ()) -> DataFrame:
    """keys, alpha, beta, fell_back: least squares, or a pure shift where the slope isn't positive."""
    slope = F.try_divide(F.covar_pop(base, true), F.var_pop(base))
    fit = pairs.groupBy(*keys).agg(slope.alias("_s"), F.avg(base).alias("_b"), F.avg(true).alias("_t"))
    back = F.col("_s").isNull() | (F.col("_s") <= 0)
    alpha = F.when(back, F.lit(1.0)).otherwise(F.col("_s"))
    return fit.select(*keys, alpha.alias("alpha"), (F.col("_t") - alpha * F.col("_b")).alias("beta"), back.alias("fell_back"))


class FeatureSpaceAdapter:
    """A blend of the base score and a ridge fitted on a few calibration rows, both standardised by those rows."""

    def __init__(self, columns: Sequence[str], ridge_alpha: float = 10.0, blend: float = 0.5):
        self.columns, self.alpha, self.blend = tuple(columns), ridge_alpha, blend
        self.state: tuple | None = None

    def fit(self, rows: DataFrame, base: str = "base", y: str = "y") -> FeatureSpaceAdapter:
        _, means, xx, xy, y_mean, _ = moments(rows, self.columns, y)
        w = np.linalg.solve(xx + self.alpha * np.eye(len(means)), xy)
        scored = rows.withColumn("_r", self._ridge(w, means, y_mean))
        r = scored.agg(F.avg(base), F.stddev_pop(base), F.avg("_r"), F.stddev_pop("_r")).first()
        self.state = (w, means, y_mean, r[0], r[1] or 1.0, r[2], r[3] or 1.0)
        return self

    def _ridge(self, w: np.ndarray, means: np.ndarray, y_mean: float) -> Column:
        return reduce(lambda a, x: a + x, [F.lit(float(k)) * (F.col(c) - F.lit(float(m))) for k, c, m in zip(w, self.columns, means, strict=True)], F.lit(float(y_mean)))

    def transform(self, rows: DataFrame, base: str = "base") -> DataFrame:
        if self.state is None:
            return rows.withColumn("adapted", F.col(base))
        w, means, y_mean, bm, bs, rm, rs = self.state
        z = (F.col(base) - bm) / bs
        r = (self._ridge(w, means, y_mean) - rm) / rs
        return rows.withColumn("adapted", (1 - self.blend) * z + self.blend * r)


def hidden_probe(rows: DataFrame, hidden: str, y: str, train: Column, group: str = "query_id") -> DataFrame:
    """rows with probe: a ridge on query-centred hidden states, fitted on the training rows, penalty 10 a row.

    The hidden width is fixed by the model; its moments are summed in partials of numpy blocks and reduced once.
    """
    width = rows.select(F.size(hidden)).first()[0]
    names = [f"_h{i}" for i in range(width)]
    wide = rows.select("*", *[F.element_at(hidden, i + 1).cast("double").alias(n) for i, n in enumerate(names)])
    data = protocol.centered(wide, [*names, y], group)
    used = data.where(train)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 2, width + 2))
        for b in batches:
            m = np.column_stack([np.ones(len(b)), b[names].to_numpy(float), b[y].to_numpy(float)])
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width + 2), "v": list(total)})

    sums = used.select(*names, y).mapInPandas(partial, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    full = np.zeros((width + 2, width + 2))
    full[sums["i"], sums["j"]] = sums["x"]
    n = max(full[0, 0], 1.0)
    mean = full[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(full)[1:-1] / n - mean**2, 0)) + 1e-6
    gram = (full[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    y_mean = full[0, -1] / n
    w = np.linalg.solve(gram + 10.0 * n * np.eye(width), (full[1:-1, -1] - n * mean * y_mean) / sd)
    score = reduce(lambda a, x: a + x, [F.lit(float(k / s)) * (F.col(c) - F.lit(float(m))) for k, s, c, m in zip(w, sd, names, mean, strict=True)], F.lit(float(y_mean)))
    keys = [c for c in rows.columns]
    return data.withColumn("probe", score).select(*[c for c in keys if c != y], "probe", y)


@dataclass(frozen=True)
class Config:
    name: str
    algorithm: str
    center_by_query: bool
    params: tuple = ()

    def predictor(self, columns: Sequence[str]) -> Predictor:
        return Predictor(tuple(columns), self.algorithm, self.center_by_query, dict(self.params))


def grid(ridge: Sequence[float] = (10.0, 100.0, 1000.0), trees: Sequence[tuple[int, int]] = ((100, 2), (200, 3), (200, 5)), rate: float = 0.05) -> list[Config]:
    out = []
    for centre in (False, True):
        tag = "centered" if centre else "raw"
        out += [Config(f"ridge(a={a:g})-{tag}", "ridge", centre, (("alpha", a),)) for a in ridge]
        out += [Config(f"gbr({n},d{d})-{tag}", "gbr", centre, (("n_estimators", n), ("max_depth", d), ("learning_rate", rate))) for n, d in trees]
    return out


def fit_predict(config: Config, columns: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """(train, test) -> test with prediction."""

    def apply(train: DataFrame, test: DataFrame) -> DataFrame:
        model = config.predictor(columns)
        return model.fit(train, "y", "query_id").predict(test, "query_id" if model.center_by_query else None)

    return apply


def cross_validated(rows: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame], name: str, folds: int = 5, repeats: int = 1, seed: int = 0) -> DataFrame:
    """model, repeat, query_id, passage_id, y, score over group folds that all models share."""
    parts = []
    for r in range(repeats):
        fold = protocol.group_folds(rows, "query_id", folds, seed + r)
        marked = rows.join(fold, "query_id")
        for f in range(1, folds + 1):
            got = model(marked.where(F.col("fold") != f), marked.where(F.col("fold") == f))
            parts.append(got.select(F.lit(name).alias("model"), F.lit(r).alias("repeat"), "query_id", "passage_id", "y", F.col("prediction").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def cv_report(predictions: DataFrame, k: int = 10) -> DataFrame:
    """model, spearman, ndcg, top1, n_queries: metrics by query, averaged over repeats, then over queries."""
    per = metrics.per_query_scores(predictions, ("model", "repeat", "query_id"), k)
    mean = per.groupBy("model", "query_id").agg(*[F.avg(m).alias(m) for m in ("spearman", "ndcg", "top1")])
    return mean.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("spearman", "ndcg", "top1")], F.count(F.lit(1)).alias("n_queries"))


def lodo(rows: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame], name: str, datasets: Sequence[str]) -> DataFrame:
    """model, dataset, query_id, passage_id, y, score: each dataset scored by a model of the others. datasets is a short list of names."""
    parts = []
    for held in datasets:
        got = model(rows.where(F.col("dataset") != held), rows.where(F.col("dataset") == held))
        parts.append(got.select(F.lit(name).alias("model"), "dataset", "query_id", "passage_id", "y", F.col("prediction").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def mean_rho(predictions: DataFrame) -> float:
    return metrics.per_query_scores(predictions).agg(F.avg("spearman")).first()[0] or 0.0


def nested_lodo(rows: DataFrame, columns: Sequence[str], configs: Sequence[Config], datasets: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Predictions for each held-out dataset by the configuration that does best inside the others, and which it was.

    The choice for a dataset never sees its labels. Ties go to the earlier configuration.
    """
    parts, chosen = [], {}
    for held in datasets:
        inside = rows.where(F.col("dataset") != held)
        rest = [d for d in datasets if d != held]
        rho = [np.mean([mean_rho(lodo(inside, fit_predict(c, columns), c.name, [d])) for d in rest]) for c in configs]
        best = configs[int(np.argmax(rho))]
        chosen[held] = best.name
        got = fit_predict(best, columns)(inside, rows.where(F.col("dataset") == held))
        parts.append(got.select(F.lit("nested").alias("model"), "dataset", "query_id", "passage_id", "y", F.col("prediction").alias("score")))
    return reduce(DataFrame.unionByName, parts), chosen


def ablation(rows: DataFrame, config: Config, groups: dict[str, Sequence[str]] | None = None, folds: int = 3) -> DataFrame:
    """model (all, drop_G, only_G) with its cross-validated metrics; each is trained anew on its columns."""
    groups = groups or GROUPS
    every = [c for g in groups.values() for c in g]
    subsets = {"all": every} | {f"drop_{g}": [c for c in every if c not in cols] for g, cols in groups.items()} | {f"only_{g}": list(cols) for g, cols in groups.items()}
    parts = [cross_validated(rows, fit_predict(config, cols), name, folds) for name, cols in subsets.items() if cols]
    return cv_report(reduce(DataFrame.unionByName, parts))


def transfer(train: DataFrame, targets: dict[str, DataFrame], config: Config, columns: Sequence[str]) -> DataFrame:
    """target, spearman, ndcg, top1 of one model fitted on train and applied to each target."""
    model = config.predictor(columns).fit(train, "y", "query_id")
    parts = [model.predict(t, "query_id" if model.center_by_query else None).select(F.lit(n).alias("target"), "query_id", "passage_id", "y", F.col("prediction").alias("score")) for n, t in targets.items()]
    per = metrics.per_query_scores(reduce(DataFrame.unionByName, parts), ("target", "query_id"))
    return per.groupBy("target").agg(*[F.avg(m).alias(m) for m in ("spearman", "ndcg", "top1")])


def few_shot(rows: DataFrame, k: int, base: str = "base", y: str = "y", seed: int = 0) -> DataFrame:
    """The rows outside a seeded draw of k, with base calibrated on the draw (score) and as it is (zero_shot)."""
    drawn = protocol.sample_items(rows.select("passage_id", base, y), k, "passage_id", seed)
    fit = linear_calibrator(drawn, base, y)
    rest = rows.join(drawn.select("passage_id"), "passage_id", "left_anti")
    return rest.crossJoin(F.broadcast(fit)).withColumns({"score": F.col("alpha") * F.col(base) + F.col("beta"), "zero_shot": F.col(base)}).drop("alpha", "beta", "fell_back")
