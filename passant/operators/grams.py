"""Ridge models of many training sets from one scan: Gram matrices that add up and subtract.

Every query has a count, sums and cross products of its columns and target. They add up to cells (a dataset, or a fold of
a repeat), and a training set is the total less the cells held out. So all folds, penalties, column subsets and held-out
datasets, pairs of them included, are solved from one pass over the rows, and what reaches the driver is a matrix for
each cell. A second pass scores rows by all models that may score them.

Cross products are kept about each query's own mean and about the origin of the queries' means, so that the sums inside
and between queries stay apart: models that centre by query need the former only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.operators import metrics, protocol, resampling
from passant.session import dealt, kept

METRICS = metrics.METRICS


@dataclass
class Gram:
    """Rows, sums, cross products inside queries (about their means) and of all rows, of columns and target."""

    n: float
    sums: np.ndarray
    inside: np.ndarray
    every: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sums + other.sums, self.inside + other.inside, self.every + other.every)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.sums - other.sums, self.inside - other.inside, self.every - other.every)

    def ridge(self, alpha: float, centred: bool = False, columns: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
        """Weights of all columns (0 for those left out) and intercept of a ridge on columns scaled by their deviation."""
        k = len(self.sums) - 1
        use = np.arange(k) if columns is None else np.asarray(columns, int)
        mean = np.zeros(k + 1) if centred else self.sums / max(self.n, 1)
        about = self.inside if centred else self.every - self.n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(about)[use], 0) / max(self.n, 1))
        sd[sd < 1e-12] = 1.0
        xx, xy = about[np.ix_(use, use)] / np.outer(sd, sd), about[use, k] / sd
        weights = np.zeros(k)
        weights[use] = np.linalg.solve(xx + alpha * np.eye(len(use)), xy) / sd
        return weights, float(mean[k] - weights @ mean[:k])


def by_query(rows: DataFrame, columns: Sequence[str], y: str = "y", keys: Sequence[str] = ("dataset", "query_id")) -> DataFrame:
    """keys, n, s (sums) and c (cross products, upper triangle by rows) of columns and y: partial sums, one shuffle of
    a row for each query and task. Rows with a null among them take no part."""
    names = [*columns, y]
    whole = dealt(rows.select(*dict.fromkeys([*keys, *names])).dropna(subset=names), keys[-1])
    pairs = [F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")) for i in range(len(names)) for j in range(i, len(names))]
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(c).cast("double")) for c in names]).alias("s"), F.array(*pairs).alias("c"))


def cells(grams: DataFrame, width: int, keys: Sequence[str]) -> dict[tuple, Gram]:
    """The Gram of each cell. A cell is a dataset or a fold: as many matrices as these reach the driver."""
    ups = [(i, j) for i in range(width) for j in range(i, width)]
    inside = [F.sum(F.col("c")[k] - F.col("s")[i] * F.col("s")[j] / F.col("n")) for k, (i, j) in enumerate(ups)]
    sums = grams.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"), F.array(*inside).alias("w"), F.array(*[F.sum(F.col("c")[k]) for k in range(len(ups))]).alias("c"))
    return _grams(sums, ups, width, keys)


def _grams(sums: DataFrame, ups: Sequence[tuple[int, int]], width: int, keys: Sequence[str]) -> dict[tuple, Gram]:
    out = {}
    for r in sums.collect():
        w, c = np.zeros((width, width)), np.zeros((width, width))
        for (i, j), a, b in zip(ups, r["w"], r["c"], strict=True):
            w[i, j] = w[j, i] = a
            c[i, j] = c[j, i] = b
        out[tuple(r[k] for k in keys)] = Gram(float(r["n"]), np.array(r["s"]), w, c)
    return out


def total(grams: Iterable[Gram]) -> Gram:
    first, *rest = grams
    for g in rest:
        first = first + g
    return first


@dataclass(frozen=True)
class Ridge:
    """A configuration: its penalty, whether it centres by query, and the columns it may use (None: all)."""

    name: str
    alpha: float = 100.0
    centred: bool = False
    columns: tuple[int, ...] | None = None

    def fit(self, gram: Gram) -> tuple[np.ndarray, float]:
        return gram.ridge(self.alpha, self.centred, self.columns)


def ridge_grid(alphas: Sequence[float] = (10.0, 100.0, 1000.0)) -> list[Ridge]:
    return [Ridge(f"ridge(a={a:g})-{tag}", a, centred) for centred, tag in ((False, "raw"), (True, "centered")) for a in alphas]


def subsets(groups: Mapping[str, Sequence[str]], columns: Sequence[str], alpha: float = 100.0, centred: bool = True) -> list[Ridge]:
    """all, drop_G and only_G for each group of columns, each with a column at least."""
    at = {g: [columns.index(c) for c in cols] for g, cols in groups.items()}
    out = [Ridge("all", alpha, centred)]
    for g, own in at.items():
        out += [Ridge(f"drop_{g}", alpha, centred, rest)] if (rest := tuple(i for i in range(len(columns)) if i not in own)) else []
        out += [Ridge(f"only_{g}", alpha, centred, tuple(own))] if own else []
    return out


def scored(rows: DataFrame, columns: Sequence[str], models: Sequence[tuple], keys: Mapping[str, str], kept: Sequence[str] = ("dataset", "query_id", "passage_id", "y")) -> DataFrame:
    """keys, kept and score of each row by each model whose key values are the row's.

    models: (key values..., weights, intercept); keys: names and types of the key values, of which rows have some. A model
    that centres by query scores up to a constant of the query, which no ranking within it sees. There is a model for each
    cell and configuration, so the models are broadcast.
    """
    spark = rows.sparkSession
    schema = ", ".join([f"`{k}` {t}" for k, t in keys.items()] + ["_w array<double>", "_b double"])
    table = F.broadcast(spark.createDataFrame([(*m[:-2], [float(x) for x in m[-2]], float(m[-1])) for m in models], schema))
    shared = [k for k in keys if k in rows.columns]
    out = rows.dropna(subset=[*columns, "y"])
    for k in shared:
        out = out.withColumnRenamed(k, f"_k_{k}")
    same = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in shared]
    score = F.col("_b")
    for i, c in enumerate(columns):
        score = score + F.col("_w")[i] * F.col(c).cast("double")
    joined = out.join(table, same) if same else out.crossJoin(table)
    # twelve digits, so that sums of another order don't break ties
    return joined.select(*dict.fromkeys([*keys, *kept]), F.round(score, 12).alias("score"))


def ranked(rows: DataFrame, columns: Sequence[str], weights: np.ndarray, cells: Sequence[Column], keys: Sequence[str], mean_of: int = 1, k: int = 10) -> DataFrame:
    """per_query_lists of rows by models: weights[score, cell] are a model's weights and intercept, and cells, of which score
    i takes number i modulo their number, say which of them scores a row."""
    own = [f"_cell{i}" for i in range(len(cells))]
    used = rows.dropna(subset=[*columns, "y"]).withColumns(dict(zip(own, cells, strict=True)))
    return metrics.per_query_lists(used, keys, [*columns, *own], by_cells(len(columns), weights), k, mean_of=mean_of)


def by_cells(width: int, weights: np.ndarray) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """What makes the scores of ranked from so many columns and the cells after them."""

    def scores(inputs: list[np.ndarray]) -> list[np.ndarray]:
        x, at = inputs[:width], [c.astype(int) for c in inputs[width:]]
        out = []
        for s in range(len(weights)):
            w = weights[s][at[s % len(at)]]
            score = w[:, -1]
            for i, c in enumerate(x):
                score = score + w[:, i] * c
            out.append(np.round(score, 12) + 0.0)  # as in scored
        return out

    return scores


@dataclass
class Wide:
    """Metrics by dataset and query as a row for each of them, with columns for each name and metric. Null: not ranked by it."""

    frame: DataFrame
    names: list[str]

    def column(self, name: str, metric: str) -> str:
        return f"_v{3 * self.names.index(name) + METRICS.index(metric)}"


def gathered(rows: DataFrame, columns: Sequence[str], plain: Mapping[str, str], hashes: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
    """metrics.gathered by dataset and query as a table, with hashes (_u0, _u1, ...), and the inputs that its lists hold: rows
    are shuffled once, for folds, Gram matrices and metrics."""
    inputs = list(dict.fromkeys([*columns, *plain.values()]))
    groups = metrics.gathered(rows, ["dataset", "query_id"], inputs)
    return kept(groups.withColumns({f"_u{i}": u for i, u in enumerate(hashes)})), inputs


def cells_of(groups: DataFrame, width: int, own: Sequence[str]) -> list[dict[int, Gram]]:
    """The Gram of each cell that a column of own says, for each of these columns, from rows of gathered whose first lists are
    the models' columns, so many. Groups without a cell and rows with a null take no part."""
    lists = ["_y", *[f"_i{i}" for i in range(width)]]
    ups = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]

    def sums(batches: Iterable) -> Iterable:
        import pyarrow as pa

        got: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, (y, *x), gone = metrics.rows_of(batch, lists)
            v = np.array([*x, y])
            fits = ~np.any(gone, axis=0) & ~np.isnan(v).any(0)
            v, group = v[:, fits], group[fits]
            by = lambda w: np.bincount(group, w, batch.num_rows)  # noqa: E731, B023
            n, s, c = by(None).astype(float), np.array([by(w) for w in v]), np.array([by(v[i] * v[j]) for i, j in ups])
            inside = c - np.array([s[i] * s[j] for i, j in ups]) / np.maximum(n, 1)
            table = np.concatenate([n[None], s, inside, c])
            for r, name in enumerate(own):
                cell = batch[name].fill_null(-1).to_numpy()
                found = np.unique(cell[(cell >= 0) & (n > 0)])
                for f, z in zip(found.tolist(), (cell == found[:, None]).astype(float) @ table.T, strict=True):
                    got[r, f] = got.get((r, f), 0.0) + z
        if got:
            yield pa.RecordBatch.from_pydict({"_r": pa.array([r for r, _ in got], pa.int32()), "_f": pa.array([f for _, f in got], pa.int32()), "_z": pa.array([z.tolist() for z in got.values()], pa.list_(pa.float64()))})

    found = groups.select(*lists, *own).mapInArrow(sums, "_r int, _f int, _z array<double>")
    at = np.cumsum([0, 1, width + 1, len(ups), len(ups)]).tolist()
    z = [F.sum(F.col("_z")[i]) for i in range(at[-1])]
    whole = found.groupBy("_r", "_f").agg(z[0].alias("n"), *[F.array(*z[i:j]).alias(c) for c, i, j in zip("swc", at[1:], at[2:], strict=False)])
    out: list[dict[int, Gram]] = [{} for _ in own]
    for (r, f), gram in _grams(whole, ups, width + 1, ["_r", "_f"]).items():
        out[r][f] = gram
    return out


def wide(groups: DataFrame, inputs: Sequence[str], columns: Sequence[str], names: Sequence[str], weights: np.ndarray, own: Sequence[str], plain: Mapping[str, str], mean_of: int = 1, k: int = 10) -> Wide:
    """Metrics of models as in ranked, and of plain columns taken as scores (name: column), by dataset and query, from a table
    of gathered with its cells; a table, as several steps read them."""
    families = [metrics.Scores(names, columns, by_cells(len(columns), weights), own, mean_of)] + ([metrics.Scores(list(plain), list(plain.values()))] if plain else [])
    return Wide(kept(metrics.per_query_wide(groups, ["dataset", "query_id"], inputs, families, k)), [*names, *plain])


def named(lists: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """model, keys, spearman, ndcg and top1 from lists with a value for each of the names."""
    each = F.posexplode(F.arrays_zip(*METRICS)).alias("_at", "_z")
    return lists.select(*keys, each).select(F.array(*map(F.lit, names))[F.col("_at")].alias("model"), *keys, *[F.col("_z")[m].alias(m) for m in METRICS])


def table_of(fitted: Sequence[Sequence[tuple[np.ndarray, float]]]) -> np.ndarray:
    """weights[score, cell] of models as (weights, intercept)."""
    return np.array([[np.append(w, b) for w, b in row] for row in fitted])


def cell_of(names: Sequence, column: str) -> Column:
    """The place of a row's value among the names, of which null is one like any other; they are few."""
    return reduce(lambda a, i: F.when(F.col(column).eqNullSafe(F.lit(names[i])), F.lit(i)).otherwise(a), range(len(names)), F.lit(None).cast("int"))


def cross_validated_metrics(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], keys: Sequence[str] = ("dataset", "query_id"), folds: int = 5, repeats: int = 4, seed: int = 0, k: int = 10) -> DataFrame:
    """model, keys, spearman, ndcg and top1 of cross_validated, averaged over repeats: rows are never multiplied by models or repeats."""
    rows = rows.where("query_id is not null")
    weights, at = _fold_models(rows, columns, models, folds, repeats, seed)
    return named(ranked(rows, columns, weights, at, keys, repeats, k), keys, [m.name for m in models])


def cross_validated_wide(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], plain: Mapping[str, str], folds: int = 5, repeats: int = 4, seed: int = 0, k: int = 10) -> Wide:
    """cross_validated_metrics by dataset and query, and baseline_metrics of the plain columns."""
    groups, inputs = gathered(rows, columns, plain, protocol.fold_hashes("query_id", repeats, seed))
    fold = protocol.fold_columns(groups, "query_id", folds, repeats, seed, [F.col(f"_u{r}") for r in range(repeats)], F.col("_first"))
    own = [f"_cell{r}" for r in range(repeats)]
    groups = groups.withColumns({c: F.when(F.col("query_id").isNotNull(), f - 1) for c, f in zip(own, fold, strict=True)})
    held = cells_of(groups, len(columns), own)
    return wide(groups, inputs, columns, [m.name for m in models], _fold_weights(held, len(columns), models, folds), own, plain, repeats, k)


def _fold_weights(held: Sequence[Mapping[int, Gram]], width: int, models: Sequence[Ridge], folds: int) -> np.ndarray:
    """Weights by model and repeat, of each fold (from 0) held out."""
    whole = [total(own.values()) if own else None for own in held]  # the same rows, summed by repeat as in cross_validated
    none = (np.zeros(width), 0.0)
    return table_of([[m.fit(all_ - own[f]) if f in own else none for f in range(folds)] for m in models for own, all_ in zip(held, whole, strict=True)])


def _fold_models(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], folds: int, repeats: int, seed: int) -> tuple[np.ndarray, list[Column]]:
    """Weights by model and repeat, of each fold held out, and the fold of a row (from 0) in each repeat."""
    fold = protocol.fold_columns(rows, "query_id", folds, repeats, seed)
    each = F.posexplode(F.array(*fold)).alias("repeat", "fold")
    found = cells(by_query(rows, columns).select("*", each), len(columns) + 1, ["repeat", "fold"])
    held = [{f - 1: g for (q, f), g in found.items() if q == r} for r in range(repeats)]
    return _fold_weights(held, len(columns), models, folds), [f - 1 for f in fold]


def cross_validated(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], folds: int = 5, repeats: int = 4, seed: int = 0) -> DataFrame:
    """model, repeat, fold, dataset, query_id, passage_id, y, score: each query by models of the other folds, in each repeat."""
    dealt = protocol.repeated_folds(rows, "query_id", folds, repeats, seed)
    grams = by_query(rows, columns).join(dealt, "query_id")
    held = cells(grams, len(columns) + 1, ["repeat", "fold"])
    fitted = []
    for r in range(repeats):
        own = {k: g for k, g in held.items() if k[0] == r}
        whole = total(own.values()) if own else None
        fitted += [(m.name, r, f, *m.fit(whole - g)) for (_, f), g in own.items() for m in models]
    return scored(rows.join(dealt, "query_id"), columns, fitted, {"model": "string", "repeat": "int", "fold": "int"})


def left_out(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge]) -> DataFrame:
    """model, dataset, query_id, passage_id, y, score: each dataset by models of all others. Datasets are those found."""
    held = cells(by_query(rows, columns), len(columns) + 1, ["dataset"])
    if len(held) < 2:
        raise ValueError("leave-one-dataset-out needs two datasets")
    whole = total(held.values())
    fitted = [(m.name, d, *m.fit(whole - g)) for (d,), g in held.items() for m in models]
    return scored(rows, columns, fitted, {"model": "string", "dataset": rows.schema["dataset"].dataType.simpleString()})


def left_out_metrics(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], k: int = 10) -> DataFrame:
    """model, dataset, query_id, spearman, ndcg and top1 of left_out: rows are never multiplied by models."""
    weights, at = _dataset_models(rows, columns, models)
    keys = ["dataset", "query_id"]
    return named(ranked(rows, columns, weights, at, keys, k=k), keys, [m.name for m in models])


def left_out_wide(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge], plain: Mapping[str, str], k: int = 10) -> Wide:
    """left_out_metrics, and baseline_metrics of the plain columns."""
    groups, inputs = gathered(rows, columns, plain)
    names = [r[0] for r in groups.select("dataset").distinct().collect()]
    groups = groups.withColumn("_cell0", cell_of(names, "dataset") if names else F.lit(0))
    (held,) = cells_of(groups, len(columns), ["_cell0"])
    none = (np.zeros(len(columns)), 0.0)
    fits = _dataset_fits(held, models)
    weights = table_of([[own.get(i, none) for i in range(len(names))] for own in fits])
    return wide(groups, inputs, columns, [m.name for m in models], weights, ["_cell0"], plain, k=k)


def _dataset_fits(held: Mapping, models: Sequence[Ridge]) -> list[dict]:
    """Of each model its weights and intercept by dataset held out."""
    if len(held) < 2:
        raise ValueError("leave-one-dataset-out needs two datasets")
    whole = total(held.values())
    return [{d: m.fit(whole - g) for d, g in held.items()} for m in models]


def _dataset_models(rows: DataFrame, columns: Sequence[str], models: Sequence[Ridge]) -> tuple[np.ndarray, list[Column]]:
    """Weights by model, of each dataset held out, and a row's dataset as a number."""
    held = cells(by_query(rows, columns), len(columns) + 1, ["dataset"])
    fits, names = _dataset_fits(held, models), [d for (d,) in held]
    return table_of([[own[d,] for d in names] for own in fits]), [cell_of(names, "dataset")]


@dataclass
class Nested:
    """What nested selection found: predictions (model `nested`), outer (dataset, model, rho: every configuration on the
    dataset held out), inner (dataset, model, score: inside the others), selected (dataset, model, score)."""

    predictions: DataFrame
    outer: DataFrame
    inner: DataFrame
    selected: DataFrame
    order: DataFrame

    def summary(self) -> DataFrame:
        """dataset, selected, inner (its score inside), spearman (on the dataset), oracle (the best configuration's there)."""
        best = self.outer.groupBy("dataset").agg(F.max("rho").alias("oracle"))
        own = self.selected.join(self.outer, ["dataset", "model"])
        return own.join(best, "dataset").select("dataset", F.col("model").alias("selected"), F.col("score").alias("inner"), F.col("rho").alias("spearman"), "oracle")

    def macro(self) -> DataFrame:
        """One row: nested, oracle and optimism, the gap that choosing on the held-out data itself would have claimed."""
        return self.summary().agg(F.avg("spearman").alias("nested"), F.avg("oracle").alias("oracle"), F.avg(F.col("oracle") - F.col("spearman")).alias("optimism"))

    def frequency(self) -> DataFrame:
        return self.selected.groupBy("model").agg(F.count(F.lit(1)).alias("datasets"))

    def final(self) -> DataFrame:
        """One row, model and score: the configuration for all data, by its mean over the datasets held out."""
        return _best(self.outer.groupBy("model").agg(F.round(F.avg("rho"), 9).alias("score")), self.order, [])


def _best(scores: DataFrame, order: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The highest score of each key, the earlier configuration on ties; a few rows for each."""
    by = F.struct(F.col("score"), (-F.col("_at")).alias("before"), F.col("model"))
    top = scores.join(F.broadcast(order), "model").groupBy(*keys).agg(F.max(by).alias("_b"))
    return top.select(*keys, F.col("_b.model").alias("model"), F.col("_b.score").alias("score"))


def nested(rows: DataFrame, columns: Sequence[str], configs: Sequence[Ridge], others: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> Nested:
    """Nested leave-one-dataset-out: for each dataset the configuration that is best inside the others, where each of them
    is held out in turn; the dataset's own labels are never seen. Ties go to the earlier configuration.

    Ridges for all single datasets and pairs held out come from one scan, and all their scores from another. others:
    configurations that have to be trained for each pair, as (train, test) -> test with prediction; they come last.
    """
    kind = rows.schema["dataset"].dataType.simpleString()
    held = cells(by_query(rows, columns), len(columns) + 1, ["dataset"])
    names = sorted(k[0] for k in held)
    if len(names) < 3:
        raise ValueError("nested selection needs three datasets")
    whole = total(held.values())
    fitted = []
    for h in names:
        for d in names:
            rest = whole - held[h,] if h == d else whole - held[h,] - held[d,]
            fitted += [(c.name, h, d, *c.fit(rest)) for c in configs]
    keys = {"model": "string", "held": kind, "dataset": kind}
    got = scored(rows, columns, fitted, keys)
    for name, model in (others or {}).items():
        for h in names:
            for d in names:
                out = model(rows.where(~F.col("dataset").isin(h, d)), rows.where(F.col("dataset") == d))
                part = out.select(F.lit(name).alias("model"), F.lit(h).cast(kind).alias("held"), "dataset", "query_id", "passage_id", "y", F.col("prediction").cast("double").alias("score"))
                got = got.unionByName(part)
    spark = rows.sparkSession
    every = [*(c.name for c in configs), *(others or {})]
    order = spark.createDataFrame(list(enumerate(every)), "_at int, model string")
    grid = spark.createDataFrame([(m, h, d) for m in every for h in names for d in names], f"model string, held {kind}, dataset {kind}")
    # ridges by one pass over the rows, where got has a row for each of them and each dataset held out
    pairs = [(c, h) for c in configs for h in names]
    fits = {(m, h, d): (w, b) for m, h, d, w, b in fitted}
    lists = ranked(rows, columns, table_of([[fits[c.name, h, d] for d in names] for c, h in pairs]), [cell_of(names, "dataset")], ["dataset", "query_id"])
    each = lists.select("dataset", F.posexplode("spearman").alias("_at", "spearman")).groupBy("_at", "dataset").agg(F.avg("spearman").alias("rho"))
    of = spark.createDataFrame([(i, c.name, h) for i, (c, h) in enumerate(pairs)], f"_at int, model string, held {kind}")
    rho = each.join(F.broadcast(of), "_at").select("model", "held", "dataset", "rho")
    if others:
        trained = got.where(F.col("model").isin(list(others)))
        rho = rho.unionByName(metrics.per_query_scores(trained, ("model", "held", "dataset", "query_id")).groupBy("model", "held", "dataset").agg(F.avg("spearman").alias("rho")))
    rho = grid.join(rho, ["model", "held", "dataset"], "left").withColumn("rho", F.round(F.coalesce("rho", F.lit(0.0)), 9))
    inner = rho.where("held <> dataset").groupBy(F.col("held").alias("dataset"), "model").agg(F.round(F.avg("rho"), 9).alias("score"))
    selected = _best(inner, order, ["dataset"])
    outer = rho.where("held = dataset").select("dataset", "model", "rho")
    chosen = got.where("held = dataset").join(F.broadcast(selected.select("dataset", "model")), ["dataset", "model"], "left_semi")
    return Nested(chosen.drop("held").withColumn("model", F.lit("nested")), outer, inner, selected, order)


def baselines(rows: DataFrame, named: Mapping[str, str], like: DataFrame) -> DataFrame:
    """The columns of `like` for scores that are columns of rows (name: column): no model, so the same in every repeat."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("score")) for n, c in named.items()]))
    out = rows.select("dataset", "query_id", "passage_id", "y", values.alias("_v")).select("*", "_v.model", "_v.score").drop("_v")
    for c in ("repeat", "fold"):
        if c in like.columns:
            out = out.withColumn(c, F.lit(0))
    return out.select(*like.columns)


def baseline_metrics(rows: DataFrame, columns: Mapping[str, str], k: int = 10) -> DataFrame:
    """model, dataset, query_id, spearman, ndcg and top1 of baselines."""
    keys = ["dataset", "query_id"]
    return named(metrics.per_query_lists(rows, keys, list(columns.values()), lambda x: x, k), keys, list(columns))


def report(predictions: DataFrame, reference: str, by: Sequence[str] = (), replicates: int = 2000, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(by, model, metric, mean, lo, hi, n_queries) and (by, other, metric, mean, lo, hi): metrics of each model with
    intervals over queries, and the reference less each other model, paired by query. Repeats are averaged first."""
    keys = [c for c in ("repeat",) if c in predictions.columns]
    per = metrics.per_query_scores(predictions, ("model", "dataset", "query_id", *keys), k)
    per = per.groupBy("model", "dataset", "query_id").agg(*[F.avg(m).alias(m) for m in METRICS])
    names = sorted(r[0] for r in per.select("model").distinct().collect())  # models are few
    own = [F.max(F.when(F.col("model") == n, F.col(m))).alias(f"_v{3 * i + j}") for i, n in enumerate(names) for j, m in enumerate(METRICS)]
    each = Wide(kept(per.groupBy("dataset", "query_id").agg(*own)), names)
    return intervals(each, by, replicates), paired_intervals(each, reference, by, replicates)


def intervals(per: Wide, by: Sequence[str] = (), replicates: int = 2000) -> DataFrame:
    """by, model, metric, mean, lo, hi, n of metrics that were averaged over repeats."""
    pairs = [(n, m) for n in per.names for m in METRICS]
    return _intervals(per.frame, [F.col(per.column(n, m)) for n, m in pairs], pairs, "model", by, replicates)


def paired_intervals(per: Wide, reference: str, by: Sequence[str] = (), replicates: int = 2000) -> DataFrame:
    """by, other, metric, mean, lo, hi, n of the reference less each other name, paired by query."""
    pairs = [(n, m) for n in per.names if n != reference for m in METRICS]
    known = per.frame.where("dataset IS NOT NULL AND query_id IS NOT NULL")
    return _intervals(known, [F.col(per.column(reference, m)) - F.col(per.column(n, m)) for n, m in pairs], pairs, "other", by, replicates)


def _intervals(frame: DataFrame, values: Sequence[Column], pairs: Sequence[tuple[str, str]], role: str, by: Sequence[str], replicates: int) -> DataFrame:
    names = [f"_d{i}" for i in range(len(values))]
    keys = ["dataset", "query_id"]
    got = resampling.bootstrap_cis(frame.select(*keys, *[v.alias(n) for v, n in zip(values, names, strict=True)]), names, keys, by, replicates)
    of = [F.array(*[F.lit(p[i]) for p in pairs])[F.col("_at")] for i in range(2)]
    return got.select(*by, of[0].alias(role), of[1].alias("metric"), "mean", "lo", "hi", "n")
