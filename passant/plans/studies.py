"""Studies composed of the operators: variants of the predictor, development, the final look, transfer and fresh questions.

Rows carry dataset, query_id, passage_id, y and feature columns; predictions are long, with a model column. Grids and
dataset names are short lists of the driver's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.operators import metrics, models, probes, protocol, resampling, stats
from passant.schemas import FEATURES, GROUPS

#: Model settings of the larger study: trees, depth and learning rate.
TREES = {"gbr(100,d2)": (100, 2, 0.05), "gbr(300,d3)": (300, 3, 0.05), "gbr(500,d4)": (500, 4, 0.03)}
#: Feature columns that each cost tier can afford.
TIERS = {
    "full": FEATURES,
    "no-generation": tuple(c for c in FEATURES if c not in (*GROUPS["d3"][1:], *GROUPS["d4"])),
    "no-lm": tuple(c for g in ("d1", "d2", "d3") for c in GROUPS[g] if c != "answerability"),
}


@dataclass(frozen=True)
class Variant:
    model: str
    target: str = "u"
    cross_encoder: bool = False
    probe: bool = False

    @property
    def name(self) -> str:
        return "|".join([self.model, self.target, *(["ce"] if self.cross_encoder else []), *(["probe"] if self.probe else [])])

    def columns(self, base: Sequence[str]) -> tuple[str, ...]:
        return (*base, *(["ce"] if self.cross_encoder else []), *(["probe"] if self.probe else []))


def variants(targets: Sequence[str] = ("u", "soft", "mix")) -> list[Variant]:
    return [Variant(m, t, c, p) for m in TREES for t in targets for c in (False, True) for p in (False, True)]


def with_target(rows: DataFrame, kind: str) -> DataFrame:
    """rows with target: the utility as it is, or the standardised soft label, or the mean of both standardised."""
    return rows.withColumn("target", F.col("y")) if kind == "u" else protocol.standard_target(rows, ("soft",) if kind == "soft" else ("y", "soft"))


def out_of_fold_probe(train: DataFrame, test: DataFrame, hidden: str = "hidden", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both tables with probe: of the training rows by probes of the other folds, of the test rows by one of all training
    rows; all models come from one pass."""
    both = train.withColumn("_t", F.lit(True)).unionByName(test.withColumn("_t", F.lit(False)), allowMissingColumns=True)
    got = probes.with_probe(both, hidden, "target", "_t", folds).drop("fold")
    return got.where("_t").drop("_t").select(*train.columns, "probe"), got.where("not _t").drop("_t").select(*test.columns, "probe")


def fit_variant(train: DataFrame, test: DataFrame, variant: Variant, base: Sequence[str] = FEATURES, algorithm: str | None = None) -> DataFrame:
    """model, dataset, query_id, passage_id, y, score of the test rows; always centred by query."""
    train = with_target(train, variant.target)
    if variant.probe:
        train, test = out_of_fold_probe(train, test)
    trees, depth, rate = TREES.get(variant.model, (100, 2, 0.05))
    model = models.Predictor(variant.columns(base), algorithm or "gbr", True, {"n_estimators": trees, "max_depth": depth, "learning_rate": rate, "alpha": 100.0})
    got = model.fit(train, "target", "query_id").predict(test, "query_id")
    return got.select(F.lit(variant.name).alias("model"), "dataset", "query_id", "passage_id", "y", F.col("prediction").alias("score"))


def development(rows: DataFrame, datasets: Sequence[str], choices: Sequence[Variant], base: Sequence[str] = FEATURES, algorithm: str | None = None) -> DataFrame:
    """model, spearman, ndcg, top1 by leave-one-dataset-out: the macro over datasets."""
    parts = [fit_variant(rows.where(F.col("dataset") != d), rows.where(F.col("dataset") == d), v, base, algorithm) for v in choices for d in datasets]
    per = metrics.per_query_scores(reduce(DataFrame.unionByName, parts), ("model", "dataset", "query_id"))
    return metrics.macro_average(per, keys=("model",))


def final(rows: DataFrame, key: Column, variant: Variant, seen: DataFrame | None = None, base: Sequence[str] = FEATURES, algorithm: str | None = None) -> DataFrame:
    """Predictions for the hash split's test questions of a model of all others."""
    marked = protocol.hash_split(rows, key, 0.3, seen)
    return fit_variant(marked.where("not is_test"), marked.where("is_test"), variant, base, algorithm)


def compare(predictions: DataFrame, reference: str, least_queries: int = 2, flips: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(model, macro spearman, query means of ndcg and top1, n_queries) and (other, dataset, n, mean, p, p_holm): the
    reference against each other model, Holm-corrected over datasets. Datasets with few usable queries are left out."""
    per = metrics.per_query_scores(predictions, ("model", "dataset", "query_id"))
    counts = per.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("_n"))
    per = per.join(counts.where(F.col("_n") >= least_queries), ["model", "dataset"]).drop("_n")
    macro = metrics.macro_average(per, ("spearman",), ("model",))
    means = per.groupBy("model").agg(F.avg("ndcg").alias("ndcg"), F.avg("top1").alias("top1"), F.count(F.lit(1)).alias("n_queries"))
    diffs = stats.paired_difference(per, reference, keys=("dataset", "query_id"))
    tests = resampling.sign_flip(diffs, "d", ["query_id"], ["other", "dataset"], flips)
    return macro.join(means, "model"), stats.holm(tests, "p", "dataset", ["other"])


def cost_tiers(rows: DataFrame, key: Column, variant: Variant, tiers: dict[str, Sequence[str]] | None = None, algorithm: str | None = None) -> DataFrame:
    """Predictions of the same variant on each tier's columns."""
    parts = [final(rows, key, variant, base=cols, algorithm=algorithm).withColumn("model", F.lit(name)) for name, cols in (tiers or TIERS).items()]
    return reduce(DataFrame.unionByName, parts)


def transfer_matrix(tables: dict[str, DataFrame], key: Column, variant: Variant, base: Sequence[str] = FEATURES, algorithm: str | None = None) -> DataFrame:
    """source, target, spearman: a model of each source's training questions on each target's test questions."""
    parts = []
    for source, left in tables.items():
        train = protocol.hash_split(left, key, 0.3).where("not is_test")
        for target, right in tables.items():
            test = protocol.hash_split(right, key, 0.3).where("is_test")
            parts.append(fit_variant(train, test, variant, base, algorithm).withColumns({"source": F.lit(source), "target": F.lit(target)}))
    per = metrics.per_query_scores(reduce(DataFrame.unionByName, parts), ("source", "target", "dataset", "query_id"))
    return metrics.macro_average(per, ("spearman",), ("source", "target"))


def swapped(rows: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with columns of the same pairs read by another model; a pair without a partner is an error."""
    right = other.select("query_id", "passage_id", *columns)
    return protocol.aligned(rows.drop(*columns), right)


def fresh_questions(train: DataFrame, fresh: DataFrame, config: models.Config, columns: Sequence[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(model, spearman, ndcg, top1 over questions that training hasn't seen) and (dataset, dropped)."""
    new = protocol.not_seen(fresh, train, ("dataset", "query_id"))
    dropped = fresh.select("dataset", "query_id").distinct().join(train.select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("dropped"))
    got = models.fit_predict(config, columns)(train, new).select(F.lit(config.name).alias("model"), "dataset", "query_id", "passage_id", "y", F.col("prediction").alias("score"))
    per = metrics.per_query_scores(got, ("model", "dataset", "query_id"))
    return metrics.macro_average(per, keys=("model",)), dropped


def train(rows: DataFrame, config: models.Config, columns: Sequence[str], by_query: bool = True) -> tuple[models.Predictor, DataFrame]:
    """A predictor fitted outside the first of five folds (or a fifth of the rows by hash), and its summary on that part."""
    if by_query:
        marked = rows.join(protocol.group_folds(rows, "query_id", 5), "query_id").withColumn("_hold", F.col("fold") == 1)
    else:
        marked = rows.withColumn("_hold", F.pmod(F.xxhash64("query_id", "passage_id"), F.lit(5)) == 0)
    model = config.predictor(columns).fit(marked.where("not _hold"), "y", "query_id")
    held = model.predict(marked.where("_hold"), "query_id" if model.center_by_query else None).withColumn("score", F.col("prediction"))
    return model, metrics.ranking_summary(held)


def answer_summary(rows: DataFrame, reference: str = "dense") -> tuple[DataFrame, DataFrame]:
    """rows (model, m, dataset, query_id, acc): (model, m, macro accuracy) and (m, other, n, mean, p) against the reference."""
    macro = rows.groupBy("model", "m", "dataset").agg(F.avg("acc").alias("acc")).groupBy("model", "m").agg(F.avg("acc").alias("acc"), F.count(F.lit(1)).alias("n_datasets"))
    diffs = stats.paired_difference(rows, reference, "acc", keys=("m", "dataset", "query_id"))
    return macro, resampling.sign_flip(diffs, "d", ["dataset", "query_id"], ["m", "other"])


def masked(rows: DataFrame, keep: str = "d5") -> DataFrame:
    """rows where all feature columns but one group's are zero."""
    return rows.withColumns({c: F.lit(0.0) for g, cols in GROUPS.items() if g != keep for c in cols})


def constant_baselines(rows: DataFrame) -> DataFrame:
    """model, query_id, passage_id, y, score of predictors that say nothing."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(n).alias("model"), "query_id", "passage_id", "y", F.lit(v).alias("score")) for n, v in (("no_retrieval", 0.0), ("full_unranked", 1.0))])
