"""Splits, folds, pooling and sampling, always as columns keyed by the query, never by row position."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passant.functions.text import uniform
from passant.session import dealt


def hash_split(rows: DataFrame, key: Column, share: float = 0.3, seen: DataFrame | None = None) -> DataFrame:
    """rows with is_test: the key's hash is below the share, and the key isn't among seen (key)."""
    out = rows.withColumn("_k", key).withColumn("is_test", uniform(F.col("_k")) < share)
    if seen is not None:
        marked = seen.select(F.col("key").alias("_k")).distinct().withColumn("_seen", F.lit(True))
        out = out.join(marked, "_k", "left").withColumn("is_test", F.col("is_test") & F.col("_seen").isNull()).drop("_seen")
    return out.drop("_k")


def salted_subset(rows: DataFrame, key: Column, share: float = 0.4, salt: str = "m2", test_share: float = 0.3) -> DataFrame:
    """The test rows and a salted part of the others."""
    return rows.where((uniform(key) < test_share) | (uniform(F.concat(F.lit(salt), key)) < share))


def ranked_by_hash(groups: DataFrame, key: str, seed: int, parts: int = 1024) -> DataFrame:
    """key, pos (from 0) in a seeded hash order of distinct keys, counted by hash range so no task sorts them all."""
    at = uniform(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keyed = groups.select(key).distinct().withColumn("_u", at).withColumn("_b", F.floor(F.col("_u") * parts))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as parts
    order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_u", key)) - 1
    return keyed.join(F.broadcast(before), "_b").select(key, (F.col("_before") + own).alias("pos"), F.col("_total").alias("n_keys"))


def group_folds(rows: DataFrame, key: str = "query_id", folds: int = 5, seed: int = 0) -> DataFrame:
    """key, fold (from 1): every key in one fold, sizes differ by one at most and larger folds come first."""
    size, extra = F.floor(F.col("n_keys") / folds), F.col("n_keys") % folds
    large = extra * (size + 1)
    fold = F.when(F.col("pos") < large, F.floor(F.col("pos") / (size + 1))).otherwise(extra + F.floor(F.try_divide(F.col("pos") - large, size)))
    return ranked_by_hash(rows, key, seed).select(key, (fold + 1).cast("int").alias("fold"))


def repeated_folds(rows: DataFrame, key: str = "query_id", folds: int = 5, repeats: int = 4, seed: int = 0) -> DataFrame:
    parts = [group_folds(rows, key, folds, seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    return reduce(DataFrame.unionByName, parts)


def fold_columns(rows: DataFrame, key: str = "query_id", folds: int = 5, repeats: int = 4, seed: int = 0, u: Sequence[Column] | None = None, once: Column | None = None) -> list[Column]:
    """The fold (from 1) of a row's key in each repeat, the same as repeated_folds deals out, without a join.

    A fold is a range of a seeded hash order, so it is known by its first key. Keys are counted by hash range, and the
    ranges that first keys fall in are ordered; the first keys reach the driver, some for each repeat. Null keys have no fold.
    u: columns that hold fold_hashes; once: what is true of one row of each key. With these no row is hashed or shuffled.
    """
    parts, stored = 1024, u is not None
    u = u or fold_hashes(key, repeats, seed)
    keys = dealt(rows.where(F.col(key).isNotNull()).select(key), key).distinct() if once is None else rows.where(once & F.col(key).isNotNull())
    spots = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.floor(x * parts).cast("int").alias("b")) for r, x in enumerate(u)])).alias("s")
    counts = {(c["r"], c["b"]): c["n"] for c in keys.select(spots).groupBy("s.r", "s.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(c for (r, _), c in counts.items() if r == 0)
    wanted = []  # (repeat, range, place in it from 1) of each fold's first key; folds without a key have none
    for r in range(repeats):
        for at in (j * (n // folds) + min(j, n % folds) for j in range(1, folds)):
            for b in range(parts):
                if at < (c := counts.get((r, b), 0)):
                    wanted.append((r, b, at + 1))
                    break
                at -= c
    if not wanted:
        return [F.when(F.col(key).isNotNull(), 1)] * repeats
    near = [F.floor(x * parts).isin([b for q, b, _ in wanted if q == r]) for r, x in enumerate(u)]
    found = rows.where(reduce(lambda a, b: a | b, near))
    found = found.select(key).distinct() if once is None else found.where(once)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.floor(x * parts).cast("int").alias("b"), x.alias("u"), F.col(key).alias("key")) for r, x in enumerate(u)])).alias("s")
    placed = found.select(each).select("s.*").withColumn("at", F.row_number().over(Window.partitionBy("r", "b").orderBy("u", "key")))
    first = placed.where(reduce(lambda a, b: a | b, [(F.col("r") == r) & (F.col("b") == b) & (F.col("at") == at) for r, b, at in wanted])).collect()
    out = []
    for r, x in enumerate(u):
        own = [(f["u"], f["key"]) for f in first if f["r"] == r]
        reached = _reached(F.col(key), own)
        out.append(reached(x) if stored else F.transform(F.array(x), reached)[0])  # so that the hash is taken once
    return out


def fold_hashes(key: str, repeats: int, seed: int = 0) -> list[Column]:
    """What the folds of each repeat order keys by."""
    return [uniform(F.concat(F.lit(f"{seed + r}:"), F.col(key).cast("string"))) for r in range(repeats)]


def _reached(key: Column, first: Sequence[tuple]) -> Callable[[Column], Column]:
    return lambda u: reduce(lambda a, b: a + b, [((u > at) | ((u == at) & (key >= F.lit(k)))).cast("int") for at, k in first], F.lit(1))


def exact_group_folds(keys: Sequence[str], folds: int = 5, seed: int = 0) -> dict[str, int]:
    """The same with NumPy's permutation of the sorted distinct keys, for reports over keys that the driver holds anyway."""
    unique = np.unique(np.asarray(keys))
    parts = np.array_split(np.random.default_rng(seed).permutation(unique), folds)
    return {str(k): i + 1 for i, part in enumerate(parts) for k in part}


def leave_one_out(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """held_out, dataset, role for every pair of datasets; there must be two at least."""
    names = rows.select(dataset).distinct()
    if names.limit(2).count() < 2:
        raise ValueError("leave-one-dataset-out needs two datasets")
    return F.broadcast(names).crossJoin(names.select(F.col(dataset).alias("held_out"))).select("held_out", dataset, F.when(F.col(dataset) == F.col("held_out"), "test").otherwise("train").alias("role"))


def require_one_label_source(rows: DataFrame, column: str = "label_source") -> str:
    found = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("no label source" if not found else "label definitions must not be mixed")
    return found[0]


def pool(tables: Sequence[DataFrame]) -> DataFrame:
    """One table of all, query ids prefixed by their dataset; label definitions must agree."""
    whole = reduce(DataFrame.unionByName, tables)
    require_one_label_source(whole)
    return whole.withColumn("query_id", F.concat_ws(":", "dataset", F.col("query_id").cast("string")))


def centered(rows: DataFrame, columns: Sequence[str], group: str | None = "query_id") -> DataFrame:
    """columns minus their mean inside the group; without a group, minus the table's mean."""
    if group is None:
        means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        return rows.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    by = Window.partitionBy(group)
    return dealt(rows, group).withColumns({c: F.col(c) - F.avg(c).over(by) for c in columns})


def standard_target(rows: DataFrame, parts: Sequence[str], group: str = "query_id") -> DataFrame:
    """target: the mean over parts of each, centred by query and divided by its standard deviation over the table."""
    inner = centered(rows, parts, group)
    spread = inner.agg(*[F.stddev_pop(c).alias(f"_sd_{c}") for c in parts])
    sums = [F.col(c) / (F.col(f"_sd_{c}") + F.lit(1e-12)) for c in parts]
    return inner.crossJoin(F.broadcast(spread)).withColumn("target", reduce(lambda a, b: a + b, sums) / len(parts)).drop(*[f"_sd_{c}" for c in parts])


def shuffled_within(rows: DataFrame, value: str, order: str, group: str = "query_id", seed: int = 0) -> DataFrame:
    """rows with shuffled: the group's values dealt out anew by a seeded hash, as a control."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    dealt = F.row_number().over(Window.partitionBy(group).orderBy(uniform(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))), order))
    left = rows.withColumn("_p", place)
    right = rows.select(F.col(group), F.col(value).alias("shuffled"), dealt.alias("_p"))
    return left.join(right, [group, "_p"]).drop("_p")


def sample_items(items: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of the key; all of them if there are no more."""
    at = uniform(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return items.withColumn("_u", at).orderBy("_u", key).limit(n).drop("_u")


def first_queries(rows: DataFrame, n: int, order: str, dataset: str = "dataset", query: str = "query_id") -> DataFrame:
    """The rows of each dataset's first n queries, by the smallest order of their rows."""
    first = rows.groupBy(dataset, query).agg(F.min(order).alias("_o"))
    keep = first.withColumn("_r", F.row_number().over(Window.partitionBy(dataset).orderBy("_o", query))).where(F.col("_r") <= n).select(dataset, query)
    return rows.join(keep, [dataset, query], "left_semi")


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("query_id", "passage_id")) -> DataFrame:
    """left joined to right by its keys; every left row must have one partner."""
    out = left.join(right, list(keys))
    if out.count() != left.count():
        raise KeyError("rows without a partner, or with several")
    return out


def not_seen(rows: DataFrame, seen: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def require_finite(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])
    return rows.where(F.assert_true(~bad, F.lit("a feature is not finite")).isNull())
