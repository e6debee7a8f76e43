"""Bootstrap intervals and sign-flip tests of any number of values at thousands of draws, as sums that merge.

Values of a group are dealt out in parts by a hash of what identifies them; a part is a task's worth, and a group of few
values is one part. Nothing is exploded by draws, and no task sees a group.

Bootstrap. How many of a replicate's n draws fall in a part is binomial at each fork of a binary tree over the parts: a
node's draws split between its two halves in proportion to their values. Forks are seeded by group and node, so each
part finds its own numbers by walking down from the root, for all replicates at once; together they are multinomial.
Inside a part draws are uniform. A part gives back the drawn sums of all replicates.

Sign flips. Values are taken by eights. A table holds the sum of each of the 256 signings of an eight, and a random byte
of a flip looks it up: 64 random bits sign eight values in eight flips. A part gives back the sums of all flips.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a part, about.
PART = 1 << 15
#: Rows of sizes that are broadcast, at most.
FEW = 10_000


def _parted(values: DataFrame, keys: Sequence[str], order: Sequence[str], most: int, sizes: DataFrame | None = None) -> DataFrame:
    """values with _h (the hash they are dealt out by), _depth (of the tree over the group's parts), _part and _n. sizes: keys
    and _n, where they are known."""
    sizes = sizes or values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(float(most)))).cast("int"))
    sizes = sizes.withColumn("_depth", depth)
    hashed = values.withColumn("_h", F.xxhash64(*keys, *order))
    return joined(hashed, sizes, keys).withColumn("_part", F.expr("CASE WHEN _depth = 0 THEN 0L ELSE shiftrightunsigned(_h, 64 - _depth) END"))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right by keys, of which null is one like any other. Without keys right is one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    named = right.select([F.col(k).alias(f"_r_{k}") for k in keys] + [c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, reduce(lambda a, b: a & b, same), how).drop(*[f"_r_{k}" for k in keys])


def _paths(parted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each part the values on its side and on the other side of every fork above it, from the root down."""
    parts = parted.groupBy(*keys, "_depth", "_n", "_part").agg(F.count(F.lit(1)).alias("_m"))
    levels = parts.withColumn("_level", F.explode(F.expr("sequence(0, _depth)"))).withColumn("_node", F.expr("shiftrightunsigned(_part, _depth - _level)"))
    nodes = levels.groupBy(*keys, "_level", "_node").agg(F.sum("_m").alias("_size"))
    forks = nodes.groupBy(*keys, "_level", F.expr("shiftrightunsigned(_node, 1)").alias("_above")).agg(F.sum(F.when(F.col("_node") % 2 == 0, F.col("_size")).otherwise(0)).alias("_left"), F.sum(F.when(F.col("_node") % 2 == 1, F.col("_size")).otherwise(0)).alias("_right"))
    steps = joined(levels.where("_level > 0").withColumn("_above", F.expr("shiftrightunsigned(_node, 1)")), forks, [*keys, "_level", "_above"])
    path = F.sort_array(F.collect_list(F.struct("_level", "_node", "_left", "_right"))).alias("_path")
    return joined(parts, steps.groupBy(*keys, "_part").agg(path), [*keys, "_part"]).unionByName(parts.where("_depth = 0").withColumn("_path", F.array().cast("array<struct<_level: int, _node: bigint, _left: bigint, _right: bigint>>")))


def _seed(*parts: object) -> np.random.Generator:
    import hashlib

    return np.random.default_rng(np.frombuffer(hashlib.blake2b(repr(parts).encode(), digest_size=32).digest(), np.uint32))


def draws_of(path: Sequence, n: int, replicates: int, group: object, seed: int) -> np.ndarray:
    """How many of each replicate's n draws fall in the part that the path leads to."""
    held = np.full(replicates, n, np.int64)
    for level, node, left, right in path:
        to_left = _seed("fork", seed, group, int(level), int(node) >> 1).binomial(held, left / (left + right))
        held = held - to_left if int(node) % 2 else to_left
    return held


def drawn_sums(columns: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of the columns over so many uniform draws of their rows, for each replicate."""
    out, counts = np.empty((len(draws), columns.shape[1])), np.empty((8, len(columns)))
    for at in range(0, len(draws), len(counts)):  # a matrix product for some replicates at once
        some = draws[at : at + len(counts)].tolist()
        for row, n in zip(counts, some, strict=False):
            row[:] = np.bincount(rng.integers(0, len(columns), n), minlength=len(columns))
        out[at : at + len(some)] = counts[: len(some)] @ columns
    return out


def bootstrap_sums(values: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), replicates: int = 2000, seed: int = 0, most: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """keys, _rep and a column of sums for each of the columns (not null): every replicate draws as many rows of a group as
    it has, with replacement. order identifies a row of its group. sizes: keys and _n, where they are known."""
    most = most or PART
    parted = _parted(values.select(*dict.fromkeys([*keys, *order, *columns])), keys, order, most, sizes)
    paths = _paths(parted, keys).drop("_depth", "_m")
    fields = values.select(*keys).schema
    sums = [f"_s{i}" for i in range(len(columns))]

    def part(group: tuple, rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        *own, number = group
        name = tuple(map(str, own))
        data = rows.sort_values(["_h", *columns])[list(columns)].to_numpy(float)
        draws = draws_of([(s["_level"], s["_node"], s["_left"], s["_right"]) for s in path["_path"].iloc[0]], int(path["_n"].iloc[0]), replicates, name, seed)
        got = drawn_sums(data, draws, _seed("part", seed, name, int(number)))
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, own, strict=True)}, **{s: [got[:, i]] for i, s in enumerate(sums)}})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{s} array<double>" for s in sums])
    by = [*keys, "_part"]
    paths = paths.select(*[F.col(c).alias(f"_p_{c}") for c in by], "_n", "_path")
    found = parted.select(*dict.fromkeys([*by, "_h", *columns])).groupBy(*by).cogroup(paths.groupBy(*[f"_p_{c}" for c in by])).applyInPandas(part, schema)
    each = found.select(*keys, F.posexplode(F.arrays_zip(*sums)).alias("_rep", "_z"))
    return each.groupBy(*keys, "_rep").agg(*[F.sum(F.col("_z")[s]).alias(c) for s, c in zip(sums, columns, strict=True)])


def bootstrap_ci(values: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), replicates: int = 2000, seed: int = 0, level: float = 0.95, most: int | None = None) -> DataFrame:
    """keys, mean, lo, hi, n: percentile intervals of the mean. Null and NaN values take no part."""
    keys = list(keys)
    fit = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_v", F.col(value).cast("double"))
    whole = fit.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    sums = bootstrap_sums(fit.select(*dict.fromkeys([*keys, *order, "_v"])), ["_v"], order, keys, replicates, seed, most)
    tail = (1 - level) / 2
    ends = sums.groupBy(*keys).agg(F.percentile("_v", F.lit(tail)).alias("_lo"), F.percentile("_v", F.lit(1 - tail)).alias("_hi"))
    return joined(whole, ends, keys).select(*keys, "mean", (F.col("_lo") / F.col("n")).alias("lo"), (F.col("_hi") / F.col("n")).alias("hi"), "n")


def bootstrap_cis(values: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), replicates: int = 2000, seed: int = 0, level: float = 0.95, most: int | None = None) -> DataFrame:
    """keys, _at (a column's place), mean, lo, hi, n: bootstrap_ci of each of the columns. Null and NaN values take no part.

    Columns that no row of a group lacks (rows with none of them aside) are drawn together: a replicate draws rows once, and
    each column sums what it has there. A column that some rows lack is drawn by itself, over the rows that have it.
    """
    keys, spark = list(keys), values.sparkSession
    own = [f"_v{i}" for i in range(len(columns))]
    fit = values.select(*dict.fromkeys([*keys, *order]), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(v) for c, v in zip(columns, own, strict=True)])
    # no filter over all columns: Spark would infer one for every choice among them and what they are made of
    counted = fit.groupBy(*keys).agg(F.count(F.coalesce(*own)).alias("_rows"), F.array(*[F.struct(F.lit(i).alias("_at"), F.avg(v).alias("mean"), F.count(v).alias("n")) for i, v in enumerate(own)]).alias("_c"))
    seen = counted.select(*keys, "_rows", F.explode("_c").alias("_c")).select(*keys, F.when(F.col("_c.n") == F.col("_rows"), -1).otherwise(F.col("_c._at")).alias("_set"), "_c._at", "_c.mean", "_c.n").where("n > 0")
    whole, sizes = False, None
    if len(few := seen.limit(FEW + 1).collect()) <= FEW:  # groups are counted once, and not joined by shuffle
        seen = F.broadcast(spark.createDataFrame(few, seen.schema))
        sizes = F.broadcast(spark.createDataFrame(list({tuple(r[c] for c in (*keys, "_set", "n")) for r in few}), seen.select(*keys, "_set", F.col("n").alias("_n")).schema))
        whole = all(r["_set"] < 0 for r in few) and len(few) == len(own) * len({tuple(r[k] for k in keys) for r in few})
    if whole:
        drawn = fit.where(F.col(own[0]).isNotNull()).withColumn("_set", F.lit(-1))
    else:
        lacking = joined(fit, seen.where("_set >= 0").groupBy(*keys).agg(F.collect_set("_at").alias("_lack")), keys, "left").withColumn("_lack", F.coalesce("_lack", F.array().cast("array<int>")))
        lacks = [F.array_contains("_lack", i) for i in range(len(own))]
        alone = [F.when(lacks[i] & F.col(v).isNotNull(), F.struct(F.lit(i).alias("_set"), *[(F.col(v) if w == v else F.lit(None).cast("double")).alias(w) for w in own])) for i, v in enumerate(own)]
        shared = F.when(reduce(lambda a, b: a | b, [~x & F.col(v).isNotNull() for x, v in zip(lacks, own, strict=True)]), F.struct(F.lit(-1).alias("_set"), *[F.when(~x, F.col(v)).alias(v) for x, v in zip(lacks, own, strict=True)]))
        drawn = lacking.select(*dict.fromkeys([*keys, *order]), F.explode(F.array_compact(F.array(shared, *alone))).alias("_z")).select("*", "_z.*").drop("_z")
    sums = bootstrap_sums(drawn, own, order, [*keys, "_set"], replicates, seed, most, sizes)
    each = sums.select(*keys, "_set", F.posexplode(F.array(*own)).alias("_at", "_s"))
    tail = (1 - level) / 2
    ends = each.groupBy(*keys, "_set", "_at").agg(F.percentile("_s", F.lit(tail)).alias("_lo"), F.percentile("_s", F.lit(1 - tail)).alias("_hi"))
    return joined(ends, seen, [*keys, "_set", "_at"]).select(*keys, "_at", "mean", (F.col("_lo") / F.col("n")).alias("lo"), (F.col("_hi") / F.col("n")).alias("hi"), "n")


def flipped_sums(d: np.ndarray, flips: int, rng: np.random.Generator) -> np.ndarray:
    """Sums of the values under random signs, for each flip."""
    total = np.zeros(flips)
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float) * 2 - 1  # 256 signings of eight
    for i in range(0, len(d), 8):
        eight = np.zeros(8)
        eight[: len(d[i : i + 8])] = d[i : i + 8]
        total += (signs @ eight)[np.frombuffer(rng.bytes(flips), np.uint8)]
    return total


def sign_flip(diffs: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), flips: int = 200_000, seed: int = 0, most: int | None = None) -> DataFrame:
    """keys, n, mean, p: two-sided test of mean 0 by random signs, (hits + 1) / (flips + 1). Null and NaN take no part."""
    keys = list(keys)
    fit = diffs.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_v", F.col(value).cast("double"))
    parted = _parted(fit.select(*dict.fromkeys([*keys, *order, "_v"])), keys, order, most or PART)
    fields = fit.select(*keys).schema

    def part(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *own, depth, number = group
        d = rows.sort_values(["_h", "_v"])["_v"].to_numpy(float)
        got = flipped_sums(d, flips, _seed("flip", seed, tuple(map(str, own)), int(number)))
        hits = None if depth else int((np.abs(got) >= abs(d.sum()) - 1e-12 * np.abs(d).sum()).sum())  # a group of one part
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, own, strict=True)}, "_hits": pd.array([hits], "Int64"), "_s": [got if depth else got[:0]]})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["_hits long", "_s array<double>"])
    by = [*keys, "_depth", "_part"]
    found = parted.select(*dict.fromkeys([*by, "_h", "_v"])).groupBy(*by).applyInPandas(part, schema)
    seen = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.sum("_v").alias("_sum"), F.sum(F.abs("_v")).alias("_scale"))
    # a row of a group of one part has no sums but its hits; of other groups the parts' sums are added for each flip
    flipped = found.select(*keys, "_hits", F.posexplode_outer("_s").alias("_rep", "_s")).groupBy(*keys, "_rep").agg(F.sum("_s").alias("_s"), F.max("_hits").alias("_hits"))
    both = joined(flipped, seen, keys)
    hit = F.abs("_s") >= F.abs("_sum") - F.lit(1e-12) * F.col("_scale")
    return both.groupBy(*keys, "n", "mean").agg(((F.sum(F.coalesce("_hits", hit.cast("long"))) + 1) / F.lit(float(flips + 1))).alias("p"))


def clustered(diffs: DataFrame, unit: str = "query_id", cluster: str = "llm", value: str = "d", replicates: int = 10_000, flips: int = 20_000, seed: int = 0) -> DataFrame:
    """One row: macro (the mean over clusters of their mean difference), lo, hi, p, n_units and n_pairs.

    Units (questions) are what is drawn and flipped: a unit counts in all clusters that have it, with one weight and one
    sign. Clusters are few (models), and their names reach the driver. A cluster without a drawn unit counts in no mean.
    """
    fit = diffs.where(F.col(value).isNotNull() & F.col(unit).isNotNull() & F.col(cluster).isNotNull())
    names = sorted(r[0] for r in fit.select(cluster).distinct().collect())
    sums, counts = [f"_d{i}" for i in range(len(names))], [f"_c{i}" for i in range(len(names))]
    if not names:
        return diffs.sparkSession.createDataFrame([], "macro double, lo double, hi double, p double, n_units long, n_pairs long")
    own = lambda i, x: F.sum(F.when(F.col(cluster) == names[i], x).otherwise(F.lit(0.0)))
    wide = fit.groupBy(unit).agg(*[own(i, F.col(value).cast("double")).alias(c) for i, c in enumerate(sums)], *[own(i, F.lit(1.0)).alias(c) for i, c in enumerate(counts)])
    macro: Column = sum((F.try_divide(F.col(s), F.col(c)) for s, c in zip(sums[1:], counts[1:], strict=True)), F.try_divide(F.col(sums[0]), F.col(counts[0])))
    if len(names) > 1:
        means = F.filter(F.array(*[F.try_divide(F.col(s), F.col(c)) for s, c in zip(sums, counts, strict=True)]), lambda x: x.isNotNull())
        macro = F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)
    drawn = bootstrap_sums(wide, [*sums, *counts], [unit], (), replicates, seed).select(macro.alias("_m"))
    ends = drawn.agg(F.percentile("_m", F.lit(0.025)).alias("lo"), F.percentile("_m", F.lit(0.975)).alias("hi"))
    whole = wide.agg(*[F.sum(c).alias(c) for c in [*sums, *counts]], F.count(F.lit(1)).alias("n_units"))
    pairs = sum((F.col(c) for c in counts[1:]), F.col(counts[0])).cast("long")
    seen = whole.select(macro.alias("macro"), "n_units", pairs.alias("n_pairs"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(counts)])
    share = sum((F.col(s) / F.col(f"_t{i}") for i, s in enumerate(sums)), F.lit(0.0)) / len(names)
    effect = wide.crossJoin(F.broadcast(seen)).select(unit, share.alias("_e"))  # a unit's part of the macro mean
    test = sign_flip(effect, "_e", [unit], (), flips, seed).select("p")
    return seen.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(test)).select("macro", "lo", "hi", "p", "n_units", "n_pairs")
