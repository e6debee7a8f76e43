"""Ranking metrics over scored pairs (query_id, passage_id, y, score); model and dataset may be further keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passant.session import dealt

TINY = 1e-12
METRICS = ("spearman", "ndcg", "top1")


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; null where one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def per_query_scores(scored: DataFrame, keys: Sequence[str] = ("query_id",), k: int = 10, strict: bool = False) -> DataFrame:
    """spearman, ndcg and top1 of each group that can be ranked (two rows, and y not constant).

    A constant prediction has Spearman 0; with strict, such groups are left out. NDCG is over y - min(y), averages the
    gains of tied predictions and discounts by log2; top1 tells whether the first of the best predictions has the best y.
    """
    lists = per_query_lists(scored, keys, ["score"], lambda x: x, k, strict)
    return lists.select(*keys, *[F.col(m)[0].alias(m) for m in METRICS])


def per_query_lists(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], scores: Callable[[list[np.ndarray]], list[np.ndarray]], k: int = 10, strict: bool = False, mean_of: int = 1) -> DataFrame:
    """keys and lists spearman, ndcg and top1 of each group that can be ranked, with a value for each of the scores that a
    function makes of the input columns (as doubles; each mean_of scores that follow one another are averaged).

    Rows are shuffled and sorted once, whatever the number of scores; a task reads groups one after the other, and groups
    of a size are ranked together. A group's rows meet in one task.
    """
    names = [f"_i{i}" for i in range(len(inputs))]
    used = rows.select(*keys, "passage_id", F.col("y").cast("double").alias("_y"), *[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names, strict=True)])
    ordered = dealt(used, *keys).sortWithinPartitions(*keys, "passage_id", "_y").drop("passage_id")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*keys).schema] + [f"{m} array<double>" for m in METRICS]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, list(keys)):
            y, *x = (_doubles(table[c]) for c in ("_y", *names))
            made = scores(x)
            gone = [np.asarray(table[n].is_null()) for n in names]
            null = gone if len(made) == len(gone) else [np.zeros(len(y), bool)] * len(made)
            kept, found = _by_group(starts, y, np.asarray(table["_y"].is_null()), made, null, k, strict, mean_of)
            if len(kept):
                out = table.select(list(keys)).take(pa.array(kept))
                for m, values in zip(METRICS, found, strict=True):
                    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()) if m == "top1" else None)
                    out = out.append_column(m, pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat))
                yield from out.combine_chunks().to_batches()

    return ordered.mapInArrow(groups, ", ".join(fields))


def _by_group(starts: np.ndarray, y: np.ndarray, none: np.ndarray, made: list[np.ndarray], null: list[np.ndarray], k: int, strict: bool, mean_of: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First rows of the groups that can be ranked, and of each metric an array by group and score; scores that follow one
    another are averaged."""
    sizes = np.diff(np.append(starts, len(y)))
    kept, found = [starts[:0]], [[np.empty((0, len(made) // mean_of))] * 3]
    for n in np.unique(sizes[sizes > 1]):
        at = starts[sizes == n]
        step = max(1, (1 << 18) // int(n))
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            own = part[:, None] + np.arange(n)
            usable, base = _targets(y[own], none[own], k)
            if not usable.any():
                continue
            own, base = own[usable], [b[usable] for b in base]
            got = [_ranked(s[own], z[own], base, k) for s, z in zip(made, null, strict=True)]
            fits = np.all([g[3] for g in got], axis=0) if strict else np.ones(len(own), bool)
            kept.append(own[fits, 0])
            found.append([np.array([g[m][fits] for g in got]).T.reshape(int(fits.sum()), len(got) // mean_of, mean_of).mean(2) for m in range(3)])
    return np.concatenate(kept), [np.concatenate([f[m] for f in found]) for m in range(3)]


@dataclass(frozen=True)
class Scores:
    """Names of scores, which a function makes of input columns and of the group's cells (each mean_of that follow one another
    are averaged) for the rows that have a number in all inputs. Without a function they are the inputs, which may be null."""

    names: Sequence[str]
    inputs: Sequence[str]
    made: Callable[[list[np.ndarray]], list[np.ndarray]] | None = None
    cells: Sequence[str] = ()
    mean_of: int = 1


def gathered(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """keys, of which the last is the query, _first (true of one row of each query), and lists of y and of the inputs as
    doubles, _y and _i0, _i1, ..., by passage: a row for each group, from one shuffle and one sort."""
    *more, query = keys
    lists = ["_y", *[f"_i{i}" for i in range(len(inputs))]]
    used = rows.select(*keys, "passage_id", *[F.col(c).cast("double").alias(n) for c, n in zip(["y", *inputs], lists, strict=True)])
    ordered = dealt(used, query).sortWithinPartitions(query, *more, "passage_id", "_y").drop("passage_id")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*keys).schema] + ["_first boolean"] + [f"{c} array<double>" for c in lists]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for table, starts in _whole_groups(batches, list(keys)):
            out = table.select(list(keys)).take(pa.array(starts))
            first = np.zeros(len(starts), bool)
            first[_starts(out, [query])] = True
            first[0] = (out[query][0].as_py(),) != last
            last = (out[query][-1].as_py(),)
            out = out.append_column("_first", pa.array(first))
            ends = pa.array(np.append(starts, table.num_rows).astype(np.int32))
            for c in lists:
                out = out.append_column(c, pa.ListArray.from_arrays(ends, pa.concat_arrays(table[c].chunks)))
            yield from out.combine_chunks().to_batches()

    return ordered.mapInArrow(groups, ", ".join(fields))


def rows_of(batch: pa.RecordBatch, lists: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of rows of gathered the group's number of each row inside, and the lists' values (0 for null) and which are null."""
    lengths = batch[lists[0]].value_lengths().to_numpy(zero_copy_only=False)
    flat = [batch[c].flatten() for c in lists]
    return np.repeat(np.arange(len(lengths)), lengths), [_doubles(x.fill_null(0.0)) for x in flat], [x.is_null().to_numpy(zero_copy_only=False) for x in flat]


def per_query_wide(groups: DataFrame, keys: Sequence[str], inputs: Sequence[str], families: Sequence[Scores], k: int = 10) -> DataFrame:
    """keys and _v0, _v1, ...: spearman, ndcg and top1 of the families' scores, one after the other, of each row of gathered
    that can be ranked by the rows of a family; null where it can't."""
    lists = ["_y", *[f"_i{i}" for i in range(len(inputs))]]
    width, cells = 3 * sum(len(f.names) for f in families), list(dict.fromkeys(c for f in families for c in f.cells))
    used = groups.select(*keys, *lists, *cells)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*keys).schema] + [f"_v{i} double" for i in range(width)]
    families = list(families)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, (y, *x), (none, *gone) = rows_of(batch, lists)
            values, first = np.full((width, batch.num_rows), np.nan), 0
            seen = np.zeros((width, batch.num_rows), bool)
            for f in families:
                own, of = [inputs.index(c) for c in f.inputs], [batch[c].fill_null(0).to_numpy()[group] for c in f.cells]
                if f.made:  # rows with a number in all inputs and y, of groups with a cell
                    fits = np.all([~gone[i] & ~np.isnan(x[i]) for i in own] + [~none & ~np.isnan(y)], axis=0)
                    at = np.flatnonzero(fits & np.all([~batch[c].is_null().to_numpy(zero_copy_only=False) for c in f.cells], axis=0)[group])
                    scores = f.made([x[i][at] for i in own] + [c[at] for c in of])
                    null = [np.zeros(len(at), bool)] * len(scores)
                else:
                    at, scores, null = np.arange(len(y)), [x[i] for i in own], [gone[i] for i in own]
                begins = np.flatnonzero(np.diff(group[at], prepend=-1))
                kept, found = _by_group(begins, y[at], none[at], scores, null, k, False, f.mean_of)
                to = group[at[kept]]
                for m in range(3):
                    for i in range(len(f.names)):
                        values[first + 3 * i + m, to] = found[m][:, i]
                        seen[first + 3 * i + m, to] = ~np.isnan(found[m][:, i]) if METRICS[m] == "top1" else True
                first += 3 * len(f.names)
            some = np.flatnonzero(seen.any(0))
            out = pa.Table.from_batches([batch.select(list(keys))]).take(pa.array(some))
            for i in range(width):
                out = out.append_column(f"_v{i}", pa.array(values[i, some], mask=~seen[i, some]))
            yield from out.combine_chunks().to_batches()

    return used.mapInArrow(ranks, ", ".join(fields))


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(0.0).to_numpy() + 0.0  # no negative zero


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of most rows or one group's, and where their groups start."""
    held, n, asked = [], 0, most
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= asked:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            if (end := int(starts[-1])) > 0:
                yield table.slice(0, end), starts[:-1]
            held, n = table.slice(end).to_batches(), n - end
            asked = most if n < most // 2 else 2 * n  # a large group is looked through again only when it has doubled
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _codes(x: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Integers in Spark's order of doubles: null, numbers, NaN."""
    bits = x.view(np.int64)
    codes = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    codes[np.isnan(x)] = np.iinfo(np.int64).max
    codes[null] = np.iinfo(np.int64).min
    return codes


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of each row's values, highest first, and first and last place of the ties at each place."""
    order = np.argsort(~codes, axis=1, kind="stable")
    by = np.take_along_axis(codes, order, 1)
    places = np.broadcast_to(np.arange(codes.shape[1]), codes.shape)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = by[:, 1:] != by[:, :-1]
    first = np.maximum.accumulate(np.where(new, places, 0), axis=1)
    ends = np.ones(codes.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, places, codes.shape[1])[:, ::-1], axis=1)[:, ::-1]
    return order, first, last


def _discounts(n: int, k: int) -> np.ndarray:
    at = np.arange(1, n + 1)
    return np.where(at <= k, 1 / np.log2(at + 1.0), 0.0)


def _targets(y: np.ndarray, none: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which groups of one size can be ranked, and what all scores share: gains, nulls, ranks about their mean, ideal gain,
    which rows have the best y."""
    n = y.shape[1]
    codes = _codes(y, none)
    order, first, last = _runs(codes)
    ranks = np.empty(y.shape)
    np.put_along_axis(ranks, order, (n - 1) / 2 - (first + last) / 2, 1)
    with np.errstate(all="ignore"):
        gain = np.where(none, 0.0, y - np.fmin.reduce(np.where(none, np.nan, y), axis=1)[:, None])
        held = (~none).sum(1)
        mean = gain.sum(1) / held
        sd = np.sqrt(np.where(none, 0.0, (gain - mean[:, None]) ** 2).sum(1) / held)
        ideal = np.take_along_axis(gain, order, 1) @ _discounts(n, k)
    best = np.where(none, np.nan, codes == codes.max(1)[:, None])
    return (held > 0) & ~(sd < TINY), [gain, none, ranks, ideal, best]  # NaN is above all numbers


def _ranked(score: np.ndarray, null: np.ndarray, base: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """spearman, ndcg, top1 and whether the score varies, for groups of one size."""
    gain, none, ranks, ideal, best = base
    n = score.shape[1]
    order, first, last = _runs(_codes(score, null))
    mine, theirs = (n - 1) / 2 - (first + last) / 2, np.take_along_axis(ranks, order, 1)
    with np.errstate(all="ignore"):
        scale = np.sqrt((mine * mine).sum(1)) * np.sqrt((ranks * ranks).sum(1))
        spearman = np.where(scale > 0, (mine * theirs).sum(1) / scale, 0.0)
        upto = np.append(0.0, np.cumsum(_discounts(n, k)))
        tied = last - first + 1
        if none.any():
            seen = np.pad(np.cumsum(~np.take_along_axis(none, order, 1), axis=1), ((0, 0), (1, 0)))
            tied = np.maximum(np.take_along_axis(seen, last + 1, 1) - np.take_along_axis(seen, first, 1), 1)
        dcg = (np.take_along_axis(gain, order, 1) * ((upto[last + 1] - upto[first]) / tied)).sum(1)
        ndcg = np.where(ideal <= 0, 0.0, dcg / ideal)
        low = np.fmin.reduce(np.where(null, np.nan, score), axis=1)[:, None]
        off, held = np.where(null, 0.0, score - low), (~null).sum(1)
        sd = np.sqrt(np.where(null, 0.0, (off - (off.sum(1) / held)[:, None]) ** 2).sum(1) / held)
    return spearman, ndcg, np.take_along_axis(best, order[:, :1], 1)[:, 0], (held > 0) & ~(sd < TINY)


def ranking_summary(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row: the means over queries, global Spearman, and how many queries could be ranked."""
    per = per_query_scores(scored, k=k).agg(F.avg("spearman").alias("spearman"), F.avg("ndcg").alias("ndcg"), F.avg("top1").alias("top1"), F.count(F.lit(1)).alias("n_queries"))
    return per.crossJoin(F.broadcast(global_spearman(scored)))  # two single rows


def global_ranks(rows: DataFrame, value: str) -> DataFrame:
    """value and its average rank over the whole table: counts by value, summed in range order, not one sorted task of rows.

    The table of distinct values is cut in ranges; each range starts after the rows of those before it.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    span = counts.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    bucket = F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * 1023)
    ranged = counts.crossJoin(F.broadcast(span)).withColumn("_b", bucket).drop("_lo", "_hi")
    totals = ranged.groupBy("_b").agg(F.sum("_n").alias("_t"))  # 1 024 rows at most
    before = totals.withColumn("_before", F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_b").select(value, (F.col("_before") + inside + (F.col("_n") + 1) / 2.0).alias(f"{value}_rank"))


def global_spearman(scored: DataFrame) -> DataFrame:
    """One row, rho; 0 where undefined."""
    rows = scored.select("y", "score")
    ranked = rows.join(global_ranks(rows, "y"), "y").join(global_ranks(rows, "score"), "score")
    return ranked.agg(F.coalesce(safe_corr("y_rank", "score_rank"), F.lit(0.0)).alias("rho"))


def global_ndcg(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row, ndcg over the whole table: only the k best of either order are looked at, and ties at the border by count."""
    low = scored.agg(F.min("y").alias("_low"))
    tied = scored.groupBy("score").agg(F.avg("y").alias("_g"), F.count(F.lit(1)).alias("_n")).orderBy(F.col("score").desc()).limit(k)  # k scores cover k places
    before = F.coalesce(F.sum("_n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = tied.withColumn("_at", before).select("_g", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k)).cast("int"))).alias("_j"), "_at")
    dcg = places.where(F.col("_at") + F.col("_j") <= k).crossJoin(F.broadcast(low)).agg(F.sum((F.col("_g") - F.col("_low")) / F.log2(F.col("_at") + F.col("_j") + F.lit(1.0))).alias("_dcg"))
    best = scored.select("y").orderBy(F.col("y").desc()).limit(k).withColumn("_i", F.row_number().over(Window.orderBy(F.col("y").desc())))
    idcg = best.crossJoin(F.broadcast(low)).agg(F.sum((F.col("y") - F.col("_low")) / F.log2(F.col("_i") + F.lit(1.0))).alias("_idcg"))
    return dcg.crossJoin(idcg).select(F.coalesce(F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")), F.lit(0.0)).alias("ndcg"))


def mrr(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Mean reciprocal of positive ranks from 1; 0 for none."""
    return ranks.where(F.col(rank) > 0).agg(F.coalesce(F.avg(F.lit(1.0) / F.col(rank)), F.lit(0.0)).alias("mrr"))


def macro_average(per_query: DataFrame, metrics: Sequence[str] = ("spearman", "ndcg", "top1"), keys: Sequence[str] = ()) -> DataFrame:
    """The mean over datasets of each dataset's mean over queries."""
    by_dataset = per_query.groupBy(*keys, "dataset").agg(*[F.avg(m).alias(m) for m in metrics])
    out = [F.avg(m).alias(m) for m in metrics] + [F.count(F.lit(1)).alias("n_datasets")]
    return by_dataset.groupBy(*keys).agg(*out) if keys else by_dataset.agg(*out)


def dataset_statistics(pairs: DataFrame) -> DataFrame:
    """Of each dataset (dataset, query_id, y): queries, pairs, pairs a query, mean, shares non-zero and positive, rankable."""
    queries = pairs.groupBy("dataset", "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum((F.col("y") != 0).cast("long")).alias("z"), F.sum((F.col("y") > 0).cast("long")).alias("p"), F.stddev_pop("y").alias("sd"))
    n = F.sum("n")
    return queries.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_queries"), n.alias("n_pairs"), (n / F.count(F.lit(1))).alias("pairs_per_query"), (F.sum("s") / n).alias("mean_y"),
        (F.sum("z") / n).alias("share_nonzero"), (F.sum("p") / n).alias("share_positive"), F.sum(((F.col("n") >= 2) & (F.col("sd") >= TINY)).cast("long")).alias("n_rankable"),
    )


def constant_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, is_constant for each column."""
    wide = rows.agg(*[(F.max(c) - F.min(c) == 0).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "is_constant")
