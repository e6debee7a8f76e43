"""Ridge probes on hidden states of any width, out of fold, from one pass of Gram matrices.

Rows are dealt out by query and come in order of (fold, query), so a query's rows are together and a task holds the matrix
of one fold at a time; what is inside a query is taken about its mean, however many rows it has. A fold's matrix leaves a
task as tiles of columns, which are added up tile by tile. A model is solved where the tiles of its folds come together:
the model of fold f has all folds but f, the last one all of them. Scores are one dot product for each row, less the mean
of its query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passant.operators import protocol

#: Columns of a tile; rows of a query multiplied at once; tasks that hold a matrix, at most.
TILE, ROWS, MOST_TASKS = 512, 1024, 64
#: The model of all training rows.
ALL = 0


def fold_grams(rows: DataFrame, hidden: str, y: str, fold: str, group: str, width: int, tasks: int) -> DataFrame:
    """fold, i, j and data: tiles (j >= i) of X'X of each fold, X being hidden states and target about their query's mean;
    tile (-1, -1) holds the number of rows."""
    size = width + 1
    laid = rows.select(F.col(fold).cast("int").alias("fold"), F.xxhash64(group).alias("_h"), F.col(group).cast("string").alias("_g"), F.col(hidden).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"))
    laid = laid.repartition(tasks, "_h").sortWithinPartitions("fold", "_h", "_g").select("fold", "_g", "_x", "_y")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        gram, sums, rows_seen, own_rows = np.zeros((size, size)), np.zeros(size), 0, 0

        def leave_query() -> None:
            nonlocal sums, own_rows
            if own_rows:
                np.subtract(gram, np.outer(sums, sums / own_rows), out=gram)
            sums, own_rows = np.zeros(size), 0

        def tiles(fold: int) -> Iterator[pa.RecordBatch]:
            cuts = [*range(0, size, TILE), size]
            yield tile(fold, -1, -1, np.array([float(rows_seen)]))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for j, (c, d) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if j >= i:
                        yield tile(fold, i, j, gram[a:b, c:d])

        for batch in batches:
            folds, groups = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.concatenate([flat, batch.column(3).to_numpy()[:, None]], axis=1)
            change = [k for k in range(len(groups)) if k == 0 or groups[k] != groups[k - 1] or folds[k] != folds[k - 1]]
            for a, b in zip(change, [*change[1:], len(groups)], strict=True):
                here = (int(folds[a]), groups[a])
                if here != now:
                    leave_query()
                    if now is not None and here[0] != now[0]:
                        yield from tiles(now[0])
                        gram[:], rows_seen = 0, 0
                    now = here
                for at in range(a, b, ROWS):
                    part = x[at : min(b, at + ROWS)]
                    gram += part.T @ part
                    sums += part.sum(axis=0)
                own_rows, rows_seen = own_rows + b - a, rows_seen + b - a
        if now is not None:
            leave_query()
            yield from tiles(now[0])

    parts = laid.mapInArrow(partial, "fold int, i int, j int, data binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for *key, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                more = np.frombuffer(data)
                if key == now:
                    total = total + more
                    continue
                if now is not None:
                    yield tile(*now, total)
                now, total = key, more
        if now is not None:
            yield tile(*now, total)

    return parts.repartition("fold", "i", "j").sortWithinPartitions("fold", "i", "j").mapInArrow(add, "fold int, i int, j int, data binary")


def tile(fold: int, i: int, j: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())], ["fold", "i", "j", "data"])


def probe_weights(grams: DataFrame, folds: int, width: int, penalty: float) -> DataFrame:
    """model (a fold, or ALL) and w: a ridge on columns scaled by their deviation, with the penalty for each row."""
    size = width + 1
    models = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))
    asked = grams.withColumn("model", F.explode(models)).repartition(folds + 1, "model").sortWithinPartitions("model", "i", "j")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, gram = None, 0.0, np.zeros((size, size))

        def solved() -> pa.RecordBatch:
            full = np.triu(gram) + np.triu(gram, 1).T
            sd = np.sqrt(np.maximum(np.diag(full)[:width] / max(n, 1.0), 0)) + 1e-6
            xx = full[:width, :width] / sd[:, None] / sd
            xx[np.diag_indices(width)] += penalty * max(n, 1.0)
            w = np.linalg.solve(xx, full[:width, width] / sd) / sd
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([w.tolist()], pa.list_(pa.float64()))], ["model", "w"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("model", "i", "j", "data")]
            for model, i, j, data in zip(*columns, strict=True):
                if model != now:
                    if now is not None:
                        yield solved()
                    now, n, gram = model, 0.0, np.zeros((size, size))
                more = np.frombuffer(data)
                if i < 0:
                    n += more[0]
                else:
                    a, c = i * TILE, j * TILE
                    gram[a : a + TILE, c : c + TILE] += more.reshape(min(TILE, size - a), -1)
        if now is not None:
            yield solved()

    return asked.select("model", "i", "j", "data").mapInArrow(solve, "model int, w array<double>")


def with_probe(rows: DataFrame, hidden: str, y: str, train: str, folds: int = 5, group: str = "query_id", penalty: float = 10.0, seed: int = 0) -> DataFrame:
    """rows with fold and probe. Training rows (the boolean column train) get the score of a model of the other folds, in
    which none of their query's rows are; all other rows that of a model of all training rows (fold is null there).

    hidden is an array of one length, y the target. Rows whose hidden state is null or of another length have no probe, and
    take no part; nor do training rows without a target.
    """
    width = rows.where(F.col(hidden).isNotNull()).agg(F.max(F.size(hidden))).first()[0]
    if not width:
        return rows.withColumns({"fold": F.lit(None).cast("int"), "probe": F.lit(None).cast("double")})
    fits = F.coalesce(F.size(hidden) == width, F.lit(False))
    dealt = protocol.group_folds(rows.where(train), group, folds, seed)
    marked = rows.join(dealt.select(F.col(group).alias("_g"), "fold"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    marked = marked.withColumn("fold", F.when(F.col(train), F.col("fold")))
    used = marked.where(F.col("fold").isNotNull() & fits & F.col(y).isNotNull())
    tasks = min(MOST_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    solved = probe_weights(fold_grams(used, hidden, y, "fold", group, width, tasks), folds, width, penalty).collect()  # folds + 1 rows of the hidden width
    weights = {r["model"]: np.array(r["w"]) for r in solved}

    @F.pandas_udf("double")
    def dot(states: pd.Series, model: pd.Series) -> pd.Series:
        out = np.full(len(states), np.nan)
        for m in model.unique():
            if m in weights:
                at = np.flatnonzero((model == m).to_numpy() & np.array([s is not None and len(s) == width for s in states]))
                if len(at):
                    out[at] = np.stack(states.iloc[at].to_numpy()).astype(float) @ weights[m]
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    linear = marked.withColumn("probe", dot(F.col(hidden), F.coalesce("fold", F.lit(ALL))))
    return linear.withColumn("probe", F.col("probe") - F.avg("probe").over(Window.partitionBy(group)))
