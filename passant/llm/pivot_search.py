"""Exact top-k inner products through a pivot-distance index.

The largest inner product becomes the smallest distance when every vector gets one more component that brings all to
the same length R (a query gets 0 there): |q - v|^2 = |q|^2 + R^2 - 2 q.v. Vectors are keyed by their nearest pivot and
their distance to it and dealt out in that order; a stretch of the order is a cell, an annulus around its pivot, and
holds finer annuli. A pivot that is nearest to very many vectors has many cells.

1. Each cell answers first for the queries that lie in it: the k-th best score found there is a floor for a query.
2. A floor is a radius r around the query. By the triangle inequality a vector nearer than r has a distance to a pivot p
   between d(q, p) - r and d(q, p) + r. Queries of a cell form a block, and a block goes to the cells whose annulus meets
   the interval of one of its queries: an equi-join on the pivot with a range, of small rows without vectors.
3. Where a block meets a cell, each query expands over the cell's annuli in the order of its own bounds, its floor rises
   with what it finds, and it stops at the first annulus whose bound is beyond the floor.

Queries never reach the driver. Decisions about ranks are made on whole numbers; bounds have a margin for rounding.
Vectors whose products need not be exact in a double are kept apart: their cells and queries have no bound and are
compared in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passant.llm.common import materialize, shared_dir

#: Pivots; vectors that pivots are chosen from; vectors in a cell and in an annulus of it; queries in a block.
PIVOTS, SAMPLE, CELL, ANNULUS, BLOCK = 64, 2048, 4096, 64, 512
#: Squared lengths below it have sums of products that a double holds exactly.
EXACT = float(1 << 52)
#: The pivot of vectors at or beyond that.
APART = -1
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_CELL = "pivot int, near double, far double, n int, dim int, ids binary, v binary, d binary"
_BLOCK = "n int, dim int, ids binary, v binary, floor binary, d binary"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to dim, as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), dim))
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """vec_id and v, the whole numbers floor(factor * x) as doubles; rows with a null id or a null or non-finite part are
    out. A product beyond the largest double counts as the largest double."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = 1.7976931348623157e308

    def whole(x):
        y = F.lit(float(factor)) * x.cast("double")
        # from 2^52 on doubles are whole
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).when(y > largest, largest).when(y < -largest, -largest).otherwise(y)

    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each next one is farthest from those before."""
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def _lifted(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, square - (x * x).sum(1)))[:, None]], axis=1)


def _reach(floor: np.ndarray, q: np.ndarray, square: float) -> np.ndarray:
    """The distance beyond which no vector scores floor or more, with a margin for rounding; infinite without a floor."""
    own = (q * q).sum(1) + square
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(floor), np.sqrt(np.maximum(0, own - 2 * floor)) + 1e-6 * np.sqrt(own) + 1e-6, np.inf)


class Best:
    """The k best (score, vec_id) of each of n queries so far; scores are exact."""

    def __init__(self, n: int, k: int, floor: np.ndarray, exact: type = np.float64):
        self.n, self.k, self.floor, self.exact = n, k, floor.copy(), exact
        self.held: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, ids, score))
        self.many += len(q)
        if self.many > 100_000 + 4 * self.k * self.n:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Keep k for each query, larger scores and then smaller ids first, and raise its floor to the last of them."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.exact)
        q, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q)) if self.exact is np.float64 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[i])), np.int64)
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        if self.exact is np.float64:
            last = place == self.k - 1
            self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        keep = place < self.k
        self.held, self.many = [(q[keep], ids[keep], score[keep])], int(keep.sum())
        return self.held[0]


def expand(best: Best, q: np.ndarray, q_ids: np.ndarray, q_reach_of, to_pivot: np.ndarray, x: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> int:
    """Let each query expand over a cell's annuli, nearest bound first, until its bound is beyond its floor.

    x is in the order of its distance to the cell's pivot. Gives the number of (query, vector) products made.
    """
    cuts = [*range(0, len(x), ANNULUS), len(x)]
    near, far = distance[cuts[:-1]], distance[[c - 1 for c in cuts[1:]]]
    bound = np.maximum(0, np.maximum(near[None, :] - to_pivot[:, None], to_pivot[:, None] - far[None, :]))
    order, made = np.argsort(bound, axis=1, kind="stable"), 0
    live = np.arange(len(q))
    for step in range(len(near)):
        at = order[live, step]
        going = bound[live, at] <= q_reach_of(best.floor[live], live)
        live, at = live[going], at[going]
        if not len(live):
            break
        for a in np.unique(at):
            who, span = live[at == a], slice(cuts[a], cuts[a + 1])
            score = q[who] @ x[span].T
            made += score.size
            score[q_ids[who][:, None] == ids[span]] = -np.inf
            row, col = np.nonzero((score >= best.floor[who][:, None]) & (score > -np.inf))
            best.add(who[row], ids[span][col], score[row, col])
        best.settle()
    return made


def _apart(best: Best, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """All products in whole numbers of any size."""
    exact = lambda m: np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape)
    wide, every = exact(q), exact(x)
    for i in range(len(q)):
        score = every @ wide[i] if every.shape[1] else np.zeros(len(every), object)
        other = np.flatnonzero(ids != q_ids[i])
        best.add(np.full(len(other), i), ids[other], score[other])


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (vec_id divisible by `every`).

    vectors: vec_id, embedding; other columns are not read. Candidates are all rows but those with the query's own
    vec_id; ties go to the smaller vec_id. A shorter vector counts as padded with zeros, an empty one as all zeros. Of
    rows that repeat a query's vec_id one asks (the smallest vector); as candidates, all of them take part. An empty table
    gives an empty result. Every finite vector takes part; ranks go by exact scores, and a score that a long can't hold
    is given as the long next to it.
    """
    spark = vectors.sparkSession
    base = shared_dir(spark)
    rows = materialize(scaled(vectors, factor).withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), f"{base}/scaled")
    plain = rows.where(F.col("square") < EXACT)
    dim, square = rows.agg(F.max(F.size("v"))).first()[0] or 0, plain.agg(F.max("square")).first()[0] or 0.0
    taken = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()  # SAMPLE vectors at most
    sample = _lifted(_matrix(taken.column("v"), dim), square)
    pivots = _far_apart(sample, PIVOTS) if len(sample) else np.zeros((1, dim + 1))
    cell_size, block_size = CELL, BLOCK

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far_out = batch.column(2).to_numpy() >= EXACT
            x = _matrix(batch.column(1), dim)
            x[far_out] = 0
            d = _distances(_lifted(x, square), pivots)
            nearest = np.where(far_out, APART, d.argmin(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest]), batch.column(0), batch.column(1), batch.column(3)], ["pivot", "distance", "vec_id", "v", "asks"])

    # of rows that repeat a query's vec_id one asks; what asks is laid out beside the candidates
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "square")).alias("one")).select("vec_id", "one.v", "one.square", F.lit(True).alias("asks"))
    marked = rows.select("vec_id", "v", "square", F.lit(False).alias("asks")).unionByName(asking)
    keyed = marked.mapInArrow(key, "pivot int, distance double, vec_id long, v array<double>, asks boolean")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors in order of (pivot, distance) as cells, a row for each; blocks of those that ask beside them."""
        held: pa.Table | None = None
        number = 0

        def cut(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ask = part.column(4).to_numpy()
            pivot, distance, ids, x = part.column(0)[0].as_py(), part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3), dim)
            q, q_ids = x[ask], ids[ask]
            distance, ids, x = distance[~ask], ids[~ask], x[~ask]
            to_pivots = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots) if pivot != APART else np.zeros((len(q), len(pivots)))
            best = Best(len(q), k, np.full(len(q), -np.inf))
            if pivot != APART and len(q):
                expand(best, q, q_ids, lambda f, live: _reach(f, q[live], square), to_pivots[:, pivot], x, ids, distance)
            number += 1
            blocks = [(min(block_size, len(q) - i), dim, *_packed(*(m[i : i + block_size] for m in (q_ids, q, best.floor, to_pivots)))) for i in range(0, len(q), block_size)]
            near, far = (float(distance[0]), float(distance[-1])) if len(x) else (np.inf, -np.inf)
            cell = (pivot, near, far, len(x), dim, *_packed(ids, x, distance))
            kinds = [pa.struct([("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("d", pa.binary())]), pa.list_(pa.struct([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("floor", pa.binary()), ("d", pa.binary())]))]
            as_dict = lambda kind, row: {kind.field(i).name: v for i, v in enumerate(row)}
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([as_dict(kinds[0], cell)], kinds[0]), pa.array([[as_dict(kinds[1].value_type, b) for b in blocks]], kinds[1])], ["number", "cell", "blocks"])

        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            while held.num_rows:
                pivot = held.column(0).to_numpy()
                same = int(np.searchsorted(pivot, pivot[0], "right"))
                if same < cell_size and same == held.num_rows:
                    break  # its pivot may go on
                yield from cut(held.slice(0, min(same, cell_size)))
                held = held.slice(min(same, cell_size))
        if held is not None and held.num_rows:
            yield from cut(held)

    laid = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    numbered = laid.mapInArrow(cells, f"number long, cell struct<{_struct(_CELL)}>, blocks array<struct<{_struct(_BLOCK)}>>")
    index = materialize(numbered.withColumn("cell_id", F.struct(F.spark_partition_id().alias("part"), F.col("number"))).drop("number"), f"{base}/index")
    asked = index.select(F.col("cell_id").alias("home"), F.col("cell.pivot").alias("own"), F.posexplode("blocks").alias("at", "block"))
    asked = asked.select(F.struct("home", "at").alias("block_id"), "own", "block")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pivot, the distances to it that the queries of a block have to look at."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for at, own, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                q, d = np.frombuffer(block["v"]).reshape(block["n"], dim), np.frombuffer(block["d"]).reshape(block["n"], -1)
                reach = _reach(np.frombuffer(block["floor"]), q, square) if own != APART else np.full(block["n"], np.inf)
                for p in [APART, *range(len(pivots))]:
                    every_one = own == APART or p == APART
                    low, high = (-np.inf, np.inf) if every_one else ((d[:, p] - reach).min(), (d[:, p] + reach).max())
                    for column, value in zip(out, (at, p, low, high), strict=True):
                        column.append(value)
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, pa.int32(), pa.float64(), pa.float64()), strict=True)], ["block_id", "pivot", "low", "high"])

    block_id = "block_id struct<home: struct<part: int, number: bigint>, at: int>"
    places = index.select("cell_id", F.col("cell.pivot").alias("pivot"), F.col("cell.near").alias("near"), F.col("cell.far").alias("far"))
    wanted = asked.mapInArrow(intervals, f"{block_id}, pivot int, low double, high double")
    meets = wanted.join(places, "pivot").where("near <= high and far >= low").select("block_id", "cell_id")
    sent = meets.join(asked, "block_id").select("cell_id", F.lit(None).cast(f"struct<{_struct(_CELL)}>").alias("cell"), F.col("own"), "block")
    held_cells = index.select("cell_id", "cell", F.col("cell.pivot").alias("own"), F.lit(None).cast(f"struct<{_struct(_BLOCK)}>").alias("block"))
    # a cell comes before the blocks that were sent to it, which are taken one after the other
    together = held_cells.unionByName(sent).repartition("cell_id").sortWithinPartitions("cell_id", F.col("cell").isNull())
    found = together.select("cell_id", "cell", "own", "block").mapInArrow(_meeting(k, dim, square), "query_id long, vec_id long, score decimal(38,0), exact string")
    # most scores have 38 digits at most; longer ones are compared by sign, number of digits and digits
    sign = F.when(F.col("exact").isNull(), F.lit(None)).otherwise(F.when(F.col("exact").startswith("-"), -1).otherwise(1))
    digits = F.regexp_replace("exact", "^-", "")
    huge = F.coalesce(sign * F.length(digits), F.lit(0))
    text = F.when(sign > 0, digits).otherwise(F.translate(digits, "0123456789", "9876543210"))
    order = Window.partitionBy("query_id").orderBy(F.col("_huge").desc(), F.col("_text").desc(), F.col("score").desc(), "vec_id")
    ranked = found.withColumns({"_huge": huge, "_text": F.coalesce(text, F.lit(""))}).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("_huge") > 0, MOST).when(F.col("_huge") < 0, LEAST).when(F.col("score") > MOST, MOST).when(F.col("score") < LEAST, LEAST).otherwise(F.col("score").cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in ddl.split(", ")))


def _meeting(k: int, dim: int, square: float):
    """A mapInArrow function: the k best that each block of queries finds in the cell that comes before it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: dict = {}
        x = ids = distance = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].is_valid:
                    cell = batch.column(1)[i].as_py()
                    x, ids, distance = np.frombuffer(cell["v"]).reshape(cell["n"], dim), np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["d"])
                    continue
                block, own = batch.column(3)[i].as_py(), batch.column(2)[i].as_py()
                q, q_ids = np.frombuffer(block["v"]).reshape(block["n"], dim), np.frombuffer(block["ids"], np.int64)
                floor = np.frombuffer(block["floor"])
                if own == APART or cell["pivot"] == APART:
                    best = Best(len(q), k, np.full(len(q), -np.inf), object)
                    _apart(best, q, q_ids, x, ids)
                else:
                    best = Best(len(q), k, floor)
                    to_pivot = np.frombuffer(block["d"]).reshape(len(q), -1)[:, cell["pivot"]]
                    expand(best, q, q_ids, lambda f, live, q=q: _reach(f, q[live], square), to_pivot, x, ids, distance)
                whose, which, score = best.settle()
                whole = [int(s) for s in score]
                fits = [abs(s) < 10**38 for s in whole]
                yield pa.RecordBatch.from_arrays([
                    pa.array(q_ids[whose]), pa.array(which),
                    pa.array([s if f else 0 for s, f in zip(whole, fits, strict=True)], pa.decimal128(38, 0)),
                    pa.array([None if f else str(s) for s, f in zip(whole, fits, strict=True)], pa.string()),
                ], ["query_id", "vec_id", "score", "exact"])

    return meet
