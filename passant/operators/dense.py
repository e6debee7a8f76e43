"""Dense retrieval in blocks: matrix products of query blocks and passage blocks, each with its own top k.

Vectors are packed where they are read, a block's rows as one matrix of unit length. Query blocks meet passage blocks,
so norms are computed once for each vector, and what is shuffled is k results for each query and passage block at most.
Query blocks are broadcast after they were counted; beyond the bound blocks meet by a product of partitions, without a
shuffle of vectors by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passant.operators import retrieval

#: Rows of a block of queries and of passages; numbers in a block at most; numbers in query blocks that are broadcast.
QUERIES, PASSAGES, BLOCK_VALUES, MOST_VALUES = 512, 4096, 1 << 21, 1 << 23
ID_TYPES = (T.LongType, T.IntegerType, T.StringType)


def blocks(vectors: DataFrame, key: str, vector: str, most_rows: int) -> DataFrame:
    """ids, dim and data (float64 rows of length one, as bytes): vectors of a task and of one length in blocks. A vector
    that is null, zero or holds null or non-finite parts is kept as zeros, whose cosine is 0 with anything."""
    if not isinstance(vectors.schema[key].dataType, ID_TYPES):
        raise ValueError("ids are whole numbers or strings")
    kind = pa.string() if isinstance(vectors.schema[key].dataType, T.StringType) else pa.int64()
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("string" if kind == pa.string() else "long").alias("id"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, parts = held.pop(dim)
            x = np.concatenate(parts)
            x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0) if dim else x
            size = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
            x = x / np.where(size > 0, size, 1)  # squares neither overflow nor vanish
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([dim], pa.int32()), pa.array([(x / np.where(norm > 0, norm, 1)).tobytes()], pa.binary())], ["ids", "dim", "data"])

        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            sizes, ids = np.diff(offsets), batch.column(0)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)].astype(float)
                own = ids.take(pa.array(at)).to_pylist()
                rows_each = max(1, min(most_rows, BLOCK_VALUES // max(1, dim)))
                while len(own):
                    names, parts = held.setdefault(dim, ([], []))
                    room = rows_each - len(names)
                    names += own[:room]
                    parts.append(x[:room])
                    own, x = own[room:], x[room:]
                    if len(names) == rows_each:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(pack, f"ids array<{'string' if kind == pa.string() else 'bigint'}>, dim int, data binary")


def best_of_block(score: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the places of the k best: by score to nine digits, then by smaller id."""
    score = np.round(score, 9)
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        places = [np.flatnonzero(row >= low) for row, low in zip(score, least, strict=True)]
    else:
        places = [np.arange(score.shape[1])] * len(score)
    return [p[np.lexsort((ids[p], -row[p]))[:k]] for p, row in zip(places, score, strict=True)]


def top_k(queries: DataFrame, passages: DataFrame, k: int, query: tuple[str, str] = ("query_id", "q"), passage: tuple[str, str] = ("pid", "d"), other_ids: bool = False, most_values: int | None = None) -> DataFrame:
    """query_id, pid, score (the cosine) and rank (from 0): each query's k best passages by whole vectors, exactly.

    query and passage: names of the id and the vector. Ties after nine digits go to the smaller id. Vectors of different
    length aren't compared; a zero or unusable vector has cosine 0 with those of its length. Rows with a null id take no
    part. other_ids: a query's own id is no candidate. An empty side gives an empty result.
    """
    asked = blocks(queries, *query, QUERIES).select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    values = asked.select(F.coalesce(F.sum(F.octet_length("q_data").cast("long")), F.lit(0)) / 8).first()[0]
    asked = F.broadcast(asked) if values <= (MOST_VALUES if most_values is None else most_values) else asked
    met = blocks(passages, *passage, PASSAGES).join(asked, F.col("dim") == F.col("q_dim")) if values else blocks(passages, *passage, PASSAGES).limit(0).crossJoin(asked)
    kinds = [queries.schema[query[0]].dataType, passages.schema[passage[0]].dataType]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                dim, ids, q_ids = row["dim"].as_py(), row["ids"].values, row["q_ids"].values
                x, q = (np.frombuffer(row[n].as_py()).reshape(-1, dim) if dim else np.zeros((len(v), 0)) for n, v in (("data", ids), ("q_data", q_ids)))
                score = q @ x.T
                names, asking = ids.to_numpy(zero_copy_only=False), q_ids.to_numpy(zero_copy_only=False)
                if other_ids:
                    score[asking[:, None] == names[None, :]] = -2.0
                best = best_of_block(score, names, k)
                if other_ids:
                    best = [b[s[b] > -1.5] for b, s in zip(best, score, strict=True)]
                who = np.repeat(np.arange(len(best)), [len(b) for b in best])
                which = np.concatenate(best) if best else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(who)), ids.take(pa.array(which)), pa.array(score[who, which])], ["query_id", "pid", "score"])

    as_ddl = ["string" if isinstance(t, T.StringType) else "bigint" for t in kinds]
    hits = met.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(product, f"query_id {as_ddl[0]}, pid {as_ddl[1]}, score double")
    ranked = retrieval.top_k(hits, k)
    return ranked.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("pid").cast(kinds[1]).alias("pid"), "score", "rank")
