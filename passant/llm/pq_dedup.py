"""Near-duplicate vectors through product quantisation over coarse inverted lists; no link is lost.

Vectors of equal labels link where their cosine is `least` or more, that is where their unit vectors are no farther
apart than r = sqrt(2 - 2 least). Equal vectors are one entry with a count, so copies never meet each other.

* Lists. A coarse quantiser (k-means on a bounded sample) gives every entry the cell of its nearest centroid; a list is a
  label and a cell, cut into blocks. Its residual to the centroid is stored as subspace codes, with the exact length of
  what the codes leave out.
* Sufficient probes. Let h be an entry's distance to the hyperplane halfway between its own centroid and another one.
  Two entries of different cells A and B lie on different sides of the hyperplane between A and B, so they are at least
  h(u) + h(v) apart. If they link, the smaller h is r / 2 at most. So each entry asks its own cell and the cells with
  h <= r / 2, and one of the two finds the other; a pair counts where the one with the smaller (h, key) asks.
* Distances. Where queries meet a block, a table of a query's squared distances to the codewords of each subspace gives
  its distance to every decoded entry by look-ups. Less what the entry's codes leave out, it is a lower bound (triangle
  inequality), so nothing within r is passed over.
* Rerank. Cosines of what is left are computed in double precision from the vectors themselves.

A task gives back, for each entry with links, how many vectors it found there and an entry of the same component, not
pairs. Blocks that many ask are copied to several tasks. Components come from alternating stars.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import materialize, shared_dir
from passant.llm.simhash import components, connected

#: Entries of the largest label for each cell; the most cells; numbers in the sample that quantisers are fitted on, and its rows.
CELL, MOST_CELLS, SAMPLE_VALUES, SAMPLE = 512, 4096, 1 << 22, 1 << 16
#: Subspaces and codewords of each; entries of a block; queries compared at once; queries' blocks that one task takes.
SUBSPACES, CODEWORDS, BLOCK, CHUNK, MOST_ASKS = 8, 256, 1024, 128, 64
SLACK = 1e-9
_PACKED = "n int, keys binary, copies binary, v binary"


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Up to k different centroids."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squares(part, centres).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        held = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    return centres


def _apart(centres: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """centres without those that are all but equal to one before."""
    keep: list[int] = []
    for i in range(len(centres)):
        if not keep or np.sqrt(_squares(centres[i : i + 1], centres[keep])).min() > least:
            keep.append(i)
    return centres[keep]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest part first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _height(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of each row to the hyperplane between its own and another centroid: the same bits wherever it is asked."""
    far = ((x - other) ** 2).sum(axis=1) - ((x - own) ** 2).sum(axis=1)
    return far / (2 * np.sqrt(((own - other) ** 2).sum(axis=-1)))


class Quantiser:
    """Coarse centroids and, for the residuals, codewords of each subspace."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim = sample.shape[1]
        self.centres = _apart(_kmeans(sample, cells, 8)) if len(sample) else np.zeros((1, self.dim))
        m = max(1, min(SUBSPACES, self.dim))
        self.edges = [self.dim * i // m for i in range(m + 1)]
        residual = sample - self.centres[_squares(sample, self.centres).argmin(axis=1)] if len(sample) else np.zeros((1, self.dim))
        self.words = [_kmeans(np.ascontiguousarray(residual[:, a:b]), CODEWORDS, 6) for a, b in self.spans()]
        gap = np.sqrt(_squares(self.centres, self.centres))
        self.gap = np.where(gap > 0, gap, np.inf)

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.edges, self.edges[1:], strict=False))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and the length of what the codes leave out of each row."""
        cell = _squares(x, self.centres).argmin(axis=1)
        residual = x - self.centres[cell]
        codes = np.stack([_squares(residual[:, a:b], w).argmin(axis=1) for (a, b), w in zip(self.spans(), self.words, strict=True)], axis=1).astype(np.uint8)
        decoded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return cell, codes, np.sqrt(((residual - decoded) ** 2).sum(axis=1))

    def heights(self, x: np.ndarray, cell: int) -> np.ndarray:
        """Distance of each row of a cell to the hyperplanes of all others; its own has 0."""
        square = _squares(x, self.centres)
        return (square - square[:, cell : cell + 1]) / (2 * self.gap[cell])

    def look_up(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to decoded entries of a cell: one table of a query for each subspace."""
        residual, total = q - self.centres[cell], 0.0
        for i, ((a, b), w) in enumerate(zip(self.spans(), self.words, strict=True)):
            total = total + _squares(residual[:, a:b], w)[:, codes[:, i]]
        return np.sqrt(total)


def _pairs(quantiser: Quantiser, reach: float, least: float, ask: dict, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, entry) of the pairs that count here. ask and block: cell, keys, v, and x (unit rows); block also
    codes and left (what they leave out)."""
    same, alike = ask["cell"] == block["cell"], ask["id"] == block["id"]
    firsts, seconds = [], []
    for at in range(0, len(ask["x"]), CHUNK):
        near = quantiser.look_up(ask["x"][at : at + CHUNK], block["cell"], block["codes"]) - block["left"] <= reach
        i, j = np.nonzero(near)
        i += at
        if alike:
            i, j = i[i < j], j[i < j]
        cosine = np.einsum("ij,ij->i", ask["x"][i], block["x"][j])
        i, j = i[cosine >= least], j[cosine >= least]
        if not same and len(i):
            own, other = quantiser.centres[ask["cell"]], quantiser.centres[block["cell"]]
            hi, hj = _height(ask["x"][i], own, other), _height(block["x"][j], other, own)
            first = (hi < hj) | (hi == hj) & np.fromiter((ask["keys"][a] < block["keys"][b] for a, b in zip(i, j, strict=True)), bool, len(i))
            i, j = i[first], j[first]
        firsts.append(i)
        seconds.append(j)
    return np.concatenate(firsts), np.concatenate(seconds)


def _entries(packed: dict, dtype: str, dim: int) -> dict:
    keys = packed["keys"]
    v = np.frombuffer(packed["v"], dtype).reshape(packed["n"], dim).astype(np.float64)
    return {"keys": [keys[i : i + 16] for i in range(0, len(keys), 16)], "copies": np.frombuffer(packed["copies"], np.int64), "x": _unit(v)}


def _keyed(vectors: DataFrame, label: str) -> tuple[DataFrame, str]:
    """vec_id, label (as text), key (16 bytes; null for what links with nothing) and v (the numbers), and their type."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    fits = F.col(label).isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.when(F.coalesce(fits, F.lit(False)), F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), usable.cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keys, raws = batch.column(2), [], []
            flat, off = column.values.to_numpy(zero_copy_only=False).astype(kind) + 0, column.offsets.to_numpy()  # -0 is 0
            for i, label in enumerate(batch.column(1).to_pylist()):
                raw = flat[off[i] : off[i + 1]].tobytes().rstrip(b"\0") if column[i].is_valid else None
                raw = raw if raw is None else raw + bytes(-len(raw) % int(kind[2]))
                raws.append(raw)
                keys.append(None if raw is None else hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "key", "v"])

    return rows.mapInArrow(act, "vec_id long, label string, key binary, v binary"), kind


def near_duplicates(vectors: DataFrame, least: float = 0.93, label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label; others aren't read).

    n_links counts the other rows of the same label with cosine `least` or more, copies included. component_id is the
    smallest vec_id reachable over links, the row's own included; kept says whether it is the row's own. A row links
    with nothing if its label or vector is null or its vector is all zeros or has a null or non-finite part: it has no
    links, and is its own component. A null vec_id counts as larger than any other; where a component has no other, its
    id is null and its rows are kept. Rows that repeat each count. A shorter vector counts as padded with zeros. An
    empty table gives an empty result. Quantisers are fitted on SAMPLE entries at most (fewer where they are long), by
    hash; which entries these are changes the work, not the result.
    """
    spark = vectors.sparkSession
    base = shared_dir(spark)
    keyed, kind = _keyed(vectors, label)
    rows = materialize(keyed, f"{base}/rows")
    linkable = rows.where("key IS NOT NULL")
    entries = linkable.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("smallest"))  # equal keys have equal labels and vectors
    entries = materialize(entries, f"{base}/entries")
    width = int(kind[2])
    dim = (entries.agg(F.max(F.octet_length("v"))).first()[0] or width) // width
    largest = entries.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    taken = entries.orderBy(F.xxhash64("key")).limit(max(1, min(SAMPLE, SAMPLE_VALUES // dim))).select("v").toArrow()  # bounded
    sample = _unit(np.stack([np.frombuffer(v.as_py().ljust(dim * width, b"\0"), kind) for v in taken.column("v")]).astype(np.float64)) if taken.num_rows else np.zeros((0, dim))
    quantiser = Quantiser(sample, max(1, min(MOST_CELLS, len(sample) // 16, -(-largest // CELL))))
    shared = spark.sparkContext.broadcast(quantiser)  # bounded: MOST_CELLS centroids
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    block_size = max(64, min(BLOCK, (1 << 19) // dim))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [x.as_py().ljust(dim * width, b"\0") for x in batch.column(2)]
            cell, codes, left = shared.value.encode(_unit(np.stack([np.frombuffer(x, kind) for x in v]).astype(np.float64))) if v else (np.zeros(0, int), np.zeros((0, 1), np.uint8), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), batch.column(1), batch.column(3), pa.array(v, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], ["label", "cell", "key", "n", "v", "codes", "left"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries in order of (label, cell) as blocks, a row for each."""
        names = ["number", "label", "cell", "n", "keys", "copies", "v", "codes", "left"]
        held: list[dict] = []
        number = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            joined = [b"".join(r[c] for r in held) for c in ("key", "v", "codes")]
            values = [number, held[0]["label"], held[0]["cell"], len(held), joined[0], np.array([r["n"] for r in held], np.int64).tobytes(), joined[1], joined[2], np.array([r["left"] for r in held]).tobytes()]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == block_size or (row["label"], row["cell"]) != (held[0]["label"], held[0]["cell"])):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block: its own cell, and each cell that some of its entries have to ask, with these entries."""
        names = ["label", "target", "origin", "cell", "n", "keys", "copies", "v"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        for batch in batches:
            for row in batch.to_pylist():
                own = _entries(row, kind, dim)
                wanted = shared.value.heights(own["x"], row["cell"]) <= reach / 2 + SLACK
                wanted[:, row["cell"]] = True
                v, out = np.frombuffer(row["v"], kind).reshape(row["n"], dim), []
                for target in np.flatnonzero(wanted.any(axis=0)).tolist():
                    who = np.flatnonzero(wanted[:, target])
                    out.append((row["label"], target, row["block"], row["cell"], len(who), b"".join(own["keys"][i] for i in who), own["copies"][who].tobytes(), v[who].tobytes()))
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 64], strict=True), kinds, strict=True)], names)

    laid = entries.select("label", "key", "v", "n").mapInArrow(encode, "label string, cell int, key binary, n long, v binary, codes binary, left double")
    laid = materialize(laid, f"{base}/codes").repartitionByRange("label", "cell", "key").sortWithinPartitions("label", "cell", "key")
    index = laid.mapInArrow(pack, f"number long, label string, cell int, {_PACKED}, codes binary, left binary")
    index = materialize(index.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("number")).drop("number"), f"{base}/index")
    asks = index.select("block", "label", "cell", "n", "keys", "copies", "v").mapInArrow(ask, f"label string, target int, origin long, cell int, {_PACKED}")
    asks = materialize(asks.withColumn("ask", F.monotonically_increasing_id()), f"{base}/asks")

    places = index.select("label", F.col("cell").alias("target"), "block")
    # within a cell a block asks itself and those after it
    meets = asks.select("ask", "label", "target", "origin", "cell").join(places, ["label", "target"]).where("cell <> target OR origin <= block").select("ask", "block")
    meets = materialize(meets, f"{base}/meets")
    parts = meets.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MOST_ASKS).cast("int").alias("parts"))
    sent = meets.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("ask"), F.col("parts")).cast("int")).drop("parts").join(asks.drop("label", "target"), "ask").drop("ask")
    given = index.drop("label").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    together = given.unionByName(sent, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", F.col("codes").isNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if row["codes"] is not None:
                    block = _entries(row, kind, dim) | {"id": row["block"], "cell": row["cell"], "codes": np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1), "left": np.frombuffer(row["left"])}
                    continue
                asking = _entries(row, kind, dim) | {"id": row["origin"], "cell": row["cell"]}
                a, b = _pairs(shared.value, reach, least, asking, block)
                if not len(a):
                    continue
                alike = asking["id"] == block["id"]
                n = 0 if alike else len(asking["x"])
                keys = block["keys"] if alike else asking["keys"] + block["keys"]
                copies = block["copies"] if alike else np.concatenate([asking["copies"], block["copies"]])
                links = np.zeros(len(keys), np.int64)
                np.add.at(links, a, copies[b + n])
                np.add.at(links, b + n, copies[a])
                root, found = components(len(keys), a, b + n), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.binary()), pa.array(links[found]), pa.array([keys[k] for k in root[found]], pa.binary())], ["key", "links", "other"])

    found = materialize(together.mapInArrow(meet, "key binary, links long, other binary"), f"{base}/found")
    roots = connected(found.where("key <> other").select(F.col("key").alias("u"), F.col("other").alias("v"))).withColumnRenamed("v", "key")
    rooted = entries.select("key", "n", "smallest").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(roots, "key", "left")
    rooted = materialize(rooted.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"), "smallest"), f"{base}/rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select("key", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linkable.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(least: float = 0.93) -> str:
    """DuckDB SQL of op13's rows: all pairs of a label, and what is reachable over them."""
    return f"""WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pair AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= {least}),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), links AS (SELECT a, count(*) AS n FROM pair GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN links ON vec_id = links.a"""
