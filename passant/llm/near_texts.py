"""SimHash near-dedup of texts at a Jaccard similarity of their word shingles.

A radius of a few bits of 64 finds only copies that are all but equal. At a similarity of 0.8 a bit differs with a chance
of acos(cosine) / pi, about 0.15, so this search takes fingerprints of 128 bits and a radius that holds 99 of 100 such
pairs, which blocks of agreeing bits can't be keys for.

1. Every text is a set of hashed shingles; equal sets are one vertex. Its fingerprint is the majority of each bit.
2. Keys are fixed choices of `bits` bits of the fingerprint, as many choices as it takes for a pair within the radius to
   agree on one of them with a chance of 0.98 (of pairs at just the given similarity; closer ones agree far more often).
   `bits` grows with the number of vertices, so that a key holds few unrelated ones.
3. Within a key fingerprints are compared bit-sliced, all of them, and a task gives back links that connect the same
   vertices. Keys with many vertices are cut into cells that meet in pairs.
4. What is connected so far is a candidate group. Only texts of such groups are read again, for their shingles; within
   a group links are verified: exact Jaccard over the shingle sets, for each pair that a sketch of the sets doesn't rule
   out and that isn't connected already. Large groups are cut into cells that meet in pairs, too.
5. Components of verified links are the near-duplicates.

So no pair below the similarity links, and no number of partners, candidates or copies is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, only_rows, scan_of, shared_dir, whole_text
from passant.llm.simhash import LANES, connected, linked

BITS, BINS = 128, 256
#: Vertices of a cell, and bytes of shingles that a cell of a group holds.
CELL, CELL_BYTES = 2048, 16 << 20
#: Rows of candidate groups (a path and three numbers each) that are broadcast at most.
MOST_ASKED = 200_000
#: The share of pairs at just the given similarity that the keys may miss, and that the radius may.
MISSED, BEYOND = 0.02, 0.01


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The different hashes (XXH64) of a text's shingles of lower-cased words, in order; of fewer words, of all of them."""
    import xxhash

    found = text.lower().split()
    if len(found) < words:
        parts = [b" ".join(found)] if found else []
    else:
        parts = list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 further bits from each hash, by multiply and shift (splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Of each of 128 bits, whether more than half the hashes have it set."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        both = np.stack([part, _mixed(part)], axis=1)
        total += np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").tobytes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte for each of 256 bins of hashes, taken from the smallest there (1 to 255), 0 for an empty bin."""
    out = np.zeros(BINS, np.uint8)
    bin_of = (hashes >> np.uint64(56)).astype(np.int64)  # hashes are in order, and so are their bins
    first = np.flatnonzero(np.diff(bin_of, prepend=-1))
    out[bin_of[first]] = 1 + (hashes[first] % np.uint64(255)).astype(np.uint8)
    return out


def _flip(least: float) -> float:
    """The chance that a bit differs between two sets of like size with Jaccard similarity `least`."""
    return math.acos(min(1.0, 2 * least / (1 + least))) / math.pi


def radius_of(least: float) -> int:
    """Bits within which all but BEYOND of the pairs at the similarity lie (binomial)."""
    p, held, chance = _flip(least), 0.0, 1.0
    for d in range(BITS + 1):
        chance = math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d)
        held += chance
        if held >= 1 - BEYOND:
            return d
    return BITS


def choices(n: int, least: float) -> list[np.ndarray]:
    """The bits of each key, for n vertices: a key holds about 16 unrelated vertices at most, from 2^14 vertices on."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 4)
    tables = math.ceil(math.log(MISSED) / math.log1p(-((1 - _flip(least)) ** bits)))
    rng = np.random.default_rng(128)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def _keyed(vertices: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """key (number of the choice and the bits), id and the fingerprint (low, high)."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1)
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            for number, places in enumerate(chosen):
                key = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places))) + (number << len(places))
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "id", "low", "high"])

    return vertices.select("id", "low", "high").mapInArrow(act, "key long, id long, low long, high long")


def _cells(rows: DataFrame, group: str, hot: DataFrame) -> DataFrame:
    """rows with cell: groups of several cells' worth (hot: group, cells) meet as pairs of their cells."""
    small = hot.where("cells > 1").select(F.col(group).alias("_g"), (F.col("cells") * 2).cast("long").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    spread = rows.join(small, F.col(group) == F.col("_g"), "left").withColumn("_own", F.pmod(F.xxhash64("id"), n))
    pairs = spread.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return pairs.withColumn("cell", F.least("_own", "_other") * n + F.greatest("_own", "_other")).select(*rows.columns, "cell")


def candidates(vertices: DataFrame, least: float) -> DataFrame:
    """u, v: links between vertices (id, low, high) that connect what pairs within the radius and a common key connect."""
    keyed = _keyed(vertices, choices(vertices.count(), least))
    cells = _cells(keyed, "key", keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells")))
    radius = radius_of(least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            label = linked(np.ascontiguousarray(rows[:, 3:]).view(np.uint8), np.concatenate([[0], np.cumsum(change)]), radius)
            at = np.flatnonzero(label != np.arange(len(rows)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rows[label[at], 2]), pa.array(rows[at, 2])], ["u", "v"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            if sum(map(len, held)) < LANES:
                continue
            rows = np.concatenate(held)
            starts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1  # where another group begins
            begin = 0
            for end in [*starts[np.flatnonzero(np.diff(starts // LANES))], *starts[-1:]]:
                if end > begin:
                    yield from judged(rows[begin:end])
                    begin = end
            held = [rows[begin:]]
        if held:
            yield from judged(np.concatenate(held))

    laid = cells.select("key", "cell", "id", "low", "high").repartition("key", "cell").sortWithinPartitions("key", "cell", "low", "high", "id")
    return laid.mapInArrow(compare, "u long, v long").distinct()


def verified(sets: list[np.ndarray], sketches: np.ndarray, least: float) -> np.ndarray:
    """For each set the first one that it is connected to by pairs of similarity `least` or more."""
    root = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    taken = sketches != 0
    for i in range(len(sets) - 1):
        other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        other = other[np.minimum(sizes[other], sizes[i]) >= least * np.maximum(sizes[other], sizes[i])]
        if not len(other):
            continue
        same = ((sketches[other] == sketches[i]) & taken[i]).sum(axis=1)
        estimate = same / np.maximum(1, (taken[other] | taken[i]).sum(axis=1))
        near = other[estimate >= least - 0.25]  # eight standard errors of 256 bins
        for j in near[np.argsort(-estimate[estimate >= least - 0.25], kind="stable")].tolist():
            if root[j] != root[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (sizes[i] + sizes[j] - common):
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
    return root


def _verified_links(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """u, v within candidate groups; members: root, id, hashes (binary); sizes: root and n (shingles) of each member."""
    weight = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n") * 8 / CELL_BYTES))
    cells = _cells(members, "root", sizes.groupBy("root").agg(weight.alias("cells")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def judged() -> Iterator[pa.RecordBatch]:
            if len(ids) < 2:
                return
            root = verified(sets, np.stack([sketch(s) for s in sets]), least)
            at = np.flatnonzero(root != np.arange(len(ids))).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([ids[root[k]] for k in at]), pa.array([ids[k] for k in at])], ["u", "v"])

        for batch in batches:
            for k in range(batch.num_rows):
                here = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if here != now:
                    yield from judged()
                    now, ids, sets = here, [], []
                ids.append(batch.column(2)[k].as_py())
                sets.append(np.frombuffer(batch.column(3)[k].as_py(), np.uint64))
        yield from judged()

    laid = cells.select("root", "cell", "id", "hashes").repartition("root", "cell").sortWithinPartitions("root", "cell", "id")
    return laid.mapInArrow(judge, "u long, v long").distinct()


def _vertices(docs: DataFrame, file: str, row: str, words: int) -> DataFrame:
    """Of each row its place, doc_id, its set of shingles (digest and number) and its fingerprint."""
    names = [file, row, "doc_id", "digest", "n", "low", "high"]
    rows = docs.select(file, row, F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps = [], [], []
            for t in batch.column(3):
                hashes = shingles(t.as_buffer().to_pybytes(), words)
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                fps.append(fingerprint(hashes))
            fp = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1])], names)

    return rows.mapInArrow(act, f"{file} string, {row} long, doc_id long, digest binary, n long, low long, high long")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """root, id and hashes of texts (root, id, text)."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t.as_buffer().to_pybytes(), words).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hashes, pa.binary())], ["root", "id", "hashes"])

    return texts.select("root", "id", whole_text(F.col("text")).alias("text")).mapInArrow(act, "root long, id long, hashes binary")


def _grouped(docs: DataFrame, file: str, row: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, digest, place) and, for every digest, its first row and the smallest id of its component."""
    base = shared_dir(docs.sparkSession)
    rows = materialize(_vertices(docs, file, row, words), f"{base}/fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(file).alias("file"), F.col(row).alias("row"))
    vertices = rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "low", "high")], F.min(at).alias("first"))  # equal sets are equal in all of these
    vertices = materialize(vertices.withColumn("id", F.monotonically_increasing_id()), f"{base}/vertices")
    linked_ones = connected(candidates(vertices, least)).select(F.col("v").alias("id"), "root")
    groups = linked_ones.unionByName(linked_ones.select(F.col("root").alias("id"), "root")).distinct()
    groups = materialize(groups.join(vertices, "id").select("id", "root", "n", F.col("first.file").alias("_f"), F.col("first.row").alias("_r")), f"{base}/groups")
    # texts are read again for candidate groups only, one for each vertex, and don't move before they are sets
    few = only_rows(docs.select(file, row, "text"), file, row, groups.select(F.col("_f").alias(file), F.col("_r").alias(row)))
    asked = F.broadcast(groups) if groups.limit(MOST_ASKED + 1).count() <= MOST_ASKED else groups
    texts = few.join(asked, (F.col(file) == F.col("_f")) & (F.col(row) == F.col("_r")))
    found = connected(_verified_links(_hashed(texts, words), groups, least)).select(F.col("v").alias("id"), "root")
    return rows, materialize(vertices.join(found, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root")), f"{base}/components")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over verified links, for every row of docs (doc_id, text).

    Texts link if the Jaccard similarity of their sets of word shingles is `least` or more. Null text counts as empty; all
    texts without a word are one component. component_id is null where a component has null doc_ids only. Repeated rows
    each give a row. An empty table gives an empty result.
    """
    docs, file, row = located(scan_of(docs, ("doc_id", "text")).docs)
    rows, grouped = _grouped(docs, file, row, words, least)
    named = grouped.join(grouped.groupBy("root").agg(F.min("first.doc_id").alias("component_id")), "root").select("digest", "component_id")
    return rows.join(named, "digest").select("doc_id", "component_id")


def kept_rows(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one of each component.

    It is the row with the smallest doc_id (null counts as largest); among rows that repeat that doc_id, the first by
    file and row. What stays is decided by row: a null or repeated doc_id keeps no other row. Null text counts as empty; of
    all texts without a word one stays. An empty table gives an empty result.
    """
    docs, file, row = located(scan_of(docs).docs)
    _, grouped = _grouped(docs, file, row, words, least)
    stay = grouped.groupBy("root").agg(F.min("first").alias("at")).select(F.col("at.file").alias(file), F.col("at.row").alias(row))
    return only_rows(docs, file, row, stay).drop(file, row)
