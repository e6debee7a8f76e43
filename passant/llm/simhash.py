"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 bits; documents link where theirs differ in `radius` bits at most. Equal fingerprints are one
vertex. By the pigeonhole principle two linked fingerprints agree on some `blocks - radius` of `blocks` bit blocks,
so every choice of so many blocks makes a key, and only fingerprints with a common key are compared. Keys get longer
(more blocks) as the number of distinct fingerprints grows, so that a key holds a bounded number of unrelated ones.

Within a key the comparison is bit-sliced: a block of fingerprints is stored as 64 bit planes, one long integer for
each bit; shifted by s, the planes compare every fingerprint with its s-th neighbour at once. Differences are added
by carry-save counters (ones, twos, and a sticky "too many"), and a block is abandoned as soon as all its pairs are
beyond the radius. A task gives back links that connect the same fingerprints, not all pairs. A key with many
fingerprints is cut into cells that meet in pairs, so no task holds more than two cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, only_rows, scan_of, shared_dir, whole_text

CELL = 2048
#: Lanes of a bit-sliced block: whole keys are gathered up to so many.
LANES = 8192


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority of each bit over the XXH64 (seed 42) of the word shingles, repeats included; 0 for no word."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    total = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 15):
        part = shingles[i : i + (1 << 15)]
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        total += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and the columns carried for every row; null text counts as empty."""
    names = ["doc_id", "fp", *carried]

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"), *carried)
    return rows.mapInArrow(act, ", ".join(["doc_id long", "fp long", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried]]))


def _block_count(n: int, radius: int) -> int:
    """The fewest blocks whose keys hold about 64 unrelated fingerprints at most."""
    for blocks in range(radius + 1, radius + 5):
        if n / 2.0 ** (64 // blocks * (blocks - radius)) <= 64:
            return blocks
    return radius + 4


def _keyed(distinct: DataFrame, blocks: int, radius: int) -> DataFrame:
    """fp under each of its keys."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(number).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(value)
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def _cells(keyed: DataFrame) -> DataFrame:
    """key, i, j, fp: keys with over CELL fingerprints are cut into cells, and each pair of cells is a group."""
    hot = keyed.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / (CELL // 2)).cast("int").alias("n"))
    rows = keyed.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
    pairs = rows.select("key", "fp", "own", other.alias("other"))
    return pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n vertices' component, given edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def linked(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For lanes sorted by group: the first lane that each lane is connected to by pairs of its group within the radius.

    fp: a number of 64 bits for each lane, or a row of bytes. Counters hold ones and twos; a carry out of them, or a count over the radius, sets the sticky plane.
    """
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(column, bitorder="little").tobytes(), "little") for column in bits.T]
    size_of_counter = max(1, radius.bit_length())
    firsts, seconds, label, gathered = [], [], np.arange(n), 0
    for s in range(1, n):
        same = group[:-s] == group[s:]
        if not same.any():
            break
        beyond = ~int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little") & ((1 << (n - s)) - 1)
        everything = (1 << (n - s)) - 1
        counter = [0] * size_of_counter
        for plane in planes:
            carry = (plane ^ (plane >> s)) & everything
            for k in range(size_of_counter):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            beyond |= carry
            if beyond == everything:
                break
        if radius + 1 != 1 << size_of_counter:
            beyond |= _over(counter, radius, everything)
        near = everything & ~beyond
        if near:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes((n - s + 7) // 8, "little"), np.uint8), bitorder="little")[: n - s])
            firsts.append(label[at])
            seconds.append(label[at + s])
            gathered += len(at)
        if gathered > 1 << 18:
            label = components(n, np.concatenate(firsts), np.concatenate(seconds))[label]
            firsts, seconds, gathered = [], [], 0
    if firsts:
        label = components(n, np.concatenate(firsts), np.concatenate(seconds))[label]
    return label


def _over(counter: list[int], radius: int, everything: int) -> int:
    """Lanes whose counter exceeds the radius, compared from the highest bit."""
    over, equal = 0, everything
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """u, v: links between different fingerprints that connect the same ones as all pairs within the radius do."""
    cells = _cells(_keyed(distinct, _block_count(distinct.count(), radius), radius))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            group = np.zeros(len(fp), np.int64)
            group[change] = 1
            label = linked(fp.view(np.uint64), np.cumsum(group), radius)
            at = np.flatnonzero((label != np.arange(len(fp))) & (fp[label] != fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[label[at]]), pa.array(fp[at])], ["u", "v"])

        keys, fps, held = [], [], 0
        for batch in batches:
            keys.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1))
            fps.append(batch.column(3).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held < LANES:
                continue
            key, fp = np.concatenate(keys), np.concatenate(fps)
            starts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1  # where another group begins
            begin = 0
            for end in [*starts[np.flatnonzero(np.diff(starts // LANES))], *starts[-1:]]:
                if end > begin:
                    yield judged(key[begin:end], fp[begin:end])
                    begin = end
            keys, fps, held = [key[begin:]], [fp[begin:]], len(key) - begin
        if held:
            yield judged(np.concatenate(keys), np.concatenate(fps))

    near = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(compare, "u long, v long")
    return near.distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """v, root: the smallest vertex reachable from each vertex that has a link, by alternating large and small stars.

    Every round is written to the shared folder; neighbourhoods are reduced by aggregation before they are joined, so
    that a vertex with very many neighbours doesn't meet in one task.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not edges.take(1):
        return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        if small:
            out = moved.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
        else:
            out = moved.where("v > u").select(F.col("v").alias("a"), "m")
        return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        edges = materialize(star(star(edges, small=False), small=True))
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable over links, the row's own included; null where the whole component
    has null doc_ids only. Null text counts as empty; all texts without a word have fingerprint 0 and link like any
    other. Repeated rows each give a row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    rows = materialize(fingerprints(docs, words), f"{base}/fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{base}/distinct")
    rooted = _rooted(distinct, radius)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """fp, least and root (the component's smallest fingerprint) for distinct fingerprints (fp, least)."""
    root = connected(links(distinct.select("fp"), radius))
    # fingerprints without a link are their own component
    return distinct.join(root.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def kept_rows(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names: one of each component.

    It is the row with the smallest doc_id (null counts as largest); among rows that repeat that doc_id, the first by
    file and row. What stays is decided by row: a null or repeated doc_id keeps no other row. Null text counts as empty;
    all texts without a word are one component with what is near to fingerprint 0. An empty table gives an empty result.
    """
    base = shared_dir(docs.sparkSession)
    docs, file, row = located(scan_of(docs).docs)
    rows = materialize(fingerprints(docs, words, (file, row)), f"{base}/fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(file).alias("file"), F.col(row).alias("row"))
    distinct = materialize(rows.groupBy("fp").agg(F.min(at).alias("least")), f"{base}/distinct")
    stay = _rooted(distinct, radius).groupBy("root").agg(F.min("least").alias("at")).select(F.col("at.file").alias(file), F.col("at.row").alias(row))
    return only_rows(docs, file, row, stay).drop(file, row)
