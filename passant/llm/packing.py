"""Best-fit packing after a Martello-Toth reduction.

Lengths are whole numbers up to the sequence length, so an instance of any size is its histogram: how many pieces have
each length. The driver holds that histogram only (as many numbers as the sequence length) and packs counts:

1. Reduction. A set of pieces may be fixed for good if it dominates every other set that holds its largest piece: a
   piece that no other fits beside; a pair where only one other fits at a time; a pair that fills a sequence; and, where
   at most two others fit, the largest single one if it is at least as large as the best pair. What is fixed leaves
   the instance, which may make further sets dominant.
2. The remainder is packed by best fit, longest first, again by counts: equal sequences are one group.

The plan says for each length which ranks go to which sequences. Ranks are dealt out by salted counting, so that a
length with a third of all pieces doesn't meet in one task.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, shared_dir, whole_text

#: Rows whose rank is counted together.
SALT_ROWS = 50_000


class ByteLevelIds:
    """Ids of a byte-level BPE given as tokenizers' .json; its added tokens are matched in texts, which is its default.

    Where the folder also holds the same vocabulary as ranks (.tiktoken), that faster library gives the same ids. It can't
    split every text: its expression looks ahead from each white-space character, and gives up on very long runs of them.
    Such texts go to tokenizers.
    """

    def __init__(self, json_file: str):
        from tokenizers import Tokenizer

        ranks_file = json_file.removesuffix(".json") + ".tiktoken"
        self.slow = Tokenizer.from_file(json_file)
        self.fast = None
        if os.path.exists(ranks_file):
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {x.content: i for i, x in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the expression gave up
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_CODERS: dict[str, ByteLevelIds] = {}


def coder(json_file: str) -> ByteLevelIds:
    if json_file not in _CODERS:
        _CODERS[json_file] = ByteLevelIds(json_file)
    return _CODERS[json_file]


def pieces(docs: DataFrame, json_file: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only where they exceed the capacity.

    All pieces but the first are of full length.
    """
    import zlib

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = coder(json_file).ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py()).astype("<u4"), np.array([end_id], "<u4"))
                head = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
                    part = ids[start : head if start == 0 else start + capacity]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(act, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs (length, first rank, pieces, first sequence, pieces of this length in a sequence, first offset)."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.used: dict[int, int] = {}
        self.sequences = 0

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def place(self, length: int, sequences: int, first: int, each: int, offset: int) -> None:
        """Put `each` pieces of a length into each of so many sequences from `first` on, from an offset on."""
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, sequences * each, first, each, offset))
        self.used[length] = rank + sequences * each


def reduce_dominated(count: dict[int, int], capacity: int, plan: Plan) -> None:
    """Fix dominating sets, longest piece first, until none is left; count shrinks to the remainder."""

    def fix(*lengths: int) -> None:
        """As many equal sequences of these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(count[x] // k for x, k in need.items())
        first, offset = plan.open(n), 0
        for x, k in need.items():
            plan.place(x, n, first, k, offset)
            offset += x * k
            count[x] -= n * k
            if not count[x]:
                del count[x]
                present.pop(bisect_left(present, x))

    present = sorted(count)
    changed = True
    while changed:
        changed = False
        for j in sorted(present, reverse=True):
            while count.get(j):
                room = capacity - j
                left = lambda x: count.get(x, 0) - (x == j)  # noqa: E731  without the piece itself
                fit = [x for x in present[: bisect_left(present, room + 1)] if left(x) > 0]
                if not fit:  # nothing fits beside it
                    if count[j] > 1 and j <= room:
                        break
                    fix(j)
                elif fit[-1] == room:  # a pair that fills the sequence
                    if room == j and count[j] < 2:
                        break
                    fix(j, room)
                else:
                    smallest = [x for x in fit[:3] for _ in range(min(3, left(x)))][:3]
                    if len(smallest) < 2 or smallest[0] + smallest[1] > room:  # one other at a time
                        fix(j, fit[-1])
                    elif (len(smallest) < 3 or sum(smallest) > room) and fit[-1] >= _best_pair(fit, left, room):
                        fix(j, fit[-1])  # two others at most, and no two are larger than the largest one
                    else:
                        break
                changed = True


def _best_pair(fit: list[int], left, room: int) -> int:
    """The largest sum of two pieces that fits."""
    best, lo, hi = 0, 0, len(fit) - 1
    while lo <= hi:
        total = fit[lo] + fit[hi]
        if total > room:
            hi -= 1
        elif lo == hi:
            return max(best, total if left(fit[lo]) > 1 else 0)
        else:
            best = max(best, total)
            if left(fit[lo]) > 1:
                best = max(best, 2 * fit[lo])
            lo += 1
    return best


def best_fit(count: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit, longest first, over groups of equal sequences: (room, first sequence, how many)."""
    rooms: list[tuple[int, int, int]] = []
    for length in sorted(count, reverse=True):
        n = count[length]
        while n:
            at = bisect_left(rooms, (length,))
            room, first, many = rooms.pop(at) if at < len(rooms) else (capacity, -1, n)
            each = room // length
            full = min(many, n // each)
            last = n - full * each if full < many else 0  # what is left goes to one more sequence of the group
            last = last if last < each else 0
            if first < 0:
                many = full + (1 if last else 0)
                first = plan.open(many)
            if full:
                plan.place(length, full, first, each, capacity - room)
                insort(rooms, (room - each * length, first, full))
            if last:
                plan.place(length, 1, first + full, last, capacity - room)
                insort(rooms, (room - last * length, first + full, 1))
            if many - full - (1 if last else 0):
                rest = full + (1 if last else 0)
                insort(rooms, (room, first + rest, many - rest))
            n -= full * each + last


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    count, plan = {k: v for k, v in histogram.items() if v}, Plan()
    reduce_dominated(count, capacity, plan)
    best_fit(count, capacity, plan)
    return plan


def ranked(rows: DataFrame) -> DataFrame:
    """rows (a scan) with rank: 0, 1, ... within each length. Each salt counts its own rows and starts after those before
    it; it comes from a row's file and index, so that rows with one doc_id or none are dealt out like any other."""
    salts = max(1, -(-rows.count() // SALT_ROWS))
    rows, file, row = located(rows)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(file, row), F.lit(salts)).cast("int")).drop(file, row)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("length", "salt", "sum(n) OVER (PARTITION BY length ORDER BY salt) - n AS before")
    own = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32) - 1 AS own")
    return own.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def pack(docs: DataFrame, json_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    docs: doc_id, text; other columns are not read. Null text counts as empty: it has the end id alone. Null doc_ids and
    repeated rows are packed like any other. An empty table gives an empty result. The histogram that reaches the
    driver has as many rows as the capacity at most, whatever the input; so have the plan's lengths.
    """
    rows = materialize(pieces(docs, json_file, capacity, end_id), f"{shared_dir(docs.sparkSession)}/pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    key = np.empty(len(runs), [("length", np.int64), ("rank", np.int64)])
    key["length"], key["rank"] = runs[:, 0], runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(length), key.dtype)
            at["length"], at["rank"] = length, rank
            run = runs[np.searchsorted(key, at, "right") - 1] if len(runs) else runs
            inside = rank - run[:, 1]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + inside // run[:, 4]), pa.array(run[:, 5] + inside % run[:, 4] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
