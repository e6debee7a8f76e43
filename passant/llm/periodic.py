"""Periodic runs of words by bit-parallel lags.

Word ids are laid out as bit planes, one big integer for each bit of an id; documents of like lengths lie side by side
with a gap between them, so that one integer operation compares thousands of words of many documents. For a lag q:

1. XOR of a plane with itself shifted by q marks where this bit differs; the OR over the planes marks where words q
   apart differ.
2. What is left are stretches of matches. An AND with itself shifted by 1, 2, 4, ... keeps the places from which on a
   stretch is long enough, max(q, least - q). A lag is abandoned as soon as nothing is left, mostly after two planes.
3. A stretch of m matches is a run of m + q words, which no neighbouring word extends. If it also has a smaller
   period, then one that divides q, with the same two ends: it was found under that lag before and is left out.

For documents of many words, lags from 64 on are first sieved: a stretch of q matches holds four neighbouring multiples
of Q / 4, where Q is the largest power of two up to q, and each of them matches q words later. That is compared for all
lags from Q to 2 Q at once. Matches inside a known run whose period divides the lag are left out, as they can only find
that run again. So the work grows about as n log n in a document's n words, repetitive or not; only lags that pass go
through the steps above.

Everything happens where the texts are read: one pass, no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.llm.common import whole_text

#: Fewest words of a run. Words compared at once, unless one document has more; documents with more are sieved.
LEAST, LANES, SIEVED = 12, 1 << 15, 4096
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def stretches(match: int, t: int) -> int:
    """The places from which on t bits in a row are set."""
    have = 1
    while have < t and match:
        step = min(have, t - have)
        match &= match >> step
        have += step
    return match


def ends_of(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each row of set bits."""
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    each = np.unpackbits(raw, bitorder="little").astype(np.int8)
    edge = np.flatnonzero(np.diff(each, prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


class Lanes:
    """Documents side by side as bit planes; ids holds their words with one place free after each document."""

    def __init__(self, ids: np.ndarray, taken: np.ndarray, least: int = LEAST):
        self.least, self.valid0 = least, plane(taken)
        self.planes = [plane(ids >> b & 1) for b in range(int(ids.max(initial=0)).bit_length())]
        self.known: dict[tuple[int, int], int] = {}  # (start, end) of a run: its period

    def look(self, q: int, valid: int) -> None:
        """Add the runs of smallest period q; valid: places whose word q further on is in the same document."""
        t, differs, match = max(q, self.least - q), 0, valid
        for b in range(0, len(self.planes), 2):
            for p in self.planes[b : b + 2]:
                differs |= p ^ (p >> q)
            match = stretches(valid ^ (valid & differs), t)
            if not match:
                return
        match = match if self.planes else stretches(valid, t)
        if match:
            for start, end in zip(*(x.tolist() for x in ends_of(match)), strict=True):
                self.known.setdefault((start, end + t - 1 + q), q)

    def every_lag(self, most: int) -> None:
        valid = self.valid0
        for q in range(1, most + 1):
            valid &= valid >> 1
            if not valid:
                return
            self.look(q, valid)


def sieve(ids: np.ndarray, low: int, known: dict[tuple[int, int], int]) -> np.ndarray:
    """The lags from low (a power of two from 4 on) to 2 * low that can hold a run which isn't known yet."""
    n, step = len(ids), low // 4
    width = max(0, min(2 * low, n // 2 + 1) - low)
    explained = defaultdict(list)
    for (start, end), period in known.items():
        if end - start > low and period < low:
            for a in range(-(-start // step) * step, end - low, step):
                explained[a].append((end, period))
    found, rows = np.zeros(width, bool), [np.zeros(width, bool)] * 3
    for a in range(0, n - low, step):
        now = np.zeros(width, bool)
        ahead = ids[a + low : a + low + width]
        np.equal(ahead, ids[a], out=now[: len(ahead)])
        for end, period in explained.get(a, ()):
            now[-low % period : max(0, end - a - low) : period] = False
        rows = [now, now & rows[0], now & rows[1], now & rows[2]]  # matches here; here and one before; ...
        found |= rows[3]
    return low + np.flatnonzero(found)


def runs_of(documents: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start and then period. A document is its words' ids."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted(range(len(documents)), key=lambda i: len(documents[i]))
    group: list[int] = []
    held = 0

    def settle() -> None:
        starts = np.cumsum([0, *(len(documents[i]) + 1 for i in group)])
        ids, taken = np.zeros(starts[-1], np.int64), np.ones(starts[-1], np.uint8)
        for i, at in zip(group, starts.tolist(), strict=False):
            ids[at : at + len(documents[i])] = documents[i]
        taken[starts[1:] - 1] = 0
        lanes = Lanes(ids, taken, least)
        longest = len(documents[group[-1]])
        if longest <= SIEVED:
            lanes.every_lag(longest // 2)
        else:  # one document
            lanes.every_lag(63)
            low = 64
            while low <= longest // 2:
                for q in sieve(documents[group[-1]], low, lanes.known).tolist():
                    lanes.look(q, (1 << (longest - q)) - 1)
                low *= 2
        for (start, end), period in lanes.known.items():
            lane = int(np.searchsorted(starts, start, "right")) - 1
            out[group[lane]].append((start - int(starts[lane]), end - start, period))

    for i in order:
        n = len(documents[i])
        if n < least:
            continue
        if group and (held + n > LANES or n > SIEVED):
            settle()
            group, held = [], 0
        group.append(i)
        held += n
    if group:
        settle()
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def collapse_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and collapsed (the words that stay, joined by
    one space) for every row of docs; other columns are not read.

    Words are what stands between blanks and the control characters 9 to 13, compared as they are. A run is a stretch
    of `least` words or more with smallest period q, of 2 q words or more, that no neighbouring word extends; its words
    after the first q are dropped. Null text counts as empty: no words, no runs, an empty collapsed text. Repeated rows
    each give a row, null doc_ids too. An empty table gives an empty result. Whole texts are taken, however long.
    """
    names = ["doc_id", "n_words", "runs", "collapsed"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col(text)).alias("text"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            while i < batch.num_rows:  # some MB of words at a time
                words, held, j = [], 0, i
                while j < batch.num_rows and held < 1 << 20:
                    words.append(batch.column(1)[j].as_buffer().to_pybytes().split())
                    held, j = held + len(words[-1]), j + 1
                number = defaultdict(count().__next__)
                runs = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], least)
                kept = []
                for w, r in zip(words, runs, strict=True):
                    if r:
                        gone = dropped(len(w), r)
                        w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(w))
                as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(len, words), pa.int64()), pa.array(as_rows, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())], names)
                i = j

    return rows.mapInArrow(act, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the greatest length, ties to the smallest start and then period; null without runs."""
    by = F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("under"), r.alias("run")))
    return F.array_max(by)["run"]


def listed(runs: Column) -> Column:
    """start,length,period and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(doc_id: Column, words: Column) -> Column:
    """The words of a document, of which some get a period: for one doc_id of ten by CRC-32, all words from the a-th on
    repeat those from a to a + p. a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), where g is a tenth of the CRC."""
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = F.pmod(g, F.nullif(n, F.lit(0)))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    times = F.ceil((n - a) / p).cast("int")
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(words, F.lit(1), a.cast("int")), again)).otherwise(words)
