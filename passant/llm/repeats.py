"""Where do windows of a fixed number of tokens repeat, across and inside texts?

Both substring operators work in the same four steps, keyed by the text's digest so that exact copies count as one
text with a number of copies (every window of a text with two copies is repeated):

1. Leading digit. Every window has one anchor: the gram of `gram` tokens inside it with the smallest fingerprint. Equal
   windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a text has far fewer
   anchors than windows. Anchors that occur once end here; nothing that holds one can be repeated.
2. The windows that remain are sent, as stretches of text, to where their anchor's other occurrences are.
3. There the operator's own method finds which of the windows are equal (`resolve`).
4. Their positions go back to the texts, which are joined once more to remove what is covered.

The exchange of texts is the same in steps 1, 2 and 4, so Spark moves the texts once. Counting an anchor is a
pre-aggregated sum, and the join that brings the count back can split an anchor that very many texts hold.

An anchor with over `HOT` occurrences would meet in one task in step 3. Its stretches are cut into cells of neighbouring
windows and keyed by the next digit, too: what all windows of a cell have in common. Equal windows still meet, and
stretches that run into different surroundings don't. Equal stretches are first collapsed inside salted parts of the
key, in sorted order: two of them are known to be repeated there and then, and only one goes on.

Fingerprints decide which stretches meet; which windows are equal is decided on tokens themselves (`refine`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import digest, runs_of, utf8, whole_text

MASK = np.uint64((1 << 20) - 1)
#: Tokens of a stretch that is fingerprinted at once, and bytes of texts read for it.
STRETCH, SLICE = 1 << 19, 1 << 21
#: Stretches of text read together, and windows resolved together (one anchor's at least).
GATHERED, RESOLVED = 8_192, 1 << 19
#: Occurrences from which an anchor is hot, and the parts in which its equal stretches are collapsed.
HOT, SALTS = 20_000, 64
STRETCH_ROW = "seed long, th binary, first long, lead int, windows int, alone boolean, part binary"
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * ODD[0])


class Powers:
    """Powers of an odd multiplier modulo 2^64, and of its inverse."""

    def __init__(self, odd: np.uint64):
        self.odd, self.inverse = odd, np.uint64(pow(int(odd), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (self.odd, self.inverse))
        return self.up[:n], self.down[:n]


POWERS = tuple(map(Powers, ODD))


class Prints:
    """Fingerprints of any stretch of a sequence of token values: a difference of prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].get(len(values) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.prefix[start + length] - self.prefix[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return mixed((self.prefix[length:] - self.prefix[:n]) * self.down[:n])


@dataclass(frozen=True)
class Tokens:
    """Token values of texts one after another; bounds of the texts in tokens; where each token is in the bytes."""

    values: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def bytes_as_tokens(raw: np.ndarray, bounds: np.ndarray) -> Tokens:
    at = np.arange(len(raw) + 1)
    return Tokens(BYTE_VALUES[raw], bounds, at[:-1], at[1:])


def words_as_tokens(raw: np.ndarray, bounds: np.ndarray) -> Tokens:
    """Words are runs of bytes other than space and 9 to 13; a text's end ends a word."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    prints = Prints(BYTE_VALUES[raw])
    return Tokens(mixed(prints.at(starts, ends - starts) + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds), starts, ends)


def bytes_exactly(raw: np.ndarray, tokens: Tokens) -> np.ndarray:
    return raw


def words_exactly(raw: np.ndarray, tokens: Tokens) -> np.ndarray:
    """A number for each word; equal words, and only those, have equal numbers."""
    data, number = raw.tobytes(), {}
    return np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(tokens.starts.tolist(), tokens.ends.tolist(), strict=True)), np.int64, len(tokens.starts))


Tokenize = Callable[[np.ndarray, np.ndarray], Tokens]
#: Which windows repeat: token values, exact tokens, first token of each stretch's first window, its anchor's token, its
#: windows and its anchor's number; a flag for each window, stretch after stretch.
Resolve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def refine(rows: np.ndarray, group: np.ndarray, digits: Iterable[Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """Those of rows (in the order of their group) that agree with another row of their group in every digit.

    Each pass orders the groups that a digit splits by that digit and drops rows that are left alone; groups that agree in
    the digit stay as they are.
    """
    new = np.concatenate([np.ones(min(1, len(rows)), bool), group[1:] != group[:-1]])
    for digit in (None, *digits):
        if digit is not None:
            value = digit(rows)
            name = np.cumsum(new) - 1
            split = np.zeros(int(new.sum()), bool)
            split[name[value != value[np.flatnonzero(new)][name]]] = True
            at = np.flatnonzero(split[name])
            if len(at):
                order = at[np.lexsort((value[at], name[at]))]
                rows[at], value[at] = rows[order], value[order]
                new[at] |= np.concatenate([[True], value[at][1:] != value[at][:-1]])
        first = np.flatnonzero(new)
        alone = np.diff(np.append(first, len(rows))) == 1
        if alone.any():
            keep = np.ones(len(rows), bool)
            keep[first[alone]] = False
            rows, new = rows[keep], new[keep]
        if not len(rows):
            break
    return rows


def run_starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where a row differs from the row before it in one of the columns."""
    new = np.ones(table.num_rows, bool)
    if len(new) > 1:
        new[1:] = False
        for n in names:
            column = table.column(n).combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


STRETCH_KEY = ("seed", "lead", "windows", "part")


def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal stretches, which come one after the other: all are done if there are two (or one of a text with copies),
    and one goes on as a stretch that is repeated anyhow and asks for no answer (alone is false). Rows that were done
    before stay so."""

    def out(table: pa.Table, alone: np.ndarray, done: bool) -> pa.Table:
        table = table.set_column(table.schema.get_field_index("alone"), "alone", pa.array(alone))
        return table.append_column("done", pa.array(np.full(table.num_rows, done)))

    held: pa.Table | None = None
    for batch in batches:
        table = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        new, alone = run_starts(table, STRETCH_KEY), table.column("alone").to_numpy()
        first, name = np.flatnonzero(new), np.cumsum(new) - 1
        repeated = np.diff(np.append(first, len(new))) > 1
        repeated[name[~alone]] = True
        gone = np.flatnonzero(repeated[name] & alone)
        yield from out(table.take(pa.array(gone)), alone[gone], True).to_batches()
        on = table.take(pa.array(first))
        goes = alone[first] & ~repeated
        yield from out(on.slice(0, len(first) - 1), goes[:-1], False).to_batches()
        held = on.slice(len(first) - 1).set_column(on.schema.get_field_index("alone"), "alone", pa.array(goes[-1:]))
    if held is not None:
        yield from out(held, held.column("alone").to_numpy(), False).to_batches()


def _cut_out(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[begin:end] for each pair, as binary."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[at])]).cast(pa.binary())


def _in_turn(some: np.ndarray, kind: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """some, whole kinds together, in parts of RESOLVED windows or one kind."""
    cuts = np.append(np.flatnonzero(np.concatenate([np.ones(min(1, len(some)), bool), np.diff(kind[some]) != 0])), len(some))
    before, begin = np.concatenate([[0], np.cumsum(windows[some])]), 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        if before[b] - before[begin] > RESOLVED and a > begin:
            yield some[begin:a]
            begin = a
    if begin < len(some):
        yield some[begin:]


@dataclass(frozen=True)
class Finder:
    window: int
    gram: int
    tokenize: Tokenize
    exactly: Callable[[np.ndarray, Tokens], np.ndarray]
    resolve: Resolve

    def anchors(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows with the same anchor: anchor's fingerprint and token, first window, windows, and the text."""
        parts: list[tuple[np.ndarray, ...]] = []
        at, n = 0, len(bounds) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STRETCH, "right")) - 1)
            if bounds[end] - bounds[at] <= STRETCH:
                parts.append(self._anchors(values, bounds[at : end + 1], at))
            else:  # one long text, in stretches that overlap by all but one token of a window
                for a in range(int(bounds[at]), int(bounds[end]) - self.window + 1, STRETCH):
                    b = min(int(bounds[end]), a + STRETCH + self.window - 1)
                    parts.append(self._anchors(values, np.array([a, b]), at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)

    def _anchors(self, values: np.ndarray, bounds: np.ndarray, text: int) -> tuple[np.ndarray, ...]:
        base, own = int(bounds[0]), values[bounds[0] : bounds[-1]]
        n = len(own) - self.window + 1
        if n < 1:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
        prints = Prints(own).every(self.gram)
        least = (prints & ~MASK) | np.arange(len(prints), dtype=np.uint64)
        width, span = self.window - self.gram + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & MASK).astype(np.int64)
        ends = np.repeat(bounds[1:] - base, np.diff(bounds))
        window = np.flatnonzero(np.arange(n) + self.window <= ends[:n])
        if not len(window):
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[window]) != 0) | (np.diff(window) != 1)]))
        count = np.diff(np.append(first, len(window)))
        start = window[first]
        return prints[anchor[start]], anchor[start] + base, start + base, count, np.searchsorted(bounds - base, start, "right") - 1 + text

    def texts(self, docs: DataFrame) -> DataFrame:
        """th, text, copies: a row for each different text."""
        rows = docs.select(digest(F.col("text")).alias("th"), whole_text(F.col("text")).alias("text"))
        return rows.groupBy("th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def _sliced(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Tokens]]:
        raw, off = utf8(batch.column("text"))
        for i, j in runs_of(off, SLICE):
            part = raw[off[i] : off[j]]
            yield i, j, part, self.tokenize(part, off[i : j + 1] - off[i])

    def covered(self, texts: DataFrame) -> DataFrame:
        """th, first, last: stretches of tokens covered by repeated windows of texts that have one copy."""

        def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                th = batch.column("th")
                for i, _, _, t in self._sliced(batch):
                    seed, _, _, _, text = self.anchors(t.values, t.bounds)
                    order = np.lexsort((seed, text))
                    seed, text = seed[order], text[order]
                    new = np.concatenate([np.ones(min(1, len(seed)), bool), (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])])
                    first = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays([pa.array(seed[first].view(np.int64)), th.take(pa.array(text[first] + i)), pa.array(np.diff(np.append(first, len(seed))).astype(np.int32))], ["seed", "th", "n"])

        found = texts.mapInArrow(seeds, "seed long, th binary, n int")
        often = found.groupBy("seed").agg(F.sum("n").alias("times")).where("times > 1").select("seed", (F.col("times") > HOT).alias("hot"))
        listed = lambda hot: F.collect_list(F.when(F.col("hot") == hot, F.col("seed")))
        live = found.select("seed", "th").join(often, "seed").groupBy("th").agg(listed(False).alias("cold"), listed(True).alias("hot"))

        def sent(which: str) -> DataFrame:
            lists = live.where(F.size(which) > 0).select("th", F.col(which).alias("seeds"))
            return texts.join(lists, "th").mapInArrow(self._sender(which == "hot"), STRETCH_ROW)

        def judged(stretches: DataFrame) -> DataFrame:
            return stretches.repartition("seed").sortWithinPartitions(*STRETCH_KEY).mapInArrow(self._judge, "th binary, first long, last long")

        salted = sent("hot").withColumn("salt", F.pmod(F.xxhash64("th", "first"), F.lit(SALTS))).repartition("seed", "salt")
        fewer = salted.sortWithinPartitions("seed", "salt", *STRETCH_KEY[1:]).drop("salt").mapInArrow(collapsed, f"{STRETCH_ROW}, done boolean")
        known = fewer.where("done").select("th", "first", (F.col("first") + F.col("windows") - 1 + self.window).alias("last"))
        more = fewer.where("not done").drop("done")
        return judged(sent("cold").unionByName(more)).unionByName(known)

    def _sender(self, hot: bool):
        """A mapInArrow function: the stretches of a text's live anchors, those of hot ones in cells."""
        step = max(1, self.window // 8)
        core = self.window - step + 1

        def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                th, alone, wanted = batch.column("th"), batch.column("copies").to_numpy() == 1, batch.column("seeds")
                for i, j, part, t in self._sliced(batch):
                    seed, anchor, start, count, text = self.anchors(t.values, t.bounds)
                    lists = wanted.slice(i, j - i)
                    owner = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy()).astype(np.uint64)
                    keep = np.isin(seed ^ mixed(text.astype(np.uint64)), lists.flatten().to_numpy().view(np.uint64) ^ mixed(owner))
                    seed, anchor, start, count, text = (x[keep] for x in (seed, anchor, start, count, text))
                    if hot and len(seed):
                        whose = np.repeat(np.arange(len(seed)), count)
                        window = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + start[whose]
                        cell = (anchor[whose] - window) // step
                        first = np.flatnonzero(np.concatenate([[True], (np.diff(whose) != 0) | (np.diff(cell) != 0)]))
                        whose, start, cell, count = whose[first], window[first], cell[first], np.diff(np.append(first, len(window)))
                        seed, anchor, text = seed[whose], anchor[whose], text[whose]
                        seed = mixed(seed + mixed(cell.astype(np.uint64))) ^ Prints(t.values).at(anchor - cell * step, core)
                    begin, end = t.starts[start], t.ends[start + count + self.window - 2]
                    columns = [pa.array(seed.view(np.int64)), th.take(pa.array(text + i)), pa.array(start - t.bounds[text]), pa.array((anchor - start).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(alone[text + i]), _cut_out(part, begin, end)]
                    yield pa.RecordBatch.from_arrays(columns, ["seed", "th", "first", "lead", "windows", "alone", "part"])

        return stretches

    def _judge(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches come in the order of their anchors, and are judged when an anchor is complete."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GATHERED:
                continue
            table = pa.Table.from_batches(held)
            seed = table.column("seed").to_numpy()
            changes = np.flatnonzero(seed[1:] != seed[:-1]) + 1  # in this order equal ones are together
            if len(changes):
                yield from self._judged(table.slice(0, int(changes[-1])))
                held = table.slice(int(changes[-1])).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from self._judged(pa.Table.from_batches(held))

    def _judged(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        # equal stretches are one, and two equal stretches are repeated as they are
        new = run_starts(rows, STRETCH_KEY)
        seed, first, lead, windows, alone = (rows.column(n).to_numpy() for n in ("seed", "first", "lead", "windows", "alone"))
        same, one = np.cumsum(new) - 1, np.flatnonzero(new)
        whole = np.diff(np.append(one, len(new))) > 1
        whole[same[~alone]] = True
        kind = np.cumsum(np.concatenate([[True], np.diff(seed[one]) != 0])) - 1
        n = windows[one].astype(np.int64)
        owner, begin, end = [np.flatnonzero(whole)], [np.zeros(int(whole.sum()), np.int64)], [n[whole] + self.window - 1]
        open_ = np.flatnonzero((np.bincount(kind) > 1)[kind])  # other stretches have the same anchor
        for some in _in_turn(open_, kind, n):
            raw, bounds = utf8(rows.column("part").combine_chunks().take(pa.array(one[some])))
            t = self.tokenize(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
            start = t.bounds[:-1]
            got = self.resolve(t.values, self.exactly(raw[bounds[0] : bounds[-1]], t), start, start + lead[one[some]], n[some], kind[some])
            whose = np.repeat(some, n[some])
            got &= ~whole[whose]
            inside = np.arange(len(whose)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            before = np.concatenate([[False], got[:-1] & (whose[1:] == whose[:-1])])
            after = np.concatenate([got[1:] & (whose[1:] == whose[:-1]), [False]])
            opens, closes = np.flatnonzero(got & ~before), np.flatnonzero(got & ~after)
            owner.append(whose[opens])
            begin.append(inside[opens])
            end.append(inside[closes] + self.window)
        owner, begin, end = (np.concatenate(x) for x in (owner, begin, end))
        order = np.argsort(owner, kind="stable")
        owner, begin, end = owner[order], begin[order], end[order]
        asked = np.flatnonzero(alone)  # texts with copies are removed whole
        at, many = np.searchsorted(owner, same[asked]), np.bincount(owner, minlength=len(one))[same[asked]]
        row = np.repeat(asked, many)
        if len(row):
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at, many)
            yield from pa.table({"th": rows.column("th").take(pa.array(row)), "first": first[row] + begin[place], "last": first[row] + end[place]}).to_batches()

    def removed(self, docs: DataFrame, by_words: bool) -> DataFrame:
        """th, n_tokens, n_removed, n_spans, kept (what is left), one row for each different text.

        by_words: what is left are words joined by a space; otherwise it is bytes in a row.
        """
        texts = self.texts(docs)
        spans = self.covered(texts).groupBy("th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                th, copies, spans = batch.column("th"), batch.column("copies").to_numpy(), batch.column("spans")
                for i, j, part, t in self._sliced(batch):
                    out: list[list] = [[], [], [], []]
                    for r in range(i, j):
                        a, b = t.bounds[r - i], t.bounds[r - i + 1]
                        n, gone = int(b - a), None
                        if copies[r] > 1 and n >= self.window:
                            gone = np.ones(n, bool)
                        elif spans[r].is_valid:
                            flat = spans[r].values
                            edge = np.zeros(n + 1, np.int64)
                            np.add.at(edge, flat.field("first").to_numpy(), 1)
                            np.add.at(edge, flat.field("last").to_numpy(), -1)
                            gone = np.cumsum(edge[:-1]) > 0
                        left = np.ones(n, bool) if gone is None else ~gone
                        spans_of = 0 if gone is None else int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
                        if by_words:
                            data = part[t.starts[a] : t.ends[b - 1]].tobytes().split() if n else []
                            kept = b" ".join([w for w, x in zip(data, left, strict=True) if x])
                        else:
                            kept = part[a:b][left].tobytes()
                        for column, value in zip(out, (n, n - int(left.sum()), spans_of, kept), strict=True):
                            column.append(value)
                    columns = [th.slice(i, j - i), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())] if by_words else [th.slice(i, j - i), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["th", "n_tokens", "n_removed", "n_spans", "kept"])

        return texts.join(spans, "th", "left").mapInArrow(cut, f"th binary, n_tokens long, n_removed long, n_spans long, kept {'string' if by_words else 'binary'}")

    def by_document(self, docs: DataFrame, by_words: bool, digests: bool = False) -> DataFrame:
        """doc_id and the columns of removed(); with digests, kept_sha256 in place of kept."""
        result = self.removed(docs, by_words)
        if digests:
            result = result.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("th"))
        return ids.join(result, "th").drop("th")
