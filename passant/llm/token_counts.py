"""Token counts by a compiled finite-state tokenizer.

A byte-pair encoding is a left-to-right deterministic process: the last token of each prefix's encoding is the
longest vocabulary token that ends there and that is compatible with the last token before it. What the future
needs of a prefix is finite: for each place from which a vocabulary token may still reach beyond the prefix, the
last token before that place and how many tokens lie between it and the prefix. That tuple is the state of the
transducer; a transition reads one character and carries the change of the token count, which may be negative
while a longer token is still open. States are numbered and compiled when first met, and kept.

Runs of spaces merge last and share one score. Their tokens as a function of their length are compiled to a table, which
repeats with a period; so a run is a chain of states that ends in a cycle. Whether a run's last space stays with it depends on the
word behind it: states of such a word carry what the count changes by as long as its first token is a lone space mark.

Between two characters that are neighbours in no vocabulary token every encoding has a cut, and the transition is that
of the start state. A chunk of text maps states to states with a count of tokens. Its map holds the states that can be at its
start: one, if there is a cut shortly before it, found by walking from there; else those that the chunk before it ends
in. Maps compose by looking up one's ends in the other, and a document's chunks by a tree-shaped prefix scan; chunks of
one document may be counted by different tasks.
"""

from __future__ import annotations

import ast
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, scan_of, whole_text

SPACE = "▁"
CACHE_STATES = 150_000
#: Characters in a chunk, and how many before it are looked at for a cut.
CHUNK, LOOK_BACK = 1 << 16, 4096


def _vocabulary(model_file: str) -> tuple[dict[str, float], bool]:
    """Ordinary pieces with their scores; control, unknown and byte pieces are never matched in a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
    return pieces, any(sp.is_byte(i) for i in range(sp.get_piece_size()))


def merge_order(symbols: str, score: dict[str, float], parts: int = 1) -> list[str]:
    """Plain byte-pair merging, best score first and leftmost among equals, down to so many parts at least.

    It serves to compile the transducer, not to count texts.
    """
    part: list[str | None] = list(symbols)
    left = list(range(-1, len(part) - 1))
    right = [*range(1, len(part)), -1]
    heap: list[tuple[float, int, int, str]] = []
    remain = len(part)

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (both := part[i] + part[j]) in score:
            heapq.heappush(heap, (-score[both], i, j, both))

    for i in range(len(part) - 1):
        offer(i, i + 1)
    while heap and remain > parts:
        _, i, j, both = heapq.heappop(heap)
        if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        remain -= 1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [p for p in part if p is not None]


#: In a state (places, change): places (text since, last token before, tokens since, whether the word's first token is a lone
#: space mark), longest text first; change: what a lone mark adds to the count. In a run of spaces: its length.
State = tuple
#: state before a chunk -> (state after it, tokens).
ChunkMap = dict[State, tuple[State, int]]


class Transducer:
    """A deterministic transducer whose transitions carry emitted-token counts; see the module's text."""

    START: State = ((("", "", 0, False),), 0)

    def __init__(self, score: dict[str, float], byte_fallback: bool):
        self.fallback = byte_fallback
        self.inside = {a + b for p in score for a, b in zip(p, p[1:], strict=False)}
        runs = {p: s for p, s in score.items() if set(p) == {SPACE}}
        self.words = {p: s for p, s in score.items() if len(p) == 1 or p not in runs}
        #: The last merge of every token that merging can reach, and when it comes; single characters come first.
        self.made_of: dict[str, tuple[str, str] | None] = {}
        self.turn: dict[str, float] = {}
        for p in self.words:
            if len(p) == 1:
                self.made_of[p], self.turn[p] = None, float("-inf")
            elif len(two := merge_order(p, self.words, 2)) == 2:
                self.made_of[p], self.turn[p] = (two[0], two[1]), -self.words[p]
        self.prefixes = {p[:i] for p in self.made_of for i in range(1, len(p))}
        self.of_run, self.period, self.longest_run = self._runs(runs)
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def _runs(self, runs: dict[str, float]) -> tuple[list[int], int, int]:
        """Tokens of a run of n spaces, the period with which they repeat but for a constant, and a length from which on a
        run may be taken for one that is a period shorter."""
        most = max(map(len, runs), default=1)
        tokens = [0] + [len(merge_order(SPACE * n, runs)) for n in range(1, 8 * most + 2)]
        for period in range(1, most + 1):
            step = {tokens[n + period] - tokens[n] for n in range(most, len(tokens) - period)}
            if len(step) == 1:
                return tokens, period, 2 * most + period
        raise ValueError("runs of spaces have no period in this vocabulary")

    def forget(self) -> None:
        """Bound the memory: forget all compiled states; they are compiled again when met."""
        self.states: list[State] = []
        self.numbers: dict[State, int] = {}
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.fits.clear()
        self.start = self.number(self.START)
        self.one_space = self._read(self.START[0], SPACE)[0]
        self.space = self.number((self._plain(self.one_space), 0))

    def number(self, state: State) -> int:
        """The number of a state."""
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.edges.append({})
        return known

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves token b behind token a as they are: undo both tokens' merges, latest first, and look
        at each moment for a merge over the border that would have come before the one just undone."""
        if not a or a not in self.made_of:
            return True
        known = self.fits.get((a, b))
        if known is None:
            x, y, before, ties = a, b, float("inf"), False
            while True:
                over = self.words.get(x + y)
                if over is not None and (-over < before or ties and -over == before):
                    known = False
                    break
                if self.made_of[x] is None and self.made_of[y] is None:
                    known = True
                    break
                if self.turn[x] > self.turn[y]:  # equal merges go from left to right, so the border's comes after x's
                    before, ties, x = self.turn[x], False, self.made_of[x][1]
                else:
                    before, ties, y = self.turn[y], True, self.made_of[y][0]
            self.fits[a, b] = known
        return known

    def _width(self, c: str) -> int:
        """Tokens for a character outside the vocabulary."""
        return len(c.encode("utf-8", "surrogatepass")) if self.fallback else 1

    @staticmethod
    def _plain(places: tuple) -> tuple:
        return tuple((since, before, tokens, False) for since, before, tokens, _ in places)

    def _read(self, places: tuple, c: str) -> tuple[tuple, int]:
        """The places after c, and the change of the count."""
        last, total, lone = c, None, False
        for since, before, tokens, alone in places:  # the longest text first
            if (token := since + c) in self.made_of and self._compatible(before, token):
                last, total, lone = token, 1 - tokens, token == SPACE if not before else alone
                break
        if total is None:  # outside the vocabulary: a single character always ends a token
            total, lone = self._width(c) - places[-1][2], bool(places[-1][1]) and places[-1][3]
        still_open = [(since + c, before, tokens + total, alone) for since, before, tokens, alone in places if since + c in self.prefixes]
        return (*still_open, ("", last, 0, lone)), total

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition for c."""
        now = self.states[state]
        run = now[0] if isinstance(now[0], int) else int(state == self.space)
        if run and c == SPACE:
            change = self.of_run[run + 1] - self.of_run[run]
            found = self.number((run + 1 if run + 1 < self.longest_run else run + 1 - self.period,)), change
        elif state != self.start and (SPACE if run else now[0][-1][1][-1]) + c not in self.inside:
            found = self.edges[self.start].get(c) or self._compile(self.start, c)  # a cut
        else:
            places, lone = (self.one_space, self.of_run[run] - 1 - self.of_run[run - 1]) if run > 1 else now
            after, change = self._read(places, c)
            if run > 1:
                change += lone * (after[-1][3] - 1)
            else:
                change += lone * (after[-1][3] - places[-1][3])
            settled = not lone or len({p[3] for p in after}) == 1 and all(p[1] for p in after)  # it can't change any more
            found = self.number((self._plain(after), 0) if settled else (after, lone)), change
        self.edges[state][c] = found
        return found

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """The state after a text, and its tokens."""
        tokens, edges = 0, self.edges
        for c in text:
            edge = edges[state].get(c)
            state, change = self._compile(state, c) if edge is None else edge
            tokens += change
        return state, tokens

    def before(self, text: str, whole: bool) -> int | None:
        """The state after what ends in text, if there is a cut in it or it is whole."""
        for i in range(len(text) - 1, 0, -1):
            if text[i - 1] + text[i] not in self.inside:
                return self.walk(self.start, text[i:])[0]
        return self.walk(self.start, text)[0] if whole else None

    def chunk_map(self, text: str, before: list[int]) -> dict[int, tuple[int, int]]:
        """How a chunk acts on the states that can be before it."""
        return {state: self.walk(state, text) for state in before}

    @staticmethod
    def compose(a: dict, b: dict) -> dict:
        """The map of a followed by b; associative. b has all states that a ends in."""
        return {state: (b[after][0], tokens + b[after][1]) for state, (after, tokens) in a.items()}

    def scan(self, maps: list[dict]) -> dict:
        """Tree-shaped composition of a sequence of maps."""
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + ([maps[-1]] if len(maps) % 2 else [])
        return maps[0]

    def maps(self, text: str, chunk: int, first: int) -> list[dict[int, tuple[int, int]]]:
        """The maps of a text's chunks, of which the first may have one state before it."""
        out = [self.chunk_map(text[:chunk], [first])]
        for i in range(chunk, len(text), chunk):
            known = self.before(text[max(0, i - LOOK_BACK) : i], False)
            out.append(self.chunk_map(text[i : i + chunk], sorted({after for after, _ in out[-1].values()}) if known is None else [known]))
        return out

    @staticmethod
    def prepare(text: str) -> str:
        """The model's normalisation: spaces become marks, a mark is put in front of a text that isn't empty."""
        return (SPACE + text).replace(" ", SPACE) if text else ""

    def count(self, text: str, chunk: int | None = None) -> int:
        if len(self.states) > CACHE_STATES:
            self.forget()
        text = self.prepare(text)
        return self.scan(self.maps(text, chunk or CHUNK, self.start))[self.start][1] if text else 0


_COMPILED: dict[str, Transducer] = {}


def transducer(model_file: str) -> Transducer:
    """The transducer of a sentencepiece BPE model (identity normalisation, mark in front), kept in each worker."""
    if model_file not in _COMPILED:
        _COMPILED[model_file] = Transducer(*_vocabulary(model_file))
    return _COMPILED[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, long_chars: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns are not read).

    Null text counts as empty; an empty text has 0 bytes and 0 tokens. A null doc_id stays null, repeated rows each
    give a row, an empty table gives an empty result. Texts over long_chars characters are dealt out as chunks, so
    that no task holds more than a chunk of them beside the row itself; others are counted where they are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            texts = batch.column(1)
            n_bytes, n_tokens = [], []
            for x in texts:
                text = x.as_py()
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(t.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    short = rows.where(F.length("text") <= long_chars).mapInArrow(count, schema)
    return short.unionByName(_count_long(docs, model_file, limit, long_chars))


def _count_long(docs: DataFrame, model_file: str, limit: int, chunk: int) -> DataFrame:
    """The same for very long texts: a row for each chunk, with what lies just before it; maps meet again by file and row."""
    scan, file, row = located(scan_of(docs, ("doc_id", "text")).docs)
    long = scan.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), F.col("text").cast("string").alias("text")).where(F.length("text") > chunk)
    at = F.expr(f"explode(sequence(0, cast((length(text) - 1) div {chunk} as int)))")
    chunks = long.select("doc_id", "file", "row", F.octet_length("text").cast("long").alias("n_bytes"), at.alias("at"), "text")
    look = F.least(F.lit(LOOK_BACK), F.col("at") * chunk)
    chunks = chunks.select("doc_id", "file", "row", "n_bytes", "at", F.substr("text", F.col("at") * chunk - look + 1, look).alias("back"), F.expr(f"substring(text, at * {chunk} + 1, {chunk})").alias("part"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            maps = []
            for at, back, part in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                if len(t.states) > CACHE_STATES:
                    t.forget()
                text = part.replace(" ", SPACE)
                back = back.replace(" ", SPACE)
                begin = t.start if at == 0 else t.before(SPACE + back if at * chunk <= LOOK_BACK else back, at * chunk <= LOOK_BACK)
                if begin is None:  # no cut for so long: it is walked when the state before it is known
                    maps.append({"before": None, "after": text, "tokens": 0})
                    continue
                after, tokens = t.scan(t.maps(SPACE + text if at == 0 else text, CHUNK, begin))[begin]
                maps.append({"before": repr(t.states[begin]), "after": repr(t.states[after]), "tokens": tokens})
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(maps, pa.struct([("before", pa.string()), ("after", pa.string()), ("tokens", pa.int64())]))], [*batch.schema.names[:5], "map"])

    mapped = chunks.mapInArrow(act, "doc_id long, file string, row long, n_bytes long, at int, map struct<before: string, after: string, tokens: long>")
    # a document's maps are few and small: a row for each chunk of millions of characters
    whole = mapped.groupBy("file", "row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("at", "map"))).alias("maps")).select("doc_id", "n_bytes", "maps")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            totals = []
            for maps in batch.column(2).to_pylist():
                state, total = repr(t.START), 0
                for m in (m["map"] for m in maps):
                    if m["before"] is None:
                        after, tokens = t.walk(t.number(ast.literal_eval(state)), m["after"])
                        state, total = repr(t.states[after]), total + tokens
                    elif m["before"] == state:
                        state, total = m["after"], total + m["tokens"]
                    else:
                        raise ValueError("a chunk's map doesn't begin where the one before it ends")
                totals.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return whole.mapInArrow(finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
