"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: what it must contain in any match. The
index is a written table of postings (trigram, row) without any text, over the trigrams that the queries name. The
postings lists of a query's clause are intersected to candidate rows, and the expression itself runs on those only, in
the texts where they are read: no text is moved or hashed to find or verify a candidate. A rule without a mandatory
trigram scans every text. Rows are named by file and index, and candidates go to the scan as bitmaps of 32 768 rows; where
these are more than may be broadcast at once, files are read in groups, each with the bitmaps of its own.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, scan_of, shared_dir, whole_text

Clauses = frozenset[frozenset[str]]
#: Strings that a part of an expression may stand for are listed up to so many; beyond, the part counts as unknown.
MOST_STRINGS = 64
#: Bitmaps (4 KB for each rule and 32 768 rows) that are broadcast at once, about.
MOST_MARKS = 8_192
#: Matches whose offsets are added up together.
BLOCK = 512


@dataclass(frozen=True)
class Rule:
    """kind and pattern; of a match, group has least characters at least, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values of the contract. A run of hex digits or of access-key characters is maximal, so that the least length
#: can stand in the pattern; the assignment's value must be matched first and judged after.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def trigram_query(pattern: str) -> Clauses:
    """Mandatory trigrams of any match, in lower case, as an OR of ANDs; empty: nothing is mandatory."""
    clauses: list[Clauses] = []

    def product(a: set[str], b: set[str] | None) -> set[str] | None:
        return None if b is None or len(a) * len(b) > MOST_STRINGS else {x + y for x in a for y in b}

    def listed(node) -> set[str] | None:
        """All strings that a node may stand for, or None."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    out.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return all_of(arg[-1])
        if op is sre.BRANCH:
            parts = [all_of(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4 and (once := all_of(arg[2])) is not None:
            out, power = set(), {""}
            for n in range(int(arg[1]) + 1):
                out |= power if n >= arg[0] else set()
                power = product(power, once)
                if power is None:
                    return None
            return out
        return {""} if op is sre.AT else None

    def all_of(nodes) -> set[str] | None:
        out: set[str] | None = {""}
        for x in nodes:
            out = product(out, listed(x)) if out is not None else None
        return out

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(frozenset(x for x in found if not any(y < x for y in found)))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            more = product(run, listed(node))
            if more is not None:
                run = more
                continue
            flush(run)
            run = {""}
            op, arg = node
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
        flush(run)

    walk(sre_parser.parse(pattern))
    # all parts are mandatory: the one with the fewest alternatives is enough, as any of them is sound
    return min(clauses, key=len, default=frozenset())


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, at) for every trigram of the list that a row's text holds in lower case; no text."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in trigrams]))
    return rows.select("at", F.explode(held).alias("trigram")).select("trigram", "at")


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """at and kinds (an array) of the rows that satisfy a rule's trigram query.

    A clause's postings lists are intersected by counting, for each row and clause, in how many of the clause's lists
    the row is: a pre-aggregated sum keyed by row and clause, so that no list, however long, meets in one task.
    """
    clauses = [(n, kind, sorted(clause)) for n, (kind, clause) in enumerate((k, c) for k, q in sorted(queries.items()) for c in sorted(q, key=sorted))]
    lists = index.sparkSession.createDataFrame([(t, n) for n, _, clause in clauses for t in clause], "trigram string, clause int")
    length = index.sparkSession.createDataFrame([(n, kind, len(clause)) for n, kind, clause in clauses], "clause int, kind string, lists long")
    # both have a row for each trigram or clause of the rules, whatever the input
    met = index.join(F.broadcast(lists), "trigram").groupBy("at", "clause").agg(F.count(F.lit(1)).alias("lists"))
    return met.join(F.broadcast(length), ["clause", "lists"]).groupBy("at").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, in code points: what lies between the matches, and the
    matches themselves, are measured in turn. Lengths are added up in blocks, and blocks' sums after one another, so the
    work grows with the matches, not with their square."""
    pattern = F.lit(rule.pattern)
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    one = "struct<start: int, kind: int, end: int>"

    def measured(w: Column) -> Column:
        parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), judged.alias("judged"))
        return F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["whole"]).alias("size"), (F.length(p["judged"]) >= rule.least).alias("keep")))

    def add(done: Column, part: Column) -> Column:
        begin = done["at"] + part["gap"]
        end = begin + part["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["keep"], F.concat(done["found"], span)).otherwise(done["found"]).alias("found"))

    def blocks(lengths: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("found"))
        return F.transform(cut, lambda block: F.aggregate(block, start, add))

    def whole_offsets(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from"))
        before = F.aggregate(block, start, lambda done, b: F.struct((done["at"] + b["at"]).alias("at"), F.concat(done["from"], F.array(done["at"])).alias("from")))
        moved = lambda b, by: F.transform(b["found"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
        return _let(before, lambda at: F.flatten(F.transform(block, lambda b, i: moved(b, F.get(at["from"], i)))))

    return _let(_let(whole, measured), lambda lengths: F.when(F.size(lengths) > 0, _let(blocks(lengths), whole_offsets)).otherwise(F.array().cast(f"array<{one}>")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, most_marks: int | None = None) -> DataFrame:
    """doc_id and spans: array<struct<start, kind, end>>, ordered by start and then kind (its place among the rules).

    docs: doc_id, text; other columns are not read. Null text counts as empty and has no spans. Rows are told apart by
    file and index, whatever their ids: null ids and rows that repeat each give a result row. An empty table gives an
    empty result. Offsets are code points, end exclusive.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")

    def verified(candidate: Callable[[Rule], Column]) -> Column:
        found = [F.when(candidate(r) & F.col("text").rlike(r.pattern), _spans(r, i, F.col("text"))).otherwise(none) for i, r in enumerate(rules)]
        return F.array_sort(F.concat(*found)) if found else none

    if not queries:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
        return rows.select("doc_id", verified(lambda rule: F.lit(True)).alias("spans"))
    base = shared_dir(docs.sparkSession)
    scan, file, row = located(scan_of(docs, ("doc_id", "text")).docs)
    rows = scan.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"), F.struct(F.xxhash64(file).alias("file"), F.col(row).alias("row")).alias("at"))
    index = materialize(postings(rows, sorted({t for q in queries.values() for c in q for t in c})), f"{base}/postings")
    # a file's name is a hash; should two share one, rows of both are candidates, and are verified
    bit = F.bitmap_bit_position(F.col("at.row"))
    marks = [F.bitmap_construct_agg(F.when(F.array_contains("kinds", kind), bit)).alias(f"m{i}") for i, kind in enumerate(queries)]
    chosen = candidates(index, queries).groupBy(F.col("at.file").alias("in"), F.bitmap_bucket_number(F.col("at.row")).alias("bucket")).agg(*marks)
    chosen = materialize(chosen, f"{base}/candidates")
    groups = max(1, -(-chosen.count() // (MOST_MARKS if most_marks is None else most_marks)))

    def marked(rule: Rule) -> Column:
        if rule.kind not in queries:
            return F.lit(True)
        held = F.col(f"m{list(queries).index(rule.kind)}")
        byte = F.conv(F.hex(F.substr(held, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), bit % 8)), F.lit(2)) == 1, F.lit(False))

    parts = []
    for g in range(groups):
        own = lambda c, g=g: F.pmod(c, F.lit(groups)) == g if groups > 1 else F.lit(True)
        same = (F.col("at.file") == F.col("in")) & (F.bitmap_bucket_number(F.col("at.row")) == F.col("bucket"))
        maybe = rows.where(own(F.col("at.file"))).join(F.broadcast(chosen.where(own(F.col("in")))), same, "left")
        parts.append(maybe.select("doc_id", verified(marked).alias("spans")))
    return reduce(DataFrame.unionByName, parts)


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
