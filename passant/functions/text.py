"""Text scalars as Column expressions. Word characters are letters, numbers and underscore of any script."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The retrieval stop words.
STOPWORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its itself just me more most my no nor not now "
    "of off on once only or other our out over own same she should so some such than that the their them "
    "then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your".split()
)
# The stop words of content tokens.
CONTENT_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "of", "in", "on",
    "at", "to", "for", "and", "or", "this", "that", "these", "those", "it", "as",
    "by", "with", "from", "here", "there", "which", "what", "who", "where", "when",
)
# Question openings, tried in this order.
QUESTION_PREFIXES = (
    "what is", "what are", "what was", "what were", "who is", "who was",
    "who are", "where is", "where was", "where are", "when is", "when was",
    "when did", "how many", "how much", "how did", "how does", "which",
    "why is", "why did", "why does",
)
# Prompt texts.
ANSWER_HEAD = "Answer the question as briefly as possible, with just the answer span and no explanation.\n\n"
HYDE_HEAD = "Write exactly one short factual sentence that directly answers the question. Do not add explanation.\n"
UTILITY_DEFINITION = (
    "Determine if the passage has utility based on two criteria: 1. Usefulness: The passage must be relevant "
    "and contribute to generating a correct, reasonable, and complete answer. 2. Novelty: The useful "
    "information should be new, not part of your pre-existing knowledge."
)
SENTENCE_HEAD = "Answer the following question in one sentence.\n"
SENTENCE_CONTEXT_HEAD = "Use the following context to answer the question in one sentence.\n"
WORD = r"[\p{L}\p{N}_]+"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def tokenize(text: Column) -> Column:
    """Lower-case words without stop words, in order, repeats kept."""
    stop = list(STOPWORDS)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(stop))


def query_terms(query: Column) -> Column:
    return F.array_distinct(tokenize(query))


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_length(text: Column) -> Column:
    return F.size(words(text))


def readability(text: Column) -> Column:
    """Flesch-Kincaid grade with counted heuristics: sentences are runs of . ! ? (one at least), syllables are vowel
    groups of the whole text, and at least one for each word."""
    n_words = F.greatest(token_length(text), F.lit(1)).cast("double")
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1)).cast("double")
    syllables = F.greatest(F.regexp_count(F.lower(text), F.lit("[aeiouy]+")), n_words).cast("double")
    return F.lit(0.39) * n_words / sentences + F.lit(11.8) * syllables / n_words - F.lit(15.59)


def entities(text: Column) -> Column:
    """Distinct lower-case words without ASCII punctuation: what stands in for named entities where there is no model."""
    return F.array_distinct(words(F.lower(F.regexp_replace(text, r"\p{Punct}", ""))))


def share_of(needed: Column, present: Column) -> Column:
    """The share of the set `needed` that is in `present`; 0 for an empty set."""
    return F.size(F.array_intersect(needed, present)) / F.greatest(F.size(needed), F.lit(1)).cast("double")


def content_tokens(text: Column) -> Column:
    stop = list(CONTENT_STOPWORDS)
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_distinct(F.filter(words(spaced), lambda w: (F.length(w) > 1) & ~w.isin(stop)))


def answerability(claim: Column, passage: Column) -> Column:
    return F.coalesce(share_of(content_tokens(claim), content_tokens(passage)), F.lit(0.0))


def statement(query: Column) -> Column:
    """A declarative stub for a question."""
    q = F.trim(F.regexp_replace(F.trim(query), r"\?+$", ""))
    out = F.concat(F.lit("This text answers the question: "), q, F.lit("."))
    for prefix in reversed(QUESTION_PREFIXES):
        rest = F.trim(F.substring(q, len(prefix) + 1, 1 << 30))
        told = F.when(rest == "", F.concat(F.lit("This text answers: "), q, F.lit("."))).otherwise(F.concat(rest, F.lit(" is described in this text.")))
        out = F.when(F.lower(q).startswith(prefix), told).otherwise(out)
    return out


def first_line(answer: Column, query: Column) -> Column:
    line = F.trim(F.split_part(F.trim(answer), F.lit("\n"), F.lit(1)))
    return F.coalesce(F.nullif(line, F.lit("")), statement(query))


def normalize(text: Column) -> Column:
    """Answer normalisation of a text in decomposed Unicode form (ASCII always is): lower case, no articles, no ASCII
    punctuation, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{Punct}", ""), r"\s+", " "))


def normal_tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def is_yes_no(answers: Column) -> Column:
    return F.exists(answers, lambda a: F.lower(F.trim(a)).isin("yes", "no"))


def all_yes_no(normal_golds: Column) -> Column:
    return F.forall(F.filter(normal_golds, lambda g: g != ""), lambda g: g.isin("yes", "no"))


def contains_span(normal_text: Column, normal_needle: Column) -> Column:
    """Whether a token sequence is a contiguous part of another; an empty one never is."""
    return (normal_needle != "") & F.contains(F.concat(F.lit(" "), normal_text, F.lit(" ")), F.concat(F.lit(" "), normal_needle, F.lit(" ")))


def exact_match(pred: Column, golds: Column) -> Column:
    """pred and golds are normalised, here and below."""
    return F.exists(golds, lambda g: g == pred).cast("double")


def relaxed_match(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: contains_span(pred, g)).cast("double")


def _f1(pred: Column, gold: Column) -> Column:
    times = lambda tokens, w: F.size(F.filter(tokens, lambda t: t == w))
    common = F.aggregate(F.array_distinct(gold), F.lit(0), lambda n, w: n + F.least(times(pred, w), times(gold, w)))
    total = (F.size(pred) + F.size(gold)).cast("double")
    return F.when((F.size(pred) == 0) | (F.size(gold) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * common / total)


def token_f1(pred: Column, golds: Column) -> Column:
    """The best multiset F1 over the golds."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: _f1(normal_tokens(pred), normal_tokens(g)))), F.lit(0.0))


def combined(pred: Column, golds: Column) -> Column:
    return F.lit(0.5) * exact_match(pred, golds) + F.lit(0.5) * token_f1(pred, golds)


def accuracy(pred: Column, golds: Column) -> Column:
    """Half relaxed match, half token F1."""
    return F.lit(0.5) * relaxed_match(pred, golds) + F.lit(0.5) * token_f1(pred, golds)


def set_f1(pred: Column, ref: Column) -> Column:
    """F1 of the sets of lower-case words of one reference, without normalisation."""
    a, b = F.array_distinct(words(F.lower(pred))), F.array_distinct(words(F.lower(ref)))
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, F.lit(0.0)).otherwise(F.lit(2.0) * common / (F.size(a) + F.size(b)).cast("double"))


def utility(acc_with: Column, acc_without: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), acc_with - acc_without))


def softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def entropy(logits: Column, floor: float = 0.0) -> Column:
    """-sum p log(p + floor); perplexity is its exponential."""
    return -F.aggregate(softmax(logits), F.lit(0.0), lambda a, p: a + F.when(p + floor > 0, p * F.ln(p + F.lit(floor))).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def prefixed(text: Column, kind: str, model: str) -> Column:
    """E5 models want `query: ` or `passage: ` before a text."""
    return F.concat(F.lit(f"{kind}: "), text) if "e5" in model.lower() else text


def parse_ranking(answer: Column, n: Column) -> Column:
    """Scores of passages 1..n from a listwise answer such as [2] > [1]: minus the place, and -n for those not named."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    places = F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x >= 1) & (x <= n)))
    at = lambda i: F.array_position(places, i.cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(at(i) > 0, (F.lit(1) - at(i)).cast("double") + F.lit(0.0)).otherwise(-n.cast("double")))).otherwise(F.array().cast("array<double>"))


#: What a backslash and a letter stand for in a string literal.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": ""}
_STRING = r"""(?:'(?:[^'\\\n]++|\\(?s:.))*+'|"(?:[^"\\\n]++|\\(?s:.))*+")"""
_LITERAL = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?|True|False|None)"
_ITEMS = rf"{_LITERAL}\s*+(?:,\s*+{_LITERAL}\s*+)*+"


def _unescaped(body: Column) -> Column:
    """What stands between the quotes of a string literal: plain stretches and escapes in turn."""
    pieces = F.regexp_extract_all(body, F.lit(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\(?s:.)|[^\\]+"), F.lit(0))

    def meant(piece: Column) -> Column:
        kind, digits = F.substring(piece, 2, 1), F.substring(piece, 3, 8)
        octal = F.lpad(F.conv(F.substring(piece, 2, 3), 8, 16), 4, "0")
        out = F.when(~piece.startswith("\\") | (F.length(piece) < 2), piece)
        for letter, value in _ESCAPES.items():
            out = out.when(piece == "\\" + letter, F.lit(value))
        out = out.when((kind == "x") & (F.length(piece) == 4), F.decode(F.unhex(F.concat(F.lit("00"), digits)), "UTF-16BE"))
        out = out.when((kind == "u") & (F.length(piece) == 12), F.decode(F.unhex(F.concat(F.substring(piece, 3, 4), F.substring(piece, 9, 4))), "UTF-16BE"))  # a pair
        out = out.when(piece.rlike(r"^\\u[dD][89a-fA-F]"), piece)  # half a pair stands for no character
        out = out.when((kind == "u") & (F.length(piece) == 6), F.decode(F.unhex(digits), "UTF-16BE"))
        out = out.when((kind == "U") & (F.length(piece) == 10), F.decode(F.unhex(digits), "UTF-32"))
        return out.when(piece.rlike(r"^\\[0-7]"), F.decode(F.unhex(octal), "UTF-16BE")).otherwise(piece)

    return F.array_join(F.transform(pieces, meant), "")


def parse_golds(text: Column) -> Column:
    """The golds that a text holds: of a literal list or tuple of strings, whole and decimal numbers, True, False or None
    each as a string; of a single string literal what it says; any other text is one gold itself."""
    listed = rf"(?:{_ITEMS}(?:,\s*+)?+)?+"
    whole = text.rlike(rf"^[ \t]*+(?:\[\s*+{listed}\]|\(\s*+{listed}\)|{_ITEMS}(?:,\s*+)?+)\s*+$")
    items = F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0))
    number = lambda x: F.when(x.rlike(r"\."), F.regexp_replace(x, r"(\.[0-9]+?)0+$", "$1")).otherwise(F.when(x == "-0", "0").otherwise(x))
    said = F.transform(items, lambda x: F.when(x.rlike("^['\"]"), _unescaped(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(number(x)))
    return F.when(whole, said).otherwise(F.array(text))


def numbered(passages: Column, label: str = "Passage ") -> Column:
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit(label), (i + 1).cast("string"), F.lit(": "), p)), "\n\n")


def answer_prompt(query: Column, passages: Column) -> Column:
    """The labelling prompt with no, one or several passages."""
    tail = F.concat(F.lit("Question: "), query, F.lit("\nAnswer:"))
    one = F.concat(F.lit("Passage: "), F.try_element_at(passages, F.lit(1)), F.lit("\n\n"))
    several = F.concat(numbered(passages), F.lit("\n\n"))
    return F.concat(F.lit(ANSWER_HEAD), F.when(F.size(passages) == 0, "").when(F.size(passages) == 1, one).otherwise(several), tail)


def hyde_prompt(query: Column) -> Column:
    return F.concat(F.lit(HYDE_HEAD + "Question: "), query, F.lit("\nAnswer:"))


def rag_prompt(query: Column, texts: Column) -> Column:
    context = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuery: "), query)


def sentence_prompt(query: Column, passage: Column | None = None) -> Column:
    """The older one-sentence prompts."""
    asked = F.concat(F.lit("Question: "), query, F.lit("\nAnswer:"))
    if passage is None:
        return F.concat(F.lit(SENTENCE_HEAD), asked)
    return F.concat(F.lit(SENTENCE_CONTEXT_HEAD + "Context: "), passage, F.lit("\n"), asked)


def probe_prompt(query: Column, passage: Column | None = None) -> Column:
    asked = F.concat(F.lit("Query: "), query)
    return asked if passage is None else F.concat(F.lit("Context: "), passage, F.lit("\n"), asked)


def utility_prompt(query: Column, passage: Column, answer: Column | None = None) -> Column:
    """A Yes or No judgment of one passage, with or without a reference answer."""
    ref = F.lit("") if answer is None else F.concat(F.lit("Reference answer: "), answer, F.lit("\n\n"))
    return F.concat(F.lit("Question: "), query, F.lit("\n\nPassage: "), passage, F.lit("\n\n"), ref, F.lit(UTILITY_DEFINITION + "\nAnswer with Yes or No only."))


def bracketed(passages: Column) -> Column:
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")


def ranking_prompt(query: Column, passages: Column, answer: Column) -> Column:
    """A listwise ranking of numbered passages; parse_ranking reads its answer."""
    n = F.size(passages).cast("string")
    return F.concat(
        F.lit("The following are "), n, F.lit(" passages, each indicated by a number identifier [].\n\n"), bracketed(passages), F.lit("\n\nQuestion: "), query, F.lit("\n\nReference answer: "), answer,
        F.lit("\n\nRank the passages by their utility for generating a correct, reasonable and complete answer to the question. List all "), n,
        F.lit(" identifiers in descending order of utility, using the format [2] > [1] > [3]. Only respond with the ranking."),
    )


def pseudo_answer_prompt(query: Column, passages: Column) -> Column:
    """The prompt for an answer from all candidates."""
    return F.concat(F.lit(ANSWER_HEAD), bracketed(passages), F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def spaced_tokens(text: Column) -> Column:
    """Lower-case words where everything but word characters and white space is a space."""
    return words(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")))


def passage_text(title: Column, body: Column) -> Column:
    return F.concat(F.lit('"'), title, F.lit('"\n'), body)


def title_of(contents: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.substring_index(contents, "\n", 1)), r'^"+|"+$', ""))


def body_of(contents: Column) -> Column:
    """Everything after the first newline; empty without one."""
    at = F.instr(contents, "\n")
    return F.when(at > 0, F.substring(contents, at + 1, F.length(contents))).otherwise("")


def uniform(text: Column) -> Column:
    """A hash of a text in [0, 1): the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
