"""Raw question-answering rows to items (dataset, query_id, query, gold_answers, pool, passages), and the registry.

Every parser takes a DataFrame of raw rows and is a projection and a filter; only duplicate questions need a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passant.functions import text as X
from passant.operators.protocol import sample_items
from passant.schemas import PASSAGE

NO_PASSAGES = f"array<{PASSAGE.simpleString()}>"


def _item(dataset: str, idx: Column, query: Column, gold: Column, pool: str, passages: Column | None = None) -> list[Column]:
    return [
        F.lit(dataset).alias("dataset"), F.concat_ws(":", F.lit(dataset), idx.cast("string")).alias("query_id"), query.alias("query"), gold.alias("gold_answers"),
        F.lit(pool).alias("pool"), (passages if passages is not None else F.array()).cast(NO_PASSAGES).alias("passages"),
    ]


def _passage(id_: Column, text: Column, proxy: Column | None = None) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(id_.alias("id"), text.alias("text"), nothing.alias("bm25"), (proxy if proxy is not None else nothing).alias("proxy_label"))


def _golds(golds: Column) -> Column:
    return F.filter(F.transform(golds, lambda g: g.cast("string")), lambda g: F.trim(g) != "")


def _zipped(left: Column, right: Column) -> Column:
    """Pairs up to the shorter list."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, F.lit(1), n).alias("a"), F.slice(right, F.lit(1), n).alias("b"))


def _row_number(rows: DataFrame) -> Column:
    """The place of a row for rows without an id: raw rows carry `ordinal`, their line in the source."""
    return F.col("ordinal") if "ordinal" in rows.columns else F.monotonically_increasing_id()


def flashrag(rows: DataFrame, dataset: str, dedupe_questions: bool = False) -> DataFrame:
    """id?, question, golden_answers. With dedupe, questions that occur more than once go, all of them; a missing id is
    the place among the rows that are left."""
    if dedupe_questions:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("question"))).where("_n = 1").drop("_n")
    idx = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    if "ordinal" in rows.columns and dedupe_questions:
        rows = rows.withColumn("ordinal", F.row_number().over(Window.orderBy("ordinal")) - 1)
    golds = _golds(F.col("golden_answers"))
    return rows.where(F.size(golds) > 0).select(*_item(dataset, F.coalesce(idx.cast("string"), _row_number(rows).cast("string")), F.col("question"), golds, "retrieved"))


def hotpot(rows: DataFrame) -> DataFrame:
    """id, question, answer, context<title, sentences>."""
    golds = F.array("answer")
    pairs = F.transform(_zipped(F.col("context.title"), F.col("context.sentences")), lambda p, j: _passage(F.concat(F.lit("hotpotqa:"), F.col("id").cast("string"), F.lit(":p"), j.cast("string")), X.passage_text(p["a"], F.array_join(p["b"], " "))))
    return rows.where(~X.is_yes_no(golds)).select(*_item("hotpotqa", F.col("id"), F.col("question"), golds, "provided", pairs))


def two_wiki(rows: DataFrame) -> DataFrame:
    """id, question, golden_answers, metadata<context<title, content>>; content is a list of sentences or one text."""
    golds = _golds(F.col("golden_answers"))
    content = F.col("metadata.context.content")
    lists = rows.schema["metadata"].dataType["context"].dataType["content"].dataType.elementType.typeName() == "array"
    body = (lambda c: F.array_join(c, " ")) if lists else (lambda c: c.cast("string"))
    pairs = F.transform(_zipped(F.col("metadata.context.title"), content), lambda p, j: _passage(F.concat(F.lit("2wikimultihopqa:"), F.col("id").cast("string"), F.lit(":p"), j.cast("string")), X.passage_text(p["a"], body(p["b"]))))
    return rows.where((F.size(golds) > 0) & ~X.is_yes_no(golds)).select(*_item("2wikimultihopqa", F.col("id"), F.col("question"), golds, "provided", pairs))


def musique(rows: DataFrame) -> DataFrame:
    """id, question, answer, answer_aliases?, answerable?, paragraphs[<idx, title, paragraph_text>]."""
    aliases = F.coalesce(F.col("answer_aliases"), F.array().cast("array<string>")) if "answer_aliases" in rows.columns else F.array().cast("array<string>")
    golds = _golds(F.array_distinct(F.concat(F.array("answer"), aliases)))
    usable = F.coalesce(F.col("answerable"), F.lit(True)) if "answerable" in rows.columns else F.lit(True)
    passages = F.transform("paragraphs", lambda p: _passage(F.concat(F.lit("musique:"), F.col("id").cast("string"), F.lit(":p"), p["idx"].cast("string")), X.passage_text(p["title"], p["paragraph_text"])))
    return rows.where(usable).select(*_item("musique", F.col("id"), F.col("question"), golds, "provided", passages))


def ragbench(rows: DataFrame, subset: str = "hotpotqa") -> DataFrame:
    """question, documents, documents_sentences[[[key, text]]], all_utilized_sentence_keys, ordinal; proxy labels are the
    share of a document's sentences that were used."""
    used = F.col("all_utilized_sentence_keys")

    def one(p: Column, j: Column) -> Column:
        keys = F.array_distinct(F.transform(p["b"], lambda s: F.element_at(s, 1)))
        proxy = F.size(F.array_intersect(keys, used)) / F.greatest(F.size(p["b"]), F.lit(1)).cast("double")
        return _passage(F.concat(F.lit(f"ragbench-{subset}:"), F.col("ordinal").cast("string"), F.lit(":p"), j.cast("string")), p["a"], proxy)

    passages = F.transform(_zipped(F.col("documents"), F.col("documents_sentences")), one)
    return rows.where(F.size("documents") >= 2).select(*_item(f"ragbench-{subset}", F.col("ordinal"), F.col("question"), F.array().cast("array<string>"), "provided", passages))


def entity_questions(files: DataFrame) -> DataFrame:
    """name, content (JSON array of <question, answers>) of the files below test/; see files.zip_members."""
    rows = files.where(F.col("name").contains("/test/") & F.col("name").endswith(".json"))
    relation = F.substring_index(F.substring_index("name", "/", -1), ".", 1)
    asked = rows.select(relation.alias("relation"), F.posexplode(F.from_json("content", "array<struct<question: string, answers: array<string>>>")).alias("j", "ex"))
    golds = _golds(F.col("ex.answers"))
    return asked.where(F.size(golds) > 0).select(*_item("entityquestions", F.concat_ws("-", "relation", F.col("j").cast("string")), F.col("ex.question"), golds, "retrieved"))


# The older loaders: query, answers, passages<id, text, is_positive>, dataset.


def _sample(rows: DataFrame, query: Column, answers: Column, passages: Column, dataset: str) -> DataFrame:
    out = rows.select(query.alias("query"), answers.alias("answers"), passages.alias("passages"), F.lit(dataset).alias("dataset"))
    return out


def _limited(rows: DataFrame, most: int | None) -> DataFrame:
    """The limit is on source rows, before any is left out."""
    return rows.where(F.col("ordinal") < most) if most else rows


def _old(id_: list[Column], text: Column, positive: Column) -> Column:
    return F.struct(F.concat_ws("_", *id_).alias("id"), text.alias("text"), positive.alias("is_positive"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once a row: Spark merges a column that a lambda names into the lambda, and works it
    out again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def legacy_ragbench(rows: DataFrame, most: int | None = None) -> DataFrame:
    sentences = F.coalesce("documents_sentences", F.array().cast("array<array<array<string>>>"))
    relevant = F.array_distinct(F.coalesce("all_relevant_sentence_keys", F.array().cast("array<string>")))
    keys = lambda r, j: F.transform(F.coalesce(F.get(r["sentences"], j), F.array().cast("array<array<string>>")), lambda s: F.element_at(s, 1))
    one = lambda r, d, j: _old([F.lit("ragbench"), F.col("ordinal").cast("string"), j.cast("string")], d, F.arrays_overlap(keys(r, j), r["relevant"]))
    passages = _once(F.struct(sentences.alias("sentences"), relevant.alias("relevant")), lambda r: F.transform("documents", lambda d, j: one(r, d, j)))
    return _sample(_limited(rows, most), F.col("question"), F.array("response"), passages, "ragbench")


def legacy_natural_questions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """question<text>, annotations<short_answers[<text[]>]>, long_answer_candidates<start_token, end_token>,
    document<tokens<token, is_html>>. Candidate spans are applied to the tokens that are not HTML, as published results did."""
    golds = F.flatten(F.transform("annotations.short_answers", lambda a: F.coalesce(a["text"], F.array().cast("array<string>"))))
    tokens = _zipped(F.col("document.tokens.token"), F.col("document.tokens.is_html"))
    plain = F.transform(F.filter(tokens, lambda t: ~t["b"]), lambda t: t["a"])
    spans = _zipped(F.col("long_answer_candidates.start_token"), F.col("long_answer_candidates.end_token"))
    text = lambda s: F.trim(F.array_join(F.slice(plain, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), " "))
    every = F.transform(spans, lambda s, j: _old([F.lit("nq"), F.col("ordinal").cast("string"), j.cast("string")], text(s), F.lit(False)))
    passages = F.filter(every, lambda p: p["text"] != "")
    kept = _limited(rows, most).where((F.size(golds) > 0) & (F.size(passages) > 0))
    return _sample(kept, F.col("question.text"), golds, passages, "natural_questions")


def legacy_msmarco(rows: DataFrame, most: int | None = None) -> DataFrame:
    """query, answers, passages<passage_text, is_selected>."""
    pairs = _zipped(F.col("passages.passage_text"), F.col("passages.is_selected"))
    every = F.transform(pairs, lambda p, j: _old([F.lit("msmarco"), F.col("ordinal").cast("string"), j.cast("string")], p["a"], p["b"] != 0))
    passages = F.filter(every, lambda p: F.trim(p["text"]) != "")
    usable = (F.size("answers") > 0) & ~((F.size("answers") == 1) & (F.try_element_at("answers", F.lit(1)) == "No Answer Present."))
    return _sample(_limited(rows, most).where(usable & (F.size(passages) > 0)), F.col("query"), F.col("answers"), passages, "msmarco")


def legacy_triviaqa(rows: DataFrame, most: int | None = None) -> DataFrame:
    """question, answer<value, aliases>, entity_pages<wiki_context>, search_results<search_context>."""
    answers = F.when(F.size("answer.aliases") > 0, F.col("answer.aliases")).otherwise(F.array("answer.value"))

    def part(name: str, column: str) -> Column:
        texts = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(texts, lambda t, j: _old([F.lit("triviaqa"), F.col("ordinal").cast("string"), F.lit(name), j.cast("string")], t, F.lit(False)))

    passages = F.filter(F.concat(part("wikipedia", "entity_pages.wiki_context"), part("web", "search_results.search_context")), lambda p: p["text"].isNotNull() & (F.trim(p["text"]) != ""))
    return _sample(_limited(rows, most).where(F.size(passages) > 0), F.col("question"), answers, passages, "triviaqa")


LEGACY: dict[str, Callable[..., DataFrame]] = {"ragbench": legacy_ragbench, "natural_questions": legacy_natural_questions, "msmarco": legacy_msmarco, "triviaqa": legacy_triviaqa}
FLASHRAG = ("nq", "triviaqa", "webquestions", "popqa", "squad", "ambigqa", "bamboogle")
PROVIDED = {"hotpotqa": hotpot, "2wikimultihopqa": two_wiki, "musique": musique}
DATASETS = (*FLASHRAG, "entityquestions", *PROVIDED)


def load_legacy(name: str, rows: DataFrame, most: int | None = None) -> DataFrame:
    if name not in LEGACY:
        raise ValueError(f"unknown dataset {name!r}; choose from {sorted(LEGACY)}")
    return LEGACY[name](rows, most)


def build_dataset(spark: SparkSession, name: str, path: str, n: int = 100, seed: int = 0) -> DataFrame:
    """n items of a dataset whose raw file has been landed at path (all, if fewer)."""
    from passant.sources import files

    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; choose from {DATASETS}")
    if name == "entityquestions":
        items = entity_questions(files.zip_members(spark, path))
    elif name in FLASHRAG:
        items = flashrag(files.jsonl(spark, path), name, dedupe_questions=name == "popqa")
    else:
        items = PROVIDED[name](files.jsonl(spark, path))
    return sample_items(items, n, "query_id", seed + DATASETS.index(name))


def candidates(items: DataFrame) -> DataFrame:
    """query_id, passage_id, text, bm25, proxy_label, pos: a row for each passage."""
    return items.select("dataset", "query_id", F.posexplode("passages").alias("pos", "p")).select("dataset", "query_id", F.col("p.id").alias("passage_id"), F.col("p.text").alias("text"), F.col("p.bm25").alias("bm25"), F.col("p.proxy_label").alias("proxy_label"), "pos")
