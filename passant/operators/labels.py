"""Answers, correctness, utility labels and answer containment."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passant.functions import scorers
from passant.functions import text as X


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfd_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda every: [None if x is None else unicodedata.normalize("NFD", x) for x in every], na_action="ignore")


#: ASCII is decomposed as it is: only other texts go to Python.
_beyond_ascii = lambda c: c.rlike(r"[^\x00-\x7F]")


def normalized(text: Column, ascii_only: bool = False) -> Column:
    """The exact answer normalisation; texts that are ASCII aren't sent to Python. ascii_only: nothing is decomposed."""
    return X.normalize(text if ascii_only else F.coalesce(_nfd(F.when(_beyond_ascii(text), text)), text))


def normalized_all(texts: Column) -> Column:
    """The same for each text of an array, in one pass of the row; nulls go."""
    held = F.filter(texts, lambda t: t.isNotNull())
    plain = F.coalesce(_nfd_all(F.when(F.exists(held, _beyond_ascii), held)), held)
    return F.transform(plain, X.normalize)


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, prediction, gold: each turn and the next one of its conversation."""
    next_turn = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    rows = conversations.withColumn("gold", next_turn).where("gold is not null and text is not null")
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.col("text").alias("prediction"), "gold")


def qa_scores(pairs: DataFrame, ascii_only: bool = False) -> DataFrame:
    """pair_id with exact, relaxed, f1 and acc for pairs (pair_id, prediction, golds: array). Null golds are none, and no
    text moves. ascii_only: texts are taken as they are, not decomposed."""
    if ascii_only:
        rows = pairs.select("pair_id", X.normalize(F.col("prediction")).alias("p"), F.transform("golds", X.normalize).alias("g"))
    else:
        rows = pairs.select("pair_id", normalized(F.col("prediction")).alias("p"), normalized_all(F.coalesce("golds", F.array().cast("array<string>"))).alias("g"))
    p, g = F.col("p"), F.col("g")
    return rows.select("pair_id", X.exact_match(p, g).alias("exact"), X.relaxed_match(p, g).alias("relaxed"), X.token_f1(p, g).alias("f1"), X.accuracy(p, g).alias("acc"))


def utility_labels(queries: DataFrame, candidates: DataFrame, factory: Callable = scorers.mock_answerer, ascii_only: bool = False) -> DataFrame:
    """query_id, passage_id, score_no_ctx, score_with_ctx, u_true.

    queries: query_id, query, golds; candidates: query_id, passage_id, text. The answer without a passage is generated
    once for each query and joined to its passages; each passage is answered once.
    """
    none = F.array().cast("array<string>")
    base = scorers.generate(queries.select("query_id", X.answer_prompt(F.col("query"), none).alias("prompt")), "prompt", "answer", factory)
    pairs = candidates.join(queries, "query_id").select("query_id", "passage_id", X.answer_prompt(F.col("query"), F.array("text")).alias("prompt"))
    with_ = scorers.generate(pairs, "prompt", "answer", factory)
    norm = lambda c: X.normalize(c) if ascii_only else normalized(c)
    golds = queries.select("query_id", (F.transform("golds", X.normalize) if ascii_only else normalized_all(F.col("golds"))).alias("g"))

    def scored(answers: DataFrame, name: str) -> DataFrame:
        rows = answers.withColumn("p", norm(F.col("answer"))).join(golds, "query_id")
        return rows.withColumn(name, X.accuracy(F.col("p"), F.col("g"))).drop("p", "g", "prompt", "answer")

    both = scored(with_, "score_with_ctx").join(scored(base, "score_no_ctx"), "query_id")
    return both.select("query_id", "passage_id", "score_no_ctx", "score_with_ctx", X.utility(F.col("score_with_ctx"), F.col("score_no_ctx")).alias("u_true"))


def containment(pairs: DataFrame) -> DataFrame:
    """pairs (…, text and golds normalised) with label 1 where a gold is a token span of the text, and yes_no."""
    return pairs.withColumns({"label": F.exists("golds", lambda g: X.contains_span(F.col("text"), g)).cast("double"), "yes_no": X.all_yes_no(F.col("golds"))})


def label_diagnostics(pairs: DataFrame, label: str = "u", other: str = "score") -> DataFrame:
    """One row: share positive and non-zero, mean, and Pearson correlation after centring by query."""
    by = Window.partitionBy("query_id")
    rows = pairs.withColumns({"_a": F.col(label) - F.avg(label).over(by), "_b": F.col(other) - F.avg(other).over(by)})
    corr = F.coalesce(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")), F.lit(0.0))
    return rows.agg(F.avg((F.col(label) > 0).cast("double")).alias("share_positive"), F.avg((F.col(label) != 0).cast("double")).alias("share_nonzero"), F.avg(label).alias("mean"), corr.alias("centered_corr"))
