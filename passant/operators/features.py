"""The fourteen feature columns of (query, passage) pairs, the ranking pipeline and its prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passant.functions import scorers
from passant.functions import text as X
from passant.operators.retrieval import candidate_scores
from passant.schemas import FEATURES


def feature_matrix(pairs: DataFrame, credibility: float = 0.5) -> DataFrame:
    """query_id, passage_id and the features; pairs: query_id, passage_id, query, text, score, and optionally
    dense_score, claim (hyde), nli (three logits: contradiction, entailment, neutral), entropy, delta_entropy, perplexity.

    Without a claim the query's statement stands in; missing model columns come from hash mocks.
    """
    have = set(pairs.columns)
    query, text = F.col("query"), F.col("text")
    rows = pairs if "claim" in have else pairs.withColumn("claim", X.statement(query))
    probe = scorers.mock_probe(query, text)
    rows = candidate_scores(rows, "score", "passage_id")
    nli = X.softmax(F.col("nli") if "nli" in have else scorers.mock_nli(F.col("claim"), text))
    made = {
        "dense_score": F.col("dense_score") if "dense_score" in have else F.lit(0.0),
        "rank": F.col("rank").cast("double"),
        "token_length": X.token_length(text).cast("double"), "readability": X.readability(text), "source_credibility": F.lit(credibility),
        "entity_overlap": X.share_of(X.entities(query), X.entities(text)), "answerability": X.answerability(F.col("claim"), text),
        "_nli": nli, "entropy": F.col("entropy") if "entropy" in have else probe["entropy"],
        "delta_entropy": F.col("delta_entropy") if "delta_entropy" in have else probe["delta_entropy"], "perplexity": F.col("perplexity") if "perplexity" in have else probe["perplexity"],
    }
    rows = rows.withColumns(made).withColumns({"entailment": F.element_at("_nli", 2), "contradiction": F.element_at("_nli", 1)})
    return rows.select("query_id", "passage_id", *FEATURES)


def baseline_scores(features: DataFrame) -> DataFrame:
    """query_id, passage_id, model, score in long form: what a predictor is compared with."""
    wide = features.select("query_id", "passage_id", F.col("bm25_norm").alias("bm25"), F.col("dense_score").alias("dense"), (-F.col("token_length")).alias("shortest"), F.col("token_length").alias("length_only"))
    return wide.unpivot(["query_id", "passage_id"], ["bm25", "dense", "shortest", "length_only"], "model", "score")


def rank_passages(features: DataFrame, predict: Callable[[DataFrame], DataFrame], alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """query_id, passage_id, utility, place (from 1): predicted, calibrated, best first, ties by passage_id.

    predict adds `prediction`; it centres by query if it was trained so.
    """
    scored = predict(features).select("query_id", "passage_id", (F.lit(alpha) * F.col("prediction") + F.lit(beta)).alias("utility"))
    order = Window.partitionBy("query_id").orderBy(F.col("utility").desc(), "passage_id")
    return scored.withColumn("place", F.row_number().over(order))


def top_m(ranked: DataFrame, m: int, threshold: float | None = None) -> DataFrame:
    """The m best of each query, of those above the threshold if there is one."""
    kept = ranked if threshold is None else ranked.where(F.col("utility") > threshold)
    order = Window.partitionBy("query_id").orderBy("place")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= m)


def prompts(queries: DataFrame, ranked: DataFrame, texts: DataFrame, m: int = 3, threshold: float | None = None, style: str = "rag") -> DataFrame:
    """query_id, prompt for every query; texts: query_id, passage_id, text. At most m passages meet in a row."""
    best = top_m(ranked, m, threshold).join(texts, ["query_id", "passage_id"])
    lists = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]).alias("texts"))
    rows = queries.join(lists, "query_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    made = X.rag_prompt(F.col("query"), F.col("texts")) if style == "rag" else X.answer_prompt(F.col("query"), F.col("texts"))
    return rows.select("query_id", made.alias("prompt"))


def answer_plan(scores: DataFrame, queries: DataFrame, texts: DataFrame, ms: tuple[int, ...] = (1, 3)) -> DataFrame:
    """model, m, query_id, prompt: every model's m best passages for each m, and the prompt without passages (none, 0)."""
    order = Window.partitionBy("model", "query_id").orderBy(F.col("score").desc(), "passage_id")
    ranked = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ms)).join(texts, ["query_id", "passage_id"])
    chosen = ranked.withColumn("m", F.explode(F.array(*map(F.lit, ms)))).where("place <= m")
    lists = chosen.groupBy("model", "m", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]).alias("texts"))
    none = queries.select(F.lit("none").alias("model"), F.lit(0).alias("m"), "query_id", F.array().cast("array<string>").alias("texts"))
    return lists.unionByName(none).join(queries, "query_id").select("model", "m", "query_id", X.answer_prompt(F.col("query"), F.col("texts")).alias("prompt"))


def latency_tiers(timings: DataFrame, tiers: DataFrame) -> DataFrame:
    """tier, mean_ms, median_ms: timings (query_id, component, ms) summed over each tier's components (tier, component)."""
    sums = timings.join(F.broadcast(tiers), "component").groupBy("tier", "query_id").agg(F.sum("ms").alias("ms"))
    return sums.groupBy("tier").agg(F.avg("ms").alias("mean_ms"), F.percentile("ms", F.lit(0.5)).alias("median_ms"))
