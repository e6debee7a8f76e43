"""Corpus statistics, exact BM25 and dense scoring, and the retriever features of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passant.functions import text as X
from passant.session import dealt

K1, B = 1.2, 0.75
OKAPI_K1, OKAPI_B, OKAPI_EPSILON = 1.5, 0.75, 0.25
#: Rows of a query vocabulary up to which it is broadcast; a larger one is joined by shuffle.
SMALL = 500_000
#: Megabytes of files for each part that texts are dealt out in.
TASK_MB = 4


def small_side(df: DataFrame, limit: int = SMALL, bound: DataFrame | None = None) -> DataFrame:
    """df marked for broadcast if it has so many rows at most; one row more decides it. bound: a table that is cheaper to
    count and has no fewer rows."""
    return F.broadcast(df) if (df if bound is None else bound).limit(limit + 1).count() <= limit else df


def tokens_of(corpus: DataFrame, tokenize=X.tokenize) -> DataFrame:
    """pid, dl, toks from corpus (pid, text). Texts are dealt out by pid, in parts that follow the input's size: a document's
    terms and its scores are then counted where it lies, in tables of a part's documents."""
    return dealt(corpus.select("pid", "text"), "pid", task_mb=TASK_MB).select("pid", tokenize(F.col("text")).alias("toks")).select("pid", F.size("toks").alias("dl"), "toks")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))


def vocabulary(queries: DataFrame, terms=X.query_terms) -> DataFrame:
    """query_id, term for queries (query_id, query)."""
    return queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))


def term_frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """pid, dl, term, tf, for the terms asked for only: the vocabulary is joined before anything is counted.

    explode_outer, as Spark would tokenise each text twice to drop those without a word before explode; the join does.
    """
    words = tokens.select("pid", "dl", F.explode_outer("toks").alias("term"))
    tf = words.join(small_side(terms.select("term").distinct(), bound=terms), "term", "left_semi").groupBy("pid", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return dealt(tf, "pid", task_mb=TASK_MB)  # what is counted over it and what is scored read the same shuffle


def document_frequencies(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df; terms that no document holds have 0. Counting over tf keeps its column, so that tf is computed once."""
    counts = tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long") + F.col("dl") * 0).alias("df"))
    return terms.select("term").distinct().join(counts, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weight(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, pid, score, rank (from 0) of each query's k best passages, ties to the smaller pid.

    Only documents with a term of the query are candidates. Scores are compared after rounding to nine digits, so that
    the order in which they were summed doesn't decide.
    """
    tokens = tokens_of(corpus)
    terms = vocabulary(queries)
    return ranked(term_frequencies(tokens, terms), terms, corpus_stats(tokens), k)


def ranked(tf: DataFrame, terms: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """The k best passages of each query by frequencies (pid, dl, term, tf) of its terms and a row of corpus statistics."""
    df = document_frequencies(tf, terms)
    scored = df.crossJoin(F.broadcast(stats))  # one row
    weights = terms.join(scored.select("term", idf(F.col("df"), F.col("n_docs")).alias("idf"), "avgdl"), "term")
    hits = tf.join(small_side(weights, bound=terms), "term").groupBy("query_id", "pid").agg(F.sum(weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
    return top_k(hits, k)


def top_k(hits: DataFrame, k: int, later_first: bool = False) -> DataFrame:
    """rank from 0 by score, then pid; Spark prunes each task's rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("pid").desc() if later_first else F.col("pid"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def okapi_top_k(corpus: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The Okapi variant: lower-case white-space tokens, ln((N - df + .5) / (df + .5)), and a quarter of the average idf
    in place of negative ones. Ties go to the larger pid; documents that share no term with a query are not listed."""
    tokens = tokens_of(corpus, lambda t: X.words(F.lower(t)))
    n_avgdl = corpus_stats(tokens)
    counts = tokens.select(F.explode_outer(F.array_distinct("toks")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.crossJoin(F.broadcast(n_avgdl)).select("term", "avgdl", F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = queries.select("query_id", F.explode(X.words(F.lower("query"))).alias("term"))
    asked = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    idfs = raw.join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, F.lit(OKAPI_EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    tf = term_frequencies(tokens, asked)
    scores = tf.join(small_side(asked.join(idfs, "term"), bound=asked), "term").groupBy("query_id", "pid").agg(F.sum(F.col("times") * weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), OKAPI_K1, OKAPI_B)).alias("score"))
    return top_k(scores, k, later_first=True)


def own_candidates(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, pid, query, text) with score: Okapi inside each query's own candidates, which are its corpus."""
    by = Window.partitionBy("query_id")
    rows = pairs.select("query_id", "pid", X.spaced_tokens(F.col("query")).alias("asked"), X.spaced_tokens(F.col("text")).alias("toks"))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(by), "dl": F.size("toks"), "avgdl": F.avg(F.size("toks")).over(by)})
    terms = rows.select("query_id", "pid", "n", "dl", "avgdl", F.explode("toks").alias("term"), "asked").groupBy("query_id", "pid", "n", "dl", "avgdl", "term").agg(F.count(F.lit(1)).alias("tf"), F.first(F.size(F.filter("asked", lambda w: w == F.col("term")))).alias("times"))
    raw = terms.withColumn("raw", F.ln((F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("query_id", "term")) + 0.5) / (F.count(F.lit(1)).over(Window.partitionBy("query_id", "term")) + 0.5)))
    mean = raw.select("query_id", "term", "raw").distinct().groupBy("query_id").agg(F.avg("raw").alias("mean"))
    idf_ = F.when(F.col("raw") < 0, F.lit(OKAPI_EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    scored = raw.where("times > 0").join(mean, "query_id").groupBy("query_id", "pid").agg(F.sum(F.col("times") * weight(idf_, F.col("tf"), F.col("dl"), F.col("avgdl"), OKAPI_K1, OKAPI_B)).alias("score"))
    return pairs.join(scored, ["query_id", "pid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def candidate_scores(candidates: DataFrame, score: str = "score", order: str = "pid") -> DataFrame:
    """bm25_norm, rank and score_gap of each query's candidates: score over the query's maximum (over 1 if that isn't
    positive), place from 0, and the gap to the next one on that scale (0 for the last)."""
    by = Window.partitionBy("query_id")
    place = by.orderBy(F.col(score).desc(), order)
    top = F.max(score).over(by)
    scale = F.when(top > 0, top).otherwise(F.lit(1.0))
    gap = F.coalesce(F.col(score) - F.lead(score).over(place), F.lit(0.0)) / scale
    return candidates.withColumns({"bm25_norm": F.col(score) / scale, "rank": F.row_number().over(place) - 1, "score_gap": gap})


def dense_scores(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, pid, q, d: vectors) with dense_score, the cosine."""
    return pairs.withColumn("dense_score", X.cosine(F.col("q"), F.col("d")))
