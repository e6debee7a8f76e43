"""Registry of the core queries and of their DuckDB oracles. Names begin with the inventory id they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passant.functions import scorers
from passant.functions import text as X
from passant.operators import dense, features, grams, labels, metrics, models, probes, protocol, resampling, retrieval, stats
from passant.plans import stand_ins as S
from passant.plans import studies
from passant.schemas import FEATURES
from passant.session import shared_folder
from passant.sources import archives, files, parsers
from passant.streaming import topk

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- corpus and text scalars


@query("s2_corpus_lines", "SELECT doc_id AS pid, trim(regexp_replace(trim(split_part(text, chr(10), 1)), '^\"+|\"+$', '', 'g')) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents")
def s2_corpus_lines(spark, d):
    return S.corpus(spark, d).select("pid", "title", "body")


@query("s1_zipped_corpus", """SELECT 'part-' || (doc_id // 1000) AS archive, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - 1 AS place, CAST(doc_id AS VARCHAR) AS pid,
 trim(regexp_replace(trim(split_part(text, chr(10), 1)), '^\"+|\"+$', '', 'g')) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d""")
def s1_zipped_corpus(spark, d):
    """Documents as corpus lines in zip archives of a thousand each, streamed back."""
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("contents")))
    lines = S.table(spark, d, "documents").select(F.concat(F.lit("part-"), F.expr("doc_id div 1000").cast("string")).alias("archive"), F.col("doc_id").alias("place"), line.alias("value"))
    got = archives.inflated_lines(archives.deflated_chunks(lines))
    return files.corpus(got, keep=("archive", "place")).drop("text")


@query("f1_tokenize", f"WITH {S.CORPUS}, t AS (SELECT pid, {S.tok('text')} AS toks FROM corpus) SELECT pid, len(toks) AS dl, md5(array_to_string(toks, ' ')) AS digest FROM t")
def f1_tokenize(spark, d):
    toks = X.tokenize(F.col("text"))
    return S.corpus(spark, d).select("pid", toks.alias("t")).select("pid", F.size("t").cast("long").alias("dl"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("f2_query_terms", f"WITH {S.QUESTIONS}, t AS (SELECT query_id, {S.tok('query')} AS toks FROM questions) SELECT query_id, array_to_string({S.ordered_distinct('toks')}, ' ') AS terms FROM t")
def f2_query_terms(spark, d):
    return S.questions(spark, d).select("query_id", F.array_join(X.query_terms(F.col("query")), " ").alias("terms"))


@query("f5_f7_document_quality", f"WITH {S.CORPUS}, w AS (SELECT pid, text, len({S.words('text')}) AS n FROM corpus), x AS (SELECT pid, n, greatest(n, 1) AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS v FROM w) SELECT pid, n AS token_length, round(0.39e0 * w / s + 11.8e0 * greatest(v, w) / w - 15.59e0, 6) + 0.0 AS readability, CAST(0.5 AS DOUBLE) AS source_credibility FROM x")
def f5_f7_document_quality(spark, d):
    text = F.col("text")
    return S.corpus(spark, d).select("pid", X.token_length(text).cast("long").alias("token_length"), r6(X.readability(text)).alias("readability"), F.lit(0.5).alias("source_credibility"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its five best passages and their texts."""
    corpus, questions = S.corpus(spark, d), S.questions(spark, d)
    best = retrieval.bm25_top_k(corpus, questions, 5).withColumn("score", F.round("score", 9))
    best = retrieval.small_side(best, bound=questions)  # so that no text is shuffled for it; a few rows for each question
    return corpus.select("pid", "text").join(best, "pid").join(questions, "query_id").withColumnRenamed("pid", "passage_id")


_PAIRS = f"{S.BM25}, pairs AS (SELECT r.query_id, r.pid AS passage_id, round(r.score, 9) AS score, r.rank, c.text, q.query FROM ranked r JOIN corpus c ON r.pid = c.pid JOIN questions q ON r.query_id = q.query_id WHERE rank < 5)"
_ENT = lambda t: f"list_distinct({S.words(f'''lower(regexp_replace({t}, '[[:punct:]]', '', 'g'))''')})"
_CONTENT = lambda t: f"list_distinct(list_filter({S.words(f'''regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')''')}, lambda w: length(w) > 1 AND NOT list_contains({S.CONTENT_STOP}, w)))"


def _statement_sql(q: str) -> str:
    body = f"trim(regexp_replace(trim({q}), '\\?+$', ''))"
    cases = " ".join(f"WHEN lower({body}) LIKE '{p}%' THEN CASE WHEN trim(substr({body}, {len(p) + 1})) = '' THEN 'This text answers: ' || {body} || '.' ELSE trim(substr({body}, {len(p) + 1})) || ' is described in this text.' END" for p in X.QUESTION_PREFIXES)
    return f"CASE {cases} ELSE 'This text answers the question: ' || {body} || '.' END"


@query("f8_f11_semantic_overlap", f"WITH {_PAIRS}, x AS (SELECT query_id, passage_id, {_ENT('query')} AS eq, {_ENT('text')} AS ep, {_CONTENT(_statement_sql('query'))} AS ca, {_CONTENT('text')} AS cp FROM pairs) SELECT query_id, passage_id, round(len(list_intersect(eq, ep)) / greatest(len(eq), 1), 6) AS entity_overlap, round(CASE WHEN len(ca) = 0 THEN 0.0 ELSE len(list_intersect(ca, cp)) / len(ca) END, 6) AS answerability FROM x")
def f8_f11_semantic_overlap(spark, d):
    q, t = F.col("query"), F.col("text")
    return _pairs(spark, d).select("query_id", "passage_id", r6(X.share_of(X.entities(q), X.entities(t))).alias("entity_overlap"), r6(X.answerability(X.statement(q), t)).alias("answerability"))


_ASKED = "asked AS (SELECT item_id AS query_id, ['what is ', 'Who was ', 'which ', 'How many ', 'tell '][1 + item_id % 5] || query || '?' AS query FROM (SELECT item_id, array_to_string(" + S.words("text") + ", ' ') AS query FROM benchmark) b)"


@query("f12_statement", f"WITH {_ASKED} SELECT query_id, {_statement_sql('query')} AS claim FROM asked")
def f12_statement(spark, d):
    b = S.table(spark, d, "benchmark")
    opening = F.element_at(F.array(*map(F.lit, ("what is ", "Who was ", "which ", "How many ", "tell "))), (F.col("item_id") % 5 + 1).cast("int"))
    asked = b.select(F.col("item_id").alias("query_id"), F.concat(opening, F.array_join(X.words(F.col("text")), " "), F.lit("?")).alias("query"))
    return asked.select("query_id", X.statement(F.col("query")).alias("claim"))


@query("f13_first_line", f"WITH t AS (SELECT conv_id, turn, trim(split_part(trim(text), chr(10), 1)) AS line, text FROM conversations) SELECT conv_id, turn, CASE WHEN line = '' THEN {_statement_sql('text')} ELSE line END AS claim FROM t")
def f13_first_line(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", X.first_line(F.col("text"), F.col("text")).alias("claim"))


# ---------------------------------------------------------------- retrieval


@query("a1_corpus_stats", f"WITH {S.BM25} SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats")
def a1_corpus_stats(spark, d):
    return retrieval.corpus_stats(retrieval.tokens_of(S.corpus(spark, d))).select("n_docs", r6("avgdl").alias("avgdl"))


@query("a1_term_df", f"WITH {S.BM25} SELECT df.term, df, round(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats")
def a1_term_df(spark, d):
    tokens, terms = retrieval.tokens_of(S.corpus(spark, d)), retrieval.vocabulary(S.questions(spark, d))
    df = retrieval.document_frequencies(retrieval.term_frequencies(tokens, terms), terms)
    return df.crossJoin(F.broadcast(retrieval.corpus_stats(tokens))).select("term", "df", r6(retrieval.idf(F.col("df"), F.col("n_docs"))).alias("idf"))


@query("k1_bm25_topk", f"WITH {S.BM25} SELECT query_id, pid, round(score, 6) AS score, rank FROM ranked WHERE rank < 5")
def k1_bm25_topk(spark, d):
    return retrieval.bm25_top_k(S.corpus(spark, d), S.questions(spark, d), 5).select("query_id", "pid", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("st4_streaming_bm25", f"WITH {S.BM25} SELECT query_id, pid, round(score, 6) AS score, rank FROM ranked WHERE rank < 5")
def st4_streaming_bm25(spark, d):
    """The same over documents that arrive file by file, under statistics that change with every batch."""
    files_of = S.table(spark, d, "documents").inputFiles()
    one = len(files_of) == 1 and files_of[0].endswith("/documents.parquet")
    folder, names = (d, "documents.parquet") if one else (f"{d}/documents.parquet", "*.parquet")
    docs = spark.readStream.schema("doc_id long, text string").option("pathGlobFilter", names).option("maxFilesPerTrigger", 8).parquet(folder)
    base = shared_folder(spark)
    stream = docs.select(F.col("doc_id").alias("pid"), F.coalesce("text", F.lit("")).alias("text"))
    best = topk.stream_bm25(spark, stream, S.questions(spark, d), 5, f"{base}/out", f"{base}/checkpoint")
    return best.select("query_id", "pid", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("k2_okapi_topk", f"""WITH {S.CORPUS}, {S.QUESTIONS}, dls AS (SELECT pid, len(t) AS dl, t FROM (SELECT pid, {S.words('lower(text)')} AS t FROM corpus) x),
 stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dls), df AS (SELECT term, count(*) AS df FROM (SELECT pid, unnest(list_distinct(t)) AS term FROM dls) x GROUP BY 1),
 raw AS (SELECT term, avgdl, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, stats), idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({S.words('lower(query)')}) AS term FROM questions) x GROUP BY ALL),
 tf AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, dl, unnest(t) AS term FROM dls) x WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 s AS (SELECT query_id, pid, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN asked ON tf.term = asked.term JOIN idf ON tf.term = idf.term GROUP BY ALL)
 SELECT query_id, pid, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pid DESC) - 1 AS rank FROM s) x WHERE rank < 10""")
def k2_okapi_topk(spark, d):
    return retrieval.okapi_top_k(S.corpus(spark, d), S.questions(spark, d), 10).select("query_id", "pid", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("w1_candidate_scores", f"""WITH {S.SCORED}, m AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END AS scale,
 row_number() OVER w - 1 AS rank, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, passage_id))
 SELECT query_id, passage_id, round(score / scale, 6) AS bm25_norm, rank, round(coalesce(score - nxt, 0) / scale, 6) AS score_gap FROM m""")
def w1_candidate_scores(spark, d):
    rows = retrieval.candidate_scores(S.scored(spark, d), "score", "passage_id")
    return rows.select("query_id", "passage_id", r6("bm25_norm").alias("bm25_norm"), F.col("rank").cast("long").alias("rank"), r6("score_gap").alias("score_gap"))


@query("f25_dense_topk", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS pid,
 list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pid) - 1 AS rank FROM p) SELECT query_id, pid, round(score, 6) AS score, rank FROM r WHERE rank < 5""")
def f25_dense_topk(spark, d):
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    best = dense.top_k(e.where("id % 50 = 0"), e, 5, ("id", "v"), ("id", "v"), other_ids=True)
    return best.select("query_id", "pid", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- ranking metrics


@query("a5_per_query_scores", f"WITH {S.SCORED}, {S.PER_QUERY} SELECT query_id, round(spearman, 6) + 0.0 AS spearman, round(ndcg, 6) AS ndcg, top1 FROM pq")
def a5_per_query_scores(spark, d):
    return metrics.per_query_scores(S.scored(spark, d)).select("query_id", r6("spearman").alias("spearman"), r6("ndcg").alias("ndcg"), "top1")


@query("a7_per_query_strict", f"WITH {S.SCORED}, {S.PER_QUERY} SELECT query_id, round(spearman, 6) + 0.0 AS spearman FROM pq WHERE ss >= 1e-12")
def a7_per_query_strict(spark, d):
    return metrics.per_query_scores(S.scored(spark, d), strict=True).select("query_id", r6("spearman").alias("spearman"))


_GLOBAL = "ranks AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs FROM scored)"


@query("a6_ranking_summary", f"WITH {S.SCORED}, {S.PER_QUERY}, {_GLOBAL} SELECT round(avg(spearman), 6) + 0.0 AS spearman, round(avg(ndcg), 6) AS ndcg, round(avg(top1), 6) AS top1, count(*) AS n_queries, (SELECT round(covar_pop(ry, rs) / (stddev_pop(ry) * stddev_pop(rs)), 6) + 0.0 FROM ranks) AS rho FROM pq")
def a6_ranking_summary(spark, d):
    return metrics.ranking_summary(S.scored(spark, d)).select(r6("spearman").alias("spearman"), r6("ndcg").alias("ndcg"), r6("top1").alias("top1"), "n_queries", r6("rho").alias("rho"))


@query("a8_top1_accuracy", f"WITH {S.SCORED}, {S.PER_QUERY} SELECT ds.dataset, round(avg(top1), 6) AS top1 FROM pq JOIN (SELECT DISTINCT query_id, dataset FROM scored) ds ON pq.query_id = ds.query_id GROUP BY 1")
def a8_top1_accuracy(spark, d):
    rows = S.scored(spark, d)
    per = metrics.per_query_scores(rows)
    return per.join(rows.select("query_id", "dataset").distinct(), "query_id").groupBy("dataset").agg(r6(F.avg("top1")).alias("top1"))


@query("a10_global_ndcg", f"""WITH {S.SCORED}, g AS (SELECT y - min(y) OVER () AS g, row_number() OVER (ORDER BY score DESC) AS p, row_number() OVER (ORDER BY y DESC) AS i, score FROM scored),
 t AS (SELECT *, avg(g) OVER (PARTITION BY score) AS tied FROM g) SELECT round(sum(CASE WHEN p <= 10 THEN tied / log2(p + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END), 6) AS ndcg FROM t""")
def a10_global_ndcg(spark, d):
    return metrics.global_ndcg(S.scored(spark, d)).select(r6("ndcg").alias("ndcg"))


@query("a11_mrr", f"WITH {S.SCORED} SELECT round(coalesce(avg(1.0 / score), 0), 6) AS mrr FROM scored WHERE score > 0")
def a11_mrr(spark, d):
    return metrics.mrr(S.scored(spark, d), "score").select(r6("mrr").alias("mrr"))


@query("a4_dataset_statistics", f"""WITH {S.SCORED}, q AS (SELECT dataset, query_id, count(*) AS n, sum(y) AS s, count(*) FILTER (y <> 0) AS z, count(*) FILTER (y > 0) AS p, stddev_pop(y) AS sd FROM scored GROUP BY ALL)
 SELECT dataset, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(n) / count(*), 6) AS pairs_per_query, round(sum(s) / sum(n), 6) AS mean_y, round(sum(z) / sum(n), 6) AS share_nonzero, round(sum(p) / sum(n), 6) AS share_positive, CAST(sum(CASE WHEN n >= 2 AND sd >= 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS n_rankable FROM q GROUP BY 1""")
def a4_dataset_statistics(spark, d):
    out = metrics.dataset_statistics(S.scored(spark, d))
    return out.select("dataset", "n_queries", "n_pairs", *[r6(c).alias(c) for c in ("pairs_per_query", "mean_y", "share_nonzero", "share_positive")], "n_rankable")


_PQD = S.PER_QUERY.replace("PARTITION BY query_id", "PARTITION BY dataset, query_id").replace("any_value(dataset) AS ds", "dataset AS ds").replace("GROUP BY query_id", "GROUP BY dataset, query_id")


@query("a14_macro_average", f"WITH {S.SCORED}, {_PQD}, m AS (SELECT ds, avg(spearman) AS s, avg(ndcg) AS n, avg(top1) AS t FROM pq GROUP BY 1) SELECT round(avg(s), 6) + 0.0 AS spearman, round(avg(n), 6) AS ndcg, round(avg(t), 6) AS top1, count(*) AS n_datasets FROM m")
def a14_macro_average(spark, d):
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))
    return metrics.macro_average(per).select(*[r6(c).alias(c) for c in ("spearman", "ndcg", "top1")], "n_datasets")


@query("a14_rows_with_totals", f"WITH {S.SCORED}, {_PQD} SELECT coalesce(ds, 'all') AS dataset, round(avg(spearman), 6) + 0.0 AS spearman, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM pq GROUP BY GROUPING SETS ((ds), ())")
def a14_rows_with_totals(spark, d):
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))
    return per.rollup("dataset").agg(r6(F.avg("spearman")).alias("spearman"), r6(F.avg("ndcg")).alias("ndcg"), F.count(F.lit(1)).alias("n")).withColumn("dataset", F.coalesce("dataset", F.lit("all")))


@query("a16_selection_frequency", f"WITH {S.SCORED} SELECT best, count(*) AS n FROM (SELECT query_id, arg_max(dataset, c) AS best FROM (SELECT query_id, dataset, count(*) * 1000 - ascii(dataset) + length(dataset) / 100.0 AS c FROM scored GROUP BY query_id, dataset) x GROUP BY 1) y GROUP BY 1")
def a16_selection_frequency(spark, d):
    n = F.count(F.lit(1)) * 1000 - F.ascii("dataset") + F.length("dataset") / 100.0
    counts = S.scored(spark, d).groupBy("query_id", "dataset").agg(n.alias("c"))
    return counts.groupBy("query_id").agg(F.max_by("dataset", "c").alias("best")).groupBy("best").agg(F.count(F.lit(1)).alias("n"))


@query("a17_label_diagnostics", f"WITH {S.SCORED}, c AS (SELECT y, y - avg(y) OVER (PARTITION BY query_id) AS a, score - avg(score) OVER (PARTITION BY query_id) AS b FROM scored) SELECT round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END), 6) AS share_positive, round(avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0 END), 6) AS share_nonzero, round(avg(y), 6) AS mean, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) + 0.0 AS centered_corr FROM c")
def a17_label_diagnostics(spark, d):
    out = labels.label_diagnostics(S.scored(spark, d), "y", "score")
    return out.select(*[r6(c).alias(c) for c in ("share_positive", "share_nonzero", "mean", "centered_corr")])


@query("a21_latency_tiers", """WITH t AS (SELECT user_id AS query_id, event_type AS component, sum(value) AS ms FROM events GROUP BY ALL), tiers AS (SELECT DISTINCT 'full' AS tier, component FROM t UNION ALL SELECT DISTINCT 'short', component FROM t WHERE component < 'm'),
 s AS (SELECT tier, query_id, sum(ms) AS ms FROM t JOIN tiers ON t.component = tiers.component GROUP BY ALL) SELECT tier, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS median_ms FROM s GROUP BY 1""")
def a21_latency_tiers(spark, d):
    t = S.table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("component")).agg(F.sum("value").alias("ms"))
    names = t.select("component").distinct()
    tiers = names.select(F.lit("full").alias("tier"), "component").unionByName(names.where("component < 'm'").select(F.lit("short").alias("tier"), "component"))
    return features.latency_tiers(t, tiers).select("tier", r6("mean_ms").alias("mean_ms"), r6("median_ms").alias("median_ms"))


# ---------------------------------------------------------------- answers and labels


@query("f14_normalize_unicode")
def f14_normalize_unicode(spark, d):
    """Every turn, decomposed; DuckDB can't decompose, so tests compare with Python."""
    return S.table(spark, d, "conversations").select("conv_id", "turn", labels.normalized(F.col("text")).alias("normal"))


# Pairs of any script; DuckDB can't decompose Unicode, so tests compare the normalised ones with Python.


@query("f14_f20_qa_scores")
def f14_f20_qa_scores(spark, d):
    return labels.qa_scores(S.qa(spark, d)).select("pair_id", "exact", "relaxed", r6("f1").alias("f1"), r6("acc").alias("acc"))


@query("f21_set_f1", f"WITH {S.TURNS}, t AS (SELECT pair_id, list_distinct({S.words('lower(prediction)')}) AS a, list_distinct({S.words('lower(gold)')}) AS b FROM qa) SELECT pair_id, round(CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t")
def f21_set_f1(spark, d):
    return S.qa(spark, d).select("pair_id", r6(X.set_f1(F.col("prediction"), F.col("golds")[0])).alias("f1"))


@query("a12_exact_match_mean", f"WITH {S.TURNS} SELECT round(avg(CASE WHEN lower(trim(prediction)) = lower(trim(gold)) THEN 1.0 ELSE 0.0 END), 6) AS em, count(*) AS n FROM qa")
def a12_exact_match_mean(spark, d):
    same = F.lower(F.trim("prediction")) == F.lower(F.trim(F.col("golds")[0]))
    return S.qa(spark, d).agg(r6(F.avg(same.cast("double"))).alias("em"), F.count(F.lit(1)).alias("n"))


#: Every pair, its texts normalised without being decomposed, which is what SQL can do.
_PLAIN = f"""{S.TURNS}, n AS (SELECT pair_id, {S.norm('prediction')} AS p, {S.norm('gold')} AS g FROM qa), t AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS a, list_filter(string_split(g, ' '), lambda w: w <> '') AS b FROM n),
 c AS (SELECT *, coalesce(list_sum([least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))) FOR w IN list_distinct(b)]), 0) AS common FROM t),
 s AS (SELECT pair_id, CASE WHEN p = g THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN g <> '' AND contains(' ' || p || ' ', ' ' || g || ' ') THEN 1.0 ELSE 0.0 END AS relaxed, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * common / (len(a) + len(b)) END AS f1 FROM c)"""


@query("f15_f20_plain_scores", f"WITH {_PLAIN} SELECT pair_id, CAST(exact AS DOUBLE) AS exact, CAST(relaxed AS DOUBLE) AS relaxed, round(f1, 6) AS f1, round(0.5 * relaxed + 0.5 * f1, 6) AS acc FROM s")
def f15_f20_plain_scores(spark, d):
    return labels.qa_scores(S.qa(spark, d), ascii_only=True).select("pair_id", "exact", "relaxed", r6("f1").alias("f1"), r6("acc").alias("acc"))


@query("f22_plain_labels", f"WITH {_PLAIN}, x AS (SELECT pair_id, split_part(pair_id, ':', 1) AS conv, 0.5 * relaxed + 0.5 * f1 AS acc FROM s) SELECT pair_id, round(greatest(-1.0, least(1.0, acc - min(acc) OVER (PARTITION BY conv))), 6) + 0.0 AS u_true FROM x")
def f22_plain_labels(spark, d):
    acc = labels.qa_scores(S.qa(spark, d), ascii_only=True).select("pair_id", F.split_part("pair_id", F.lit(":"), F.lit(1)).alias("conv"), "acc")
    base = acc.groupBy("conv").agg(F.min("acc").alias("base"))
    return acc.join(base, "conv").select("pair_id", r6(X.utility(F.col("acc"), F.col("base"))).alias("u_true"))


@query("f22_utility_label")
def f22_utility_label(spark, d):
    acc = labels.qa_scores(S.qa(spark, d)).select("pair_id", F.split_part("pair_id", F.lit(":"), F.lit(1)).alias("conv"), "acc")
    base = acc.groupBy("conv").agg(F.min("acc").alias("base"))
    return acc.join(base, "conv").select("pair_id", r6(X.utility(F.col("acc"), F.col("base"))).alias("u_true"))


@query("f28_answer_containment")
def f28_answer_containment(spark, d):
    """The whole benchmark text as gold, in any script; DuckDB can't decompose, so tests compare with Python."""
    golds = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(labels.normalized(F.col("text"))).alias("golds"))
    pairs = _pairs(spark, d).select("query_id", "passage_id", labels.normalized(F.col("text")).alias("text")).join(golds, "query_id")
    return labels.containment(pairs).select("query_id", "passage_id", "label", "yes_no")


@query("f26_parse_ranking", """WITH t AS (SELECT user_id AS query_id, string_agg('[' || CAST(json_extract_string(props, '$.k') AS INT) % 9 || ']', ' > ' ORDER BY event_id) AS answer FROM events GROUP BY 1),
 n AS (SELECT query_id, list_filter([CAST(x AS INT) FOR x IN regexp_extract_all(answer, '\\[(\\d+)\\]', 1)], lambda x: x BETWEEN 1 AND 6) AS named FROM t),
 o AS (SELECT query_id, list_filter(named, lambda x, i: list_position(named, x) = i) AS places FROM n), e AS (SELECT query_id, places, unnest(range(1, 7)) AS passage FROM o)
 SELECT query_id, CAST(passage AS INT) AS passage, CASE WHEN list_contains(places, CAST(passage AS INT)) THEN CAST(1 - list_position(places, CAST(passage AS INT)) AS DOUBLE) ELSE -6.0 END + 0.0 AS score FROM e""")
def f26_parse_ranking(spark, d):
    k = F.concat(F.lit("["), (F.get_json_object("props", "$.k").cast("int") % 9).cast("string"), F.lit("]"))
    lists = S.table(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", k.alias("k")))).alias("l"))
    answers = lists.select("query_id", F.array_join(F.transform("l", lambda s: s["k"]), " > ").alias("answer"))
    return answers.select("query_id", F.posexplode(X.parse_ranking(F.col("answer"), F.lit(6))).alias("i", "score")).select("query_id", (F.col("i") + 1).alias("passage"), (F.col("score") + F.lit(0.0)).alias("score"))


@query("p3_yes_no", "SELECT conv_id, turn, lower(trim(text)) IN ('yes', 'no') OR lower(role) IN ('yes', 'no') AS yes_no FROM conversations")
def p3_yes_no(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", X.is_yes_no(F.array("text", "role")).alias("yes_no"))


@query("l3_utility_labels_mock")
def l3_utility_labels_mock(spark, d):
    """Labels with a mock answerer behind the pandas UDF: rows only."""
    asked = S.questions(spark, d).withColumn("golds", X.words(F.col("query")))
    return labels.utility_labels(asked, _pairs(spark, d).select("query_id", "passage_id", "text"))


# ---------------------------------------------------------------- features, pipeline, prompts

_READ = "0.39e0 * greatest(n, 1) / s + 11.8e0 * greatest(v, greatest(n, 1)) / greatest(n, 1) - 15.59e0"
_NLI = lambda k: f"exp(4.0 * {S.u(f'''chr({ord(k)}) || ':' || claim || text''')} - 2.0)"
_FEATURES = f"""{_PAIRS}, c AS (SELECT *, {_statement_sql('query')} AS claim, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END AS scale,
  row_number() OVER w - 1 AS r, lead(score) OVER w AS nxt FROM pairs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, passage_id)),
 x AS (SELECT *, len({S.words('text')}) AS n, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS v, {_ENT('query')} AS eq, {_ENT('text')} AS ep, {_CONTENT('claim')} AS ca, {_CONTENT('text')} AS cp,
  {_NLI('c')} AS lc, {_NLI('e')} AS le, {_NLI('n')} AS ln_, 2.5 + 1.5 * {S.u('query')} AS hb, 0.5 + 4.5 * {S.u('query || text')} AS h FROM c),
 f AS (SELECT query_id, passage_id, score / scale AS bm25_norm, CAST(0 AS DOUBLE) AS dense_score, CAST(r AS DOUBLE) AS rank, coalesce(score - nxt, 0) / scale AS score_gap, CAST(n AS DOUBLE) AS token_length, {_READ} AS readability, CAST(0.5 AS DOUBLE) AS source_credibility,
  len(list_intersect(eq, ep)) / greatest(len(eq), 1) AS entity_overlap, CASE WHEN len(ca) = 0 THEN 0.0 ELSE len(list_intersect(ca, cp)) / len(ca) END AS answerability, le / (lc + le + ln_) AS entailment, lc / (lc + le + ln_) AS contradiction, h AS entropy, hb - h AS delta_entropy, exp(h) AS perplexity FROM x)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_matrix(_pairs(spark, d).select("query_id", "passage_id", "query", "text", "score"))


@query("m29_feature_matrix", f"WITH {_FEATURES} SELECT query_id, passage_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in FEATURES)} FROM f")
def m29_feature_matrix(spark, d):
    return _features(spark, d).select("query_id", "passage_id", *[r6(c).alias(c) for c in FEATURES])


@query("p8_baseline_scores", f"WITH {_FEATURES} SELECT query_id, passage_id, model, round(score, 6) + 0.0 AS score FROM (SELECT query_id, passage_id, bm25_norm AS bm25, dense_score AS dense, -token_length AS shortest, token_length AS length_only FROM f) w UNPIVOT (score FOR model IN (bm25, dense, shortest, length_only))")
def p8_baseline_scores(spark, d):
    return features.baseline_scores(_features(spark, d)).withColumn("score", r6("score"))


@query("p9_constant_columns", f"WITH {_FEATURES} SELECT feature, is_constant FROM (SELECT {', '.join(f'max({c}) - min({c}) = 0 AS {c}' for c in FEATURES)} FROM f) w UNPIVOT (is_constant FOR feature IN ({', '.join(FEATURES)}))")
def p9_constant_columns(spark, d):
    return metrics.constant_columns(_features(spark, d), FEATURES)


@query("f23_f24_softmax_entropy", """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS l FROM embeddings), s AS (SELECT vec_id, [exp(x - list_max(l)) FOR x IN l] AS r FROM e), p AS (SELECT vec_id, [x / list_sum(r) FOR x IN r] AS p FROM s)
 SELECT vec_id, round(p[1], 6) AS first, round(-list_sum([x * ln(x) FOR x IN p]), 6) AS entropy, round(exp(-list_sum([x * ln(x) FOR x IN p])), 6) AS perplexity FROM p""")
def f23_f24_softmax_entropy(spark, d):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = S.table(spark, d, "embeddings").select("vec_id", logits.alias("l"))
    h = X.entropy(F.col("l"))
    return rows.select("vec_id", r6(X.softmax(F.col("l"))[0]).alias("first"), r6(h).alias("entropy"), r6(F.exp(h)).alias("perplexity"))


def _linear(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear predictor over the features: utility by bm25 and overlap."""
    predict = lambda f: f.withColumn("prediction", F.round(F.col("bm25_norm") + F.col("entity_overlap") - F.lit(0.1) * F.col("contradiction"), 9))
    return features.rank_passages(_features(spark, d), predict, 0.5, 0.1)


_LINEAR = f"{_FEATURES}, lin AS (SELECT query_id, passage_id, 0.5e0 * round(bm25_norm + entity_overlap - 0.1e0 * contradiction, 9) + 0.1e0 AS utility FROM f), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, passage_id) AS place FROM lin)"


@query("l11_rank_passages", f"WITH {_LINEAR} SELECT query_id, passage_id, round(utility, 4) AS utility, place FROM lr")
def l11_rank_passages(spark, d):
    return _linear(spark, d).select("query_id", "passage_id", F.round("utility", 4).alias("utility"), F.col("place").cast("long").alias("place"))


@query("f30_rag_prompt", f"WITH {_LINEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pl FROM lr WHERE utility > 0.4), t AS (SELECT k.query_id, string_agg('[' || pl || '] ' || c.text, chr(10) || chr(10) ORDER BY pl) AS context FROM k JOIN corpus c ON k.passage_id = c.pid WHERE pl <= 3 GROUP BY 1) SELECT q.query_id, md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Query: ' || query) AS prompt FROM questions q LEFT JOIN t ON q.query_id = t.query_id")
def f30_rag_prompt(spark, d):
    pairs = _pairs(spark, d).select("query_id", "passage_id", "text")
    out = features.prompts(S.questions(spark, d), _linear(spark, d), pairs, 3, 0.4)
    return out.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("m25_answer_plan", f"""WITH {_FEATURES}, b AS (SELECT query_id, passage_id, model, score FROM (SELECT query_id, passage_id, bm25_norm AS bm25, dense_score AS dense, -token_length AS shortest, token_length AS length_only FROM f) w UNPIVOT (score FOR model IN (bm25, dense, shortest, length_only))),
 r AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, passage_id) AS place FROM b), e AS (SELECT *, unnest([1, 3]) AS m FROM r),
 t AS (SELECT model, m, e.query_id, list(c.text ORDER BY place) AS texts FROM e JOIN corpus c ON e.passage_id = c.pid WHERE place <= m GROUP BY ALL UNION ALL SELECT 'none', 0, query_id, [] FROM questions),
 p AS (SELECT model, m, t.query_id, 'Answer the question as briefly as possible, with just the answer span and no explanation.' || chr(10) || chr(10) || CASE len(texts) WHEN 0 THEN '' WHEN 1 THEN 'Passage: ' || texts[1] || chr(10) || chr(10) ELSE array_to_string(list_transform(texts, lambda x, i: 'Passage ' || i || ': ' || x), chr(10) || chr(10)) || chr(10) || chr(10) END || 'Question: ' || query || chr(10) || 'Answer:' AS prompt FROM t JOIN questions q ON t.query_id = q.query_id)
 SELECT model, m, query_id, md5(prompt) AS prompt FROM p""")
def m25_answer_plan(spark, d):
    texts = _pairs(spark, d).select("query_id", "passage_id", "text")
    plan = features.answer_plan(features.baseline_scores(_features(spark, d)), S.questions(spark, d), texts)
    return plan.select("model", "m", "query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("s29_prompt_cache", "SELECT sha1(text) AS key, text IN (SELECT text FROM conversations WHERE turn = 0) AS cached, count(*) AS n FROM conversations GROUP BY ALL")
def s29_prompt_cache(spark, d):
    rows = S.table(spark, d, "conversations")
    cache = rows.where("turn = 0").select(F.sha1(F.col("text").cast("binary")).alias("key")).distinct().withColumn("cached", F.lit(True))
    keyed = rows.select(F.sha1(F.col("text").cast("binary")).alias("key"))
    return keyed.join(cache, "key", "left").groupBy("key", F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- protocol


@query("u5_hash_split", f"WITH {S.CORPUS} SELECT doc_id, {S.u('''lang || ':' || doc_id''')} < 0.3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS is_test FROM documents")
def u5_hash_split(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "lang")
    seen = S.table(spark, d, "labels").join(docs, "doc_id").select(F.concat_ws(":", "lang", "doc_id").alias("key"))
    return protocol.hash_split(docs, F.concat_ws(":", "lang", "doc_id"), 0.3, seen).select("doc_id", "is_test")


@query("u6_salted_subset", f"SELECT doc_id FROM documents WHERE {S.u('CAST(doc_id AS VARCHAR)')} < 0.3 OR {S.u('''concat('m2', doc_id)''')} < 0.4")
def u6_salted_subset(spark, d):
    return protocol.salted_subset(S.table(spark, d, "documents").select("doc_id"), F.col("doc_id").cast("string")).select("doc_id")


@query("w4_group_folds", f"SELECT query_id, CAST(ntile(5) OVER (ORDER BY {S.u('''concat('0:', query_id)''')}, query_id) AS INT) AS fold FROM (SELECT DISTINCT user_id AS query_id FROM events) e")
def w4_group_folds(spark, d):
    return protocol.group_folds(S.scored(spark, d), "query_id", 5, 0)


@query("w5_repeated_folds", " UNION ALL ".join(f"SELECT query_id, CAST(ntile(5) OVER (ORDER BY {S.u(f'''concat('{r}:', query_id)''')}, query_id) AS INT) AS fold, {r} AS repeat FROM (SELECT DISTINCT user_id AS query_id FROM events) e" for r in range(3)))
def w5_repeated_folds(spark, d):
    return protocol.repeated_folds(S.scored(spark, d), "query_id", 5, 3, 0)


@query("u7_leave_one_out", "WITH n AS (SELECT DISTINCT event_type AS dataset FROM events) SELECT h.dataset AS held_out, n.dataset, CASE WHEN h.dataset = n.dataset THEN 'test' ELSE 'train' END AS role FROM n, n h")
def u7_leave_one_out(spark, d):
    return protocol.leave_one_out(S.scored(spark, d))


@query("u1_pool_tables", "SELECT event_type AS dataset, event_type || ':' || user_id AS query_id, count(*) AS n FROM events GROUP BY ALL")
def u1_pool_tables(spark, d):
    rows = S.scored(spark, d).withColumn("label_source", F.lit("utility"))
    tables = [rows.where(F.pmod("passage_id", F.lit(2)) == i) for i in (0, 1)]
    return protocol.pool(tables).groupBy("dataset", "query_id").agg(F.count(F.lit(1)).alias("n"))


@query("u2_u4_seen_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def u2_u4_seen_ids(spark, d):
    return protocol.not_seen(S.table(spark, d, "documents").select("doc_id", "lang"), S.table(spark, d, "labels"), ["doc_id"])


@query("a3_center_by_query", f"WITH {S.LINES} SELECT query_id, passage_id, {', '.join(f'round({c} - avg({c}) OVER (PARTITION BY query_id), 6) + 0.0 AS {c}' for c in ('x1', 'x2', 'x3', 'x4'))} FROM lines")
def a3_center_by_query(spark, d):
    cols = ("x1", "x2", "x3", "x4")
    return protocol.centered(S.lines(spark, d), cols).select("query_id", "passage_id", *[r6(c).alias(c) for c in cols])


@query("w9_mix_target", f"WITH {S.LINES}, c AS (SELECT query_id, passage_id, x1 - avg(x1) OVER (PARTITION BY query_id) AS a, x3 - avg(x3) OVER (PARTITION BY query_id) AS b FROM lines), s AS (SELECT stddev_pop(a) + 1e-12 AS sa, stddev_pop(b) + 1e-12 AS sb FROM c) SELECT query_id, passage_id, round((a / sa + b / sb) / 2, 6) + 0.0 AS target FROM c, s")
def w9_mix_target(spark, d):
    return protocol.standard_target(S.lines(spark, d), ("x1", "x3")).select("query_id", "passage_id", r6("target").alias("target"))


@query("w8_shuffled_labels", f"WITH {S.SCORED}, a AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY passage_id) AS p FROM scored), b AS (SELECT query_id, y, row_number() OVER (PARTITION BY query_id ORDER BY {S.u('''concat('0:', passage_id)''')}, passage_id) AS p FROM scored) SELECT a.query_id, passage_id, y AS shuffled FROM a JOIN b ON a.query_id = b.query_id AND a.p = b.p")
def w8_shuffled_labels(spark, d):
    return protocol.shuffled_within(S.scored(spark, d), "y", "passage_id").select("query_id", "passage_id", "shuffled")


@query("k7_sample_items", f"SELECT doc_id, source FROM documents ORDER BY {S.u('''concat('0:', doc_id)''')}, doc_id LIMIT 100")
def k7_sample_items(spark, d):
    return protocol.sample_items(S.table(spark, d, "documents").select("doc_id", "source"), 100, "doc_id")


@query("p13_first_queries", f"WITH {S.SCORED}, q AS (SELECT dataset, query_id, min(passage_id) AS o FROM scored GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY o, query_id) AS r FROM q) SELECT s.dataset, s.query_id, passage_id FROM scored s JOIN r ON s.dataset = r.dataset AND s.query_id = r.query_id WHERE r <= 10")
def p13_first_queries(spark, d):
    return protocol.first_queries(S.scored(spark, d), 10, "passage_id").select("dataset", "query_id", "passage_id")


@query("p14_dataset_min_size", f"WITH {S.SCORED}, n AS (SELECT dataset, count(DISTINCT query_id) AS n_queries FROM scored GROUP BY 1) SELECT dataset, n_queries FROM n WHERE n_queries >= 10")
def p14_dataset_min_size(spark, d):
    return S.scored(spark, d).groupBy("dataset").agg(F.countDistinct("query_id").alias("n_queries")).where("n_queries >= 10")


@query("w7_query_ordinals", f"WITH {S.SCORED} SELECT query_id, row_number() OVER (PARTITION BY dataset ORDER BY o) AS ordinal, dataset FROM (SELECT dataset, query_id, min(passage_id) AS o FROM scored GROUP BY ALL) x")
def w7_query_ordinals(spark, d):
    first = S.scored(spark, d).groupBy("dataset", "query_id").agg(F.min("passage_id").alias("o"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("dataset").orderBy("o")).cast("long").alias("ordinal"), "dataset")


@query("j7_aligned_join", "SELECT d.doc_id, quality, toxic, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j7_aligned_join(spark, d):
    return protocol.aligned(S.table(spark, d, "labels"), S.table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"]).select("doc_id", "quality", "toxic", "n_chars")


@query("j13_source_target_matrix", f"WITH {S.SCORED}, m AS (SELECT dataset, avg(y) AS m FROM scored GROUP BY 1) SELECT a.dataset AS source, b.dataset AS target, round(a.m - b.m, 6) + 0.0 AS gap FROM m a, m b")
def j13_source_target_matrix(spark, d):
    m = S.scored(spark, d).groupBy("dataset").agg(F.avg("y").alias("m"))  # a row for each dataset
    left, right = m.select(F.col("dataset").alias("source"), F.col("m").alias("a")), m.select(F.col("dataset").alias("target"), F.col("m").alias("b"))
    return left.crossJoin(right).select("source", "target", r6(F.col("a") - F.col("b")).alias("gap"))


# ---------------------------------------------------------------- statistics

_BOOT = f"""{S.SCORED}, {_PQD}, v AS (SELECT ds, query_id, spearman AS x, row_number() OVER (PARTITION BY ds ORDER BY query_id) AS pos, count(*) OVER (PARTITION BY ds) AS n FROM pq),
 d AS (SELECT ds, rep, pos AS slot, n, 1 + CAST(floor({S.u("rep || ':' || pos")} * n) AS BIGINT) AS pick FROM v, (SELECT unnest(range(0, 200)) AS rep) r), m AS (SELECT d.ds, rep, avg(x) AS m FROM d JOIN v ON d.ds = v.ds AND d.pick = v.pos GROUP BY ALL),
 e AS (SELECT ds, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)"""


@query("a19_bootstrap_ci", f"WITH {_BOOT}, a AS (SELECT ds, avg(x) AS mean FROM v GROUP BY 1) SELECT a.ds AS dataset, round(mean, 6) + 0.0 AS mean, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM a JOIN e ON a.ds = e.ds")
def a19_bootstrap_ci(spark, d):
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))
    out = stats.hash_bootstrap(per, "spearman", "query_id", ["dataset"], 200)
    return out.select("dataset", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@query("a19_bootstrap_exact")
def a19_bootstrap_exact(spark, d):
    """With NumPy's generator; tests compare with the same draws in Python."""
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))
    return stats.exact_bootstrap(per, "spearman", "query_id", ["dataset"], 2000)


def _spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))


@query("a19_bootstrap_merged")
def a19_bootstrap_merged(spark, d):
    """2 000 draws as sums that merge; tests hold them against the multinomial law and a plain bootstrap."""
    return resampling.bootstrap_ci(_spearman(spark, d), "spearman", ["query_id"], ["dataset"], 2000)


@query("m11_sign_flip_merged")
def m11_sign_flip_merged(spark, d):
    """200 000 flips; tests hold p against enumeration."""
    return resampling.sign_flip(_spearman(spark, d), "spearman", ["query_id"], ["dataset"], 200_000)


@query("a20_clustered_test")
def a20_clustered_test(spark, d):
    """10 000 draws and 20 000 flips of questions that all datasets share."""
    return resampling.clustered(_spearman(spark, d).select(F.col("dataset").alias("llm"), "query_id", F.col("spearman").alias("d")))


@query("m11_sign_flip", f"""WITH {S.SCORED}, {_PQD}, v AS (SELECT ds, query_id, spearman AS x FROM pq), a AS (SELECT ds, count(*) AS n, avg(x) AS mean FROM v GROUP BY 1),
 f AS (SELECT ds, rep, avg(CASE WHEN {S.u("rep || ':' || query_id")} < 0.5 THEN -x ELSE x END) AS m FROM v, (SELECT unnest(range(0, 500)) AS rep) r GROUP BY ALL)
 SELECT a.ds AS dataset, n, round(mean, 6) + 0.0 AS mean, round((sum(CASE WHEN abs(m) >= abs(mean) - 1e-15 THEN 1.0 ELSE 0 END) + 1) / 501.0, 6) AS p FROM f JOIN a ON f.ds = a.ds GROUP BY ALL""")
def m11_sign_flip(spark, d):
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id"))
    return stats.hash_sign_flip(per, "spearman", "query_id", ["dataset"], 500).select("dataset", "n", r6("mean").alias("mean"), r6("p").alias("p"))


@query("m10_holm", f"""WITH {S.SCORED}, p AS (SELECT dataset AS test, avg(score) / 1000 AS p FROM scored GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM p)
 SELECT test, round(p, 6) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r""")
def m10_holm(spark, d):
    tests = S.scored(spark, d).groupBy(F.col("dataset").alias("test")).agg((F.avg("score") / 1000).alias("p"))
    return stats.holm(tests).select("test", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


@query("m12_effect_size", f"""WITH {S.SCORED}, {_PQD}, e AS (SELECT ds, count(*) AS n, avg(spearman) AS mean, stddev_samp(spearman) AS sd, count(*) FILTER (spearman > 0) AS w, count(*) FILTER (spearman <> 0) AS nz FROM (SELECT ds, round(spearman, 9) AS spearman FROM pq) z GROUP BY 1)
 SELECT ds AS dataset, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(mean / sd, 6) + 0.0 AS d_z, round(w / nz, 6) AS win_share, round(2.801585 * sd / sqrt(n), 6) AS mde80, CAST(ceil(pow(2.801585 * sd / abs(mean), 2)) AS BIGINT) AS n_needed FROM e""")
def m12_effect_size(spark, d):
    per = metrics.per_query_scores(S.scored(spark, d), ("dataset", "query_id")).withColumn("spearman", F.round("spearman", 9))
    out = stats.effect_size(per, "spearman", ["dataset"])
    return out.select("dataset", "n", *[r6(c).alias(c) for c in ("mean", "sd", "d_z", "win_share", "mde80")], F.col("n_needed").cast("long").alias("n_needed"))


@query("j12_paired_difference", f"""WITH {S.SCORED}, {S.PER_QUERY}, o AS (SELECT query_id, passage_id, dataset, y, -score AS score FROM scored), {S.PER_QUERY.replace('FROM scored', 'FROM o').replace('pq', 'po')}
 SELECT pq.query_id, 'reverse' AS other, round(pq.spearman - po.spearman, 6) + 0.0 AS d FROM pq JOIN po ON pq.query_id = po.query_id""")
def j12_paired_difference(spark, d):
    rows = S.scored(spark, d)
    both = rows.withColumn("model", F.lit("forward")).unionByName(rows.withColumn("score", -F.col("score")).withColumn("model", F.lit("reverse")))
    per = metrics.per_query_scores(both, ("model", "query_id"))
    return stats.paired_difference(per, "forward").select("query_id", "other", r6("d").alias("d"))


@query("a20_clustered_bootstrap", f"""WITH {S.SCORED}, d AS (SELECT dataset AS llm, query_id, avg(y) AS d FROM scored GROUP BY ALL), q AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM d) x),
 s AS (SELECT rep, 1 + CAST(floor({S.u("rep || ':' || pos")} * n) AS BIGINT) AS pick FROM q, (SELECT unnest(range(0, 200)) AS rep) r), w AS (SELECT rep, query_id, count(*) AS w FROM s JOIN q ON s.pick = q.pos GROUP BY ALL),
 m AS (SELECT rep, llm, sum(w * d) / sum(w) AS m FROM w JOIN d ON w.query_id = d.query_id GROUP BY ALL), b AS (SELECT rep, avg(m) AS m FROM m GROUP BY 1)
 SELECT (SELECT round(avg(m), 6) FROM (SELECT llm, avg(d) AS m FROM d GROUP BY 1) z) AS macro, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM b""")
def a20_clustered_bootstrap(spark, d):
    diffs = S.scored(spark, d).groupBy(F.col("dataset").alias("llm"), "query_id").agg(F.avg("y").alias("d"))
    return stats.clustered_difference(diffs, 200).select(*[r6(c).alias(c) for c in ("macro", "lo", "hi")])


@query("a22_label_agreement", f"WITH {S.SCORED}, {S.PER_QUERY} SELECT round(avg(spearman), 6) + 0.0 AS agreement, count(*) AS n FROM pq")
def a22_label_agreement(spark, d):
    return metrics.per_query_scores(S.scored(spark, d)).agg(r6(F.avg("spearman")).alias("agreement"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- models


@query("m4_linear_calibrator", f"""WITH {S.SCORED}, c AS (SELECT dataset, covar_pop(y, score) AS c, var_pop(score) AS v, avg(score) AS b, avg(y) AS t FROM scored GROUP BY 1), s AS (SELECT *, CASE WHEN v > 0 THEN c / v END AS s FROM c)
 SELECT dataset, round(CASE WHEN s IS NULL OR s <= 0 THEN 1.0 ELSE s END, 6) AS alpha, round(t - CASE WHEN s IS NULL OR s <= 0 THEN 1.0 ELSE s END * b, 6) + 0.0 AS beta, s IS NULL OR s <= 0 AS fell_back FROM s""")
def m4_linear_calibrator(spark, d):
    out = models.linear_calibrator(S.scored(spark, d), "score", "y", ["dataset"])
    return out.select("dataset", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "fell_back")


def _regression(spark: SparkSession, d: str) -> DataFrame:
    rows = S.lines(spark, d).withColumn("y", F.col("x3") * 10 + F.col("x1") / 50)
    return rows


@query("m2_ridge_single", f"""WITH {S.LINES}, c AS (SELECT query_id, passage_id, x1 / 50 + 10 * x3 AS y, x1 FROM lines), m AS (SELECT avg(x1) AS mx, avg(y) AS my, stddev_pop(x1) AS sx, count(*) AS n, covar_pop(x1, y) AS c FROM c)
 SELECT query_id, passage_id, round(my + (c * n / sx) / (n + 100.0) * (x1 - mx) / sx, 6) + 0.0 AS prediction FROM c, m""")
def m2_ridge_single(spark, d):
    rows = _regression(spark, d)
    model = models.Predictor(("x1",), "ridge").fit(rows)
    return model.predict(rows).select("query_id", "passage_id", r6("prediction").alias("prediction"))


@query("m1_ridge_centered_within_query")
def m1_ridge_centered_within_query(spark, d):
    rows = _regression(spark, d)
    model = models.Predictor(("x1", "x2", "x3", "x4"), "ridge", True).fit(rows, "y", "query_id")
    out = model.predict(rows, "query_id").withColumn("score", F.round("prediction", 9))
    return metrics.ranking_summary(out)


@query("m3_boosted_trees")
def m3_boosted_trees(spark, d):
    rows = _regression(spark, d)
    model = models.Predictor(("x1", "x2", "x3", "x4"), "gbr", True, {"n_estimators": 10, "max_depth": 2}).fit(rows, "y", "query_id")
    return metrics.ranking_summary(model.predict(rows, "query_id").withColumn("score", F.col("prediction")))


@query("m5_feature_adapter")
def m5_feature_adapter(spark, d):
    rows = _regression(spark, d).withColumn("base", F.col("x1"))
    few = protocol.sample_items(rows, 32, "query_id")
    return models.FeatureSpaceAdapter(("x1", "x3", "x4")).fit(few).transform(rows).select("query_id", "passage_id", r6("adapted").alias("adapted"))


@query("m6_m7_hidden_probe")
def m6_m7_hidden_probe(spark, d):
    rows = S.table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("passage_id"), "embedding", (F.col("label") == 3).cast("double").alias("y"))
    return models.hidden_probe(rows, "embedding", "y", F.pmod("query_id", F.lit(5)) != 0).select("query_id", "passage_id", r6("probe").alias("probe"))


_X = ("x1", "x2", "x3", "x4")
_RIDGE = grams.Ridge("ridge", 100.0, True)


@query("m7_out_of_fold_probe")
def m7_out_of_fold_probe(spark, d):
    """Four fifths of the queries are scored by probes of the other folds, the rest by one of all four fifths."""
    rows = S.table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("passage_id"), "embedding", (F.col("label") == 3).cast("double").alias("y"))
    got = probes.with_probe(rows.withColumn("train", F.pmod("query_id", F.lit(5)) != 0), "embedding", "y", "train")
    return got.select("query_id", "passage_id", "fold", r6("probe").alias("probe"))


@query("m16_cv_report")
def m16_cv_report(spark, d):
    """Five folds, four repeats, 2 000 draws: metrics of a ridge and of two columns taken as scores."""
    return grams.intervals(grams.cross_validated_wide(_regression(spark, d), _X, [_RIDGE], {"size": "x1", "price": "x2"}))


@query("m16_cv_pairs")
def m16_cv_pairs(spark, d):
    """The same by dataset, as differences paired by query."""
    per = grams.cross_validated_wide(_regression(spark, d), _X, [_RIDGE], {"size": "x1", "price": "x2"})
    return grams.paired_intervals(per, "ridge", ["dataset"])


#: By dataset and query: queries of these tables can lie in several datasets.
_PAIRED_KEY = "dataset || ':' || query_id"
_SINGLE = f"{S.LINES}, c AS (SELECT dataset, query_id, passage_id, x1 / 50 + 10 * x3 AS y, x2 AS x FROM lines), z AS (SELECT *, avg(x) OVER (PARTITION BY dataset, query_id) AS mx, avg(y) OVER (PARTITION BY dataset, query_id) AS my FROM c), h AS (SELECT DISTINCT dataset AS h FROM c)"


@query("m17_lodo_single", f"""WITH {_SINGLE}, w AS (SELECT h, sign(covar_pop(x, y)) AS s FROM h, c WHERE dataset <> h GROUP BY h),
 scored AS (SELECT {_PAIRED_KEY} AS query_id, passage_id, dataset, y, s * x AS score FROM c JOIN w ON dataset = h), {S.PER_QUERY}
 SELECT ds AS dataset, round(avg(spearman), 6) + 0.0 AS spearman, round(avg(ndcg), 6) AS ndcg, round(avg(top1), 6) AS top1, count(*) AS n_queries FROM pq GROUP BY 1""")
def m17_lodo_single(spark, d):
    """A ridge of one column ranks by it, up or down as the other datasets say."""
    per = grams.left_out_metrics(_regression(spark, d), ("x2",), [grams.Ridge("ridge", 100.0)])
    return per.groupBy("dataset").agg(*[r6(F.avg(m)).alias(m) for m in grams.METRICS], F.count(F.lit(1)).alias("n_queries"))


@query("m17_lodo_report")
def m17_lodo_report(spark, d):
    """Each dataset by a model of all others, with intervals and a column as baseline; datasets are those in the table."""
    return grams.intervals(grams.left_out_wide(_regression(spark, d), ("x1", "x2", "x4"), [_RIDGE], {"price": "x2"}), ["dataset"])


@query("m17_lodo_macro")
def m17_lodo_macro(spark, d):
    return metrics.macro_average(grams.left_out_metrics(_regression(spark, d), ("x1", "x2", "x4"), [_RIDGE]), keys=("model",))


@query("m18_nested_single", f"""WITH {_SINGLE}, p AS (SELECT a.h AS h, b.h AS d FROM h a, h b), t AS (SELECT p.h, p.d, z.* FROM p JOIN z ON z.dataset <> p.h AND z.dataset <> p.d),
 w AS (SELECT h, d, 0 AS place, 'raw' AS m, sign(covar_pop(x, y)) AS s FROM t GROUP BY h, d UNION ALL SELECT h, d, 3, 'centered', sign(sum((x - mx) * (y - my))) FROM t GROUP BY h, d),
 scored AS (SELECT concat_ws(':', m, h, d, query_id) AS query_id, passage_id, concat_ws(':', m, h, d) AS dataset, y, s * x AS score FROM c JOIN w ON dataset = d), {S.PER_QUERY},
 rho AS (SELECT place, m, h, d, round(coalesce(r, 0.0), 9) AS rho FROM w LEFT JOIN (SELECT ds, avg(spearman) AS r FROM pq GROUP BY 1) q ON ds = concat_ws(':', m, h, d)),
 i AS (SELECT h, place, m, round(avg(rho), 9) AS inner_score FROM rho WHERE h <> d GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY inner_score DESC, place) AS r FROM i)
 SELECT b.h AS dataset, 'ridge(a=10)-' || b.m AS selected, round(inner_score, 6) + 0.0 AS "inner", round(rho, 6) + 0.0 AS spearman, (SELECT round(max(x.rho), 6) + 0.0 FROM rho x WHERE x.h = b.h AND x.d = b.h) AS oracle
 FROM b JOIN rho ON rho.h = b.h AND rho.d = b.h AND rho.m = b.m WHERE r = 1""")
def m18_nested_single(spark, d):
    """The whole ridge grid on one column, which ranks up or down: penalties tie, raw and centred may differ."""
    got = grams.nested(_regression(spark, d), ("x2",), grams.ridge_grid()).summary()
    return got.select("dataset", "selected", *[r6(c).alias(c) for c in ("inner", "spearman", "oracle")])


@query("m18_nested_lodo")
def m18_nested_lodo(spark, d):
    """The whole ridge grid on three columns: what is chosen inside, its score outside, and the oracle's."""
    return grams.nested(_regression(spark, d), ("x1", "x2", "x4"), grams.ridge_grid()).summary()


@query("m18_nested_optimism")
def m18_nested_optimism(spark, d):
    """nested, oracle, optimism, and the configuration for all data."""
    got = grams.nested(_regression(spark, d), ("x1", "x2", "x4"), grams.ridge_grid())
    return got.macro().crossJoin(F.broadcast(got.final().select(F.col("model").alias("final"))))


_GROUPS = {"size": ("x1", "x2"), "rate": ("x3", "x4")}


@query("m20_ablation")
def m20_ablation(spark, d):
    """Five folds, four repeats; every group left out and every group alone, from the same Gram matrices."""
    per = grams.cross_validated_metrics(_regression(spark, d), _X, grams.subsets(_GROUPS, _X), ("query_id",))
    return per.groupBy("model").agg(*[F.avg(m).alias(m) for m in grams.METRICS], F.count(F.lit(1)).alias("n_queries"))


@query("m20_ablation_lodo")
def m20_ablation_lodo(spark, d):
    """The subsets with and without centring, each dataset held out."""
    both = [grams.Ridge(f"{m.name}-{tag}", m.alpha, c, m.columns) for tag, c in (("raw", False), ("centered", True)) for m in grams.subsets(_GROUPS, _X)]
    return metrics.macro_average(grams.left_out_metrics(_regression(spark, d), _X, both), keys=("model",))


@query("m19_proxy_transfer")
def m19_proxy_transfer(spark, d):
    rows = _regression(spark, d)
    targets = {x: rows.where(F.col("dataset") == x) for x in ("N", "R")}
    return models.transfer(rows.where("dataset = 'A'"), targets, models.Config("ridge", "ridge", True, (("alpha", 100.0),)), ("x1", "x2", "x4"))


@query("m21_few_shot")
def m21_few_shot(spark, d):
    rows = S.scored(spark, d).withColumn("base", F.col("score"))
    return metrics.ranking_summary(models.few_shot(rows, 50, "base", "y"))


@query("l6_mock_probe", f"WITH {_PAIRS}, x AS (SELECT query_id, passage_id, 2.5 + 1.5 * {S.u('query')} AS b, 0.5 + 4.5 * {S.u('query || text')} AS h FROM pairs) SELECT query_id, passage_id, round(b, 6) AS h_base, round(h, 6) AS entropy, round(b - h, 6) + 0.0 AS delta_entropy, round(exp(h), 6) AS perplexity FROM x")
def l6_mock_probe(spark, d):
    made = scorers.mock_probe(F.col("query"), F.col("text"))
    return _pairs(spark, d).select("query_id", "passage_id", *[r6(c).alias(n) for n, c in made.items()])


# ---------------------------------------------------------------- parsers


#: Raw rows of the datasets are made of whole documents: their lines and all words of them.
_RAW = "raw AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS lines, string_split(coalesce(text, ''), ' ') AS ws, coalesce(text, '') AS text FROM documents)"
_FILLED = lambda x: f"list_filter({x}, lambda w: trim(w) <> '')"
_BY_LINE = "(SELECT *, lines[j] AS line, string_split(lines[j], ' ') AS line_words FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS j FROM raw) l0)"
_PASSAGE = """'"' || line_words[1] || '"' || chr(10) || line"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return S.table(spark, d, "documents").select("doc_id", "lang", text.alias("text"), F.split(text, "\n").alias("lines"), F.split(text, " ").alias("ws"))


_words_of = lambda line: F.split(line, " ")


@query("s7_flashrag_items", f"WITH {_RAW}, r AS (SELECT doc_id, lines[1] AS question, {_FILLED('ws')} AS golds FROM raw) SELECT 'popqa:' || doc_id AS query_id, question AS query, array_to_string(golds, '|') AS golds FROM (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM r) x WHERE n = 1 AND len(golds) > 0")
def s7_flashrag_items(spark, d):
    rows = _raw(spark, d).select(F.col("doc_id").alias("id"), F.col("lines")[0].alias("question"), F.col("ws").alias("golden_answers"))
    return parsers.flashrag(rows, "popqa", dedupe_questions=True).select("query_id", "query", F.array_join("gold_answers", "|").alias("golds"))


@query("s8_hotpot_items", f"""WITH {_RAW} SELECT 'hotpotqa:' || doc_id AS query_id, lines[1] AS query, answer AS gold, 'hotpotqa:' || doc_id || ':p' || (j - 1) AS passage_id, {_PASSAGE} AS text
 FROM (SELECT *, CASE WHEN lang = 'de' THEN 'Yes ' ELSE ws[-1] END AS answer FROM {_BY_LINE} l) x WHERE lower(trim(answer)) NOT IN ('yes', 'no')""")
def s8_hotpot_items(spark, d):
    answer = F.when(F.col("lang") == "de", "Yes ").otherwise(F.element_at("ws", -1))
    context = F.struct(F.transform("lines", lambda x: _words_of(x)[0]).alias("title"), F.transform("lines", _words_of).alias("sentences"))
    items = parsers.hotpot(_raw(spark, d).select(F.col("doc_id").alias("id"), F.col("lines")[0].alias("question"), answer.alias("answer"), context.alias("context")))
    return items.select("query_id", "query", F.col("gold_answers")[0].alias("gold"), F.explode("passages").alias("p")).select("query_id", "query", "gold", F.col("p.id").alias("passage_id"), F.col("p.text").alias("text"))


@query("s9_two_wiki_items", f"""WITH {_RAW} SELECT '2wikimultihopqa:' || doc_id AS query_id, array_to_string({_FILLED("string_split(lines[1], ' ')")}, '|') AS golds, '2wikimultihopqa:' || doc_id || ':p' || (j - 1) AS passage_id, {_PASSAGE} AS text
 FROM {_BY_LINE} l WHERE len({_FILLED("string_split(lines[1], ' ')")}) > 0 AND len(list_filter(string_split(lines[1], ' '), lambda w: lower(trim(w)) IN ('yes', 'no'))) = 0""")
def s9_two_wiki_items(spark, d):
    context = F.struct(F.transform("lines", lambda x: _words_of(x)[0]).alias("title"), F.transform("lines", _words_of).alias("content"))
    rows = _raw(spark, d).select(F.col("doc_id").alias("id"), F.col("lines")[0].alias("question"), _words_of(F.col("lines")[0]).alias("golden_answers"), F.struct(context.alias("context")).alias("metadata"))
    items = parsers.two_wiki(rows).select("query_id", F.array_join("gold_answers", "|").alias("golds"), F.explode("passages").alias("p"))
    return items.select("query_id", "golds", F.col("p.id").alias("passage_id"), F.col("p.text").alias("text"))


@query("s10_musique_items", f"""WITH {_RAW}, g AS (SELECT doc_id, array_to_string(list_filter({S.ordered_distinct('ws')}, lambda w: trim(w) <> ''), '|') AS golds FROM raw)
 SELECT 'musique:' || l.doc_id AS query_id, golds, 'musique:' || l.doc_id || ':p' || (j + 6) AS passage_id, {_PASSAGE} AS text FROM {_BY_LINE} l JOIN g ON l.doc_id = g.doc_id WHERE lang <> 'de'""")
def s10_musique_items(spark, d):
    paragraphs = F.transform("lines", lambda x, i: F.struct((i + 7).alias("idx"), _words_of(x)[0].alias("title"), x.alias("paragraph_text")))
    rows = _raw(spark, d).select(F.col("doc_id").alias("id"), F.col("lines")[0].alias("question"), F.col("ws")[0].alias("answer"), F.col("ws").alias("answer_aliases"), (F.col("lang") != "de").alias("answerable"), paragraphs.alias("paragraphs"))
    items = parsers.musique(rows).select("query_id", F.array_join("gold_answers", "|").alias("golds"), F.explode("passages").alias("p"))
    return items.select("query_id", "golds", F.col("p.id").alias("passage_id"), F.col("p.text").alias("text"))


@query("s11_ragbench_items", f"""WITH {_RAW} SELECT 'ragbench-hotpotqa:' || doc_id || ':p' || (j - 1) AS passage_id, line AS text, round(len(list_intersect(list_distinct(line_words), string_split(lines[-1], ' '))) / len(line_words), 6) AS proxy_label
 FROM {_BY_LINE} l WHERE len(lines) >= 2""")
def s11_ragbench_items(spark, d):
    sentences = F.transform("lines", lambda x: F.transform(_words_of(x), lambda w: F.array(w, w)))
    rows = _raw(spark, d).select(F.col("doc_id").alias("ordinal"), F.col("lines")[0].alias("question"), F.col("lines").alias("documents"), sentences.alias("documents_sentences"), _words_of(F.element_at("lines", -1)).alias("all_utilized_sentence_keys"))
    return parsers.candidates(parsers.ragbench(rows)).select("passage_id", "text", r6("proxy_label").alias("proxy_label"))


@query("s12_entity_questions", f"""WITH {_RAW}, e AS (SELECT 'P' || (doc_id // 100) AS relation, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS j, lines[1] AS question, {_FILLED('ws')} AS golds FROM raw)
 SELECT 'entityquestions:' || relation || '-' || j AS query_id, question AS query, array_to_string(golds, '|') AS golds FROM e WHERE len(golds) > 0""")
def s12_entity_questions(spark, d):
    """A relation's file is a JSON array of a hundred documents' questions."""
    asked = F.struct(F.col("lines")[0].alias("question"), F.col("ws").alias("answers"))
    files_ = _raw(spark, d).groupBy(F.expr("doc_id div 100").alias("k")).agg(F.sort_array(F.collect_list(F.struct("doc_id", asked.alias("ex")))).alias("l"))
    name = F.concat(F.lit("/data/test/P"), F.col("k").cast("string"), F.lit(".test.json"))
    items = parsers.entity_questions(files_.select(name.alias("name"), F.to_json(F.transform("l", lambda x: x["ex"])).alias("content")))
    return items.select("query_id", "query", F.array_join("gold_answers", "|").alias("golds"))


def _samples(samples: DataFrame) -> DataFrame:
    """A row for each passage. Before explode, Spark would filter by the passages' number, and so work all of them out twice."""
    each = samples.select("query", F.array_join("answers", "|").alias("answers"), F.explode_outer("passages").alias("p")).where(F.col("p").isNotNull())
    return each.select("query", "answers", F.col("p.id").alias("passage_id"), F.col("p.text").alias("text"), F.col("p.is_positive").alias("is_positive"))


@query("s15_legacy_ragbench", f"""WITH {_RAW} SELECT lines[1] AS query, ws[1] AS answers, 'ragbench_' || doc_id || '_' || (j - 1) AS passage_id, line AS text, list_has_any(line_words, string_split(lines[-1], ' ')) AS is_positive FROM {_BY_LINE} l""")
def s15_legacy_ragbench(spark, d):
    sentences = F.transform("lines", lambda x: F.transform(_words_of(x), lambda w: F.array(w, w)))
    rows = _raw(spark, d).select(F.col("doc_id").alias("ordinal"), F.col("lines")[0].alias("question"), F.substring_index("text", " ", 1).alias("response"), F.col("lines").alias("documents"), sentences.alias("documents_sentences"), _words_of(F.element_at("lines", -1)).alias("all_relevant_sentence_keys"))
    return _samples(parsers.load_legacy("ragbench", rows))


@query("s16_natural_questions", f"""WITH {_RAW}, t AS (SELECT *, len(ws) // 2 AS half, len(ws) AS n, list_filter(ws, lambda w: NOT regexp_matches(w, '[<>]')) AS plain FROM raw),
 p AS (SELECT doc_id, lines, 0 AS j, list_slice(plain, 1, half) AS part FROM t UNION ALL SELECT doc_id, lines, 1, list_slice(plain, half + 1, n) FROM t)
 SELECT lines[1] AS query, string_split(lines[1], ' ')[1] AS answers, 'nq_' || doc_id || '_' || j AS passage_id, trim(array_to_string(part, ' ')) AS text, false AS is_positive FROM p WHERE trim(array_to_string(part, ' ')) <> ''""")
def s16_natural_questions(spark, d):
    """Two spans that cover all tokens; those with an angle bracket count as HTML."""
    half, n = F.expr("size(ws) div 2").cast("int"), F.size("ws")
    spans = F.struct(F.array(F.lit(0), half).alias("start_token"), F.array(half, n).alias("end_token"))
    tokens = F.struct(F.struct(F.col("ws").alias("token"), F.transform("ws", lambda w: w.rlike("[<>]")).alias("is_html")).alias("tokens"))
    rows = _raw(spark, d).select(F.col("doc_id").alias("ordinal"), F.struct(F.col("lines")[0].alias("text")).alias("question"), F.struct(F.array(F.struct(F.array(_words_of(F.col("lines")[0])[0]).alias("text"))).alias("short_answers")).alias("annotations"), spans.alias("long_answer_candidates"), tokens.alias("document"))
    return _samples(parsers.load_legacy("natural_questions", rows))


@query("s17_msmarco_samples", f"""WITH {_RAW} SELECT 'msmarco_' || doc_id || '_' || (j - 1) AS passage_id, line AS text, j = 1 AS is_positive FROM {_BY_LINE} l WHERE lang <> 'de' AND trim(line) <> ''""")
def s17_msmarco_samples(spark, d):
    answers = F.array(F.when(F.col("lang") == "de", "No Answer Present.").otherwise(F.col("ws")[0]))
    passages = F.struct(F.col("lines").alias("passage_text"), F.transform("lines", lambda x, i: F.when(i == 0, 1).otherwise(0)).alias("is_selected"))
    rows = _raw(spark, d).select(F.col("doc_id").alias("ordinal"), F.col("lines")[0].alias("query"), answers.alias("answers"), passages.alias("passages"))
    return _samples(parsers.load_legacy("msmarco", rows)).select("passage_id", "text", "is_positive")


@query("s18_triviaqa", f"""WITH {_RAW}, x AS (SELECT doc_id, lines[1] AS query, CASE WHEN lang = 'fr' THEN ws[1] ELSE array_to_string(ws, '|') END AS answers, 'wikipedia' AS part, j, line AS text FROM {_BY_LINE} l
 UNION ALL SELECT doc_id, lines[1], CASE WHEN lang = 'fr' THEN ws[1] ELSE array_to_string(ws, '|') END, 'web', 1, text FROM raw)
 SELECT query, answers, 'triviaqa_' || doc_id || '_' || part || '_' || (j - 1) AS passage_id, text, false AS is_positive FROM x WHERE trim(text) <> ''""")
def s18_triviaqa(spark, d):
    aliases = F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.col("ws"))
    rows = _raw(spark, d).select(F.col("doc_id").alias("ordinal"), F.col("lines")[0].alias("question"), F.struct(F.col("ws")[0].alias("value"), aliases.alias("aliases")).alias("answer"), F.struct(F.col("lines").alias("wiki_context")).alias("entity_pages"), F.struct(F.array("text").alias("search_context")).alias("search_results"))
    return _samples(parsers.load_legacy("triviaqa", rows))


@query("f29_prompts", f"""WITH {_PAIRS} SELECT query_id, passage_id, md5('Answer the following question in one sentence.' || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') AS sentence,
 md5('Use the following context to answer the question in one sentence.' || chr(10) || 'Context: ' || text || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') AS context, md5('Context: ' || text || chr(10) || 'Query: ' || query) AS probe,
 md5('Question: ' || query || chr(10) || chr(10) || 'Passage: ' || text || chr(10) || chr(10) || 'Reference answer: x' || chr(10) || chr(10) || '{X.UTILITY_DEFINITION}' || chr(10) || 'Answer with Yes or No only.') AS judged,
 md5('Write exactly one short factual sentence that directly answers the question. Do not add explanation.' || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') AS hyde FROM pairs""")
def f29_prompts(spark, d):
    q, t = F.col("query"), F.col("text")
    made = {"sentence": X.sentence_prompt(q), "context": X.sentence_prompt(q, t), "probe": X.probe_prompt(q, t), "judged": X.utility_prompt(q, t, F.lit("x")), "hyde": X.hyde_prompt(q)}
    return _pairs(spark, d).select("query_id", "passage_id", *[F.md5(c.cast("binary")).alias(n) for n, c in made.items()])


_SPACED = lambda t: S.words(f"lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))")


@query("m27_own_candidates", f"""WITH {_PAIRS}, r AS (SELECT query_id, passage_id, {_SPACED('query')} AS asked, {_SPACED('text')} AS toks FROM pairs),
 n AS (SELECT *, len(toks) AS dl, count(*) OVER (PARTITION BY query_id) AS n, avg(len(toks)) OVER (PARTITION BY query_id) AS avgdl FROM r),
 own AS (SELECT query_id, passage_id, n, dl, avgdl, term, count(*) AS tf, any_value(len(list_filter(asked, lambda w: w = term))) AS times FROM (SELECT *, unnest(toks) AS term FROM n) x GROUP BY query_id, passage_id, n, dl, avgdl, term),
 w AS (SELECT *, ln((n - count(*) OVER (PARTITION BY query_id, term) + 0.5) / (count(*) OVER (PARTITION BY query_id, term) + 0.5)) AS raw FROM own), m AS (SELECT query_id, avg(raw) AS mean FROM (SELECT DISTINCT query_id, term, raw FROM w) x GROUP BY 1),
 sc AS (SELECT w.query_id, passage_id, sum(times * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM w JOIN m ON w.query_id = m.query_id WHERE times > 0 GROUP BY ALL)
 SELECT p.query_id, p.passage_id, round(coalesce(sc.score, 0), 6) + 0.0 AS score FROM pairs p LEFT JOIN sc ON p.query_id = sc.query_id AND p.passage_id = sc.passage_id""")
def m27_own_candidates(spark, d):
    pairs = _pairs(spark, d).select("query_id", F.col("passage_id").alias("pid"), "query", "text")
    return retrieval.own_candidates(pairs).select("query_id", F.col("pid").alias("passage_id"), r6("score").alias("score"))


@query("m13_p_from_interval")
def m13_p_from_interval(spark, d):
    """Bootstrap intervals turned into p values, with each dataset's number of questions; a row for each dataset."""
    return stats.p_values(a19_bootstrap_merged(spark, d)).select("dataset", "se", "z", "p", "asymmetry")


@query("m14_m15_dataset_tests")
def m14_m15_dataset_tests(spark, d):
    return stats.dataset_tests(_spearman(spark, d).withColumnRenamed("spearman", "d"))


@query("m14_pooled")
def m14_pooled(spark, d):
    """All queries of all datasets as one group."""
    return stats.group_tests(_spearman(spark, d), "spearman", ["dataset", "query_id"], [])


@query("m14_dataset_level")
def m14_dataset_level(spark, d):
    """The datasets' means as units."""
    return stats.dataset_level(_spearman(spark, d).groupBy("dataset").agg(F.avg("spearman").alias("mean")))


@query("m14_signed_ranks", f"""WITH {S.SCORED}, {_PQD}, v AS (SELECT ds, round(spearman, 9) AS x FROM pq), z AS (SELECT ds, x, abs(x) AS a FROM v WHERE x <> 0),
 t AS (SELECT ds, a, count(*) AS t, count(*) FILTER (x > 0) AS up FROM z GROUP BY ALL), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY ds ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS r FROM t)
 SELECT ds AS dataset, CAST(sum(t) AS BIGINT) AS n, sum(r * up) AS w, CAST(sum(t * t * t - t) AS DOUBLE) AS ties, max(t) AS most FROM r GROUP BY 1""")
def m14_signed_ranks(spark, d):
    return stats.signed_ranks(_spearman(spark, d).withColumn("spearman", F.round("spearman", 9)), "spearman", ["dataset"])


@query("m22_compare")
def m22_compare(spark, d):
    rows = S.scored(spark, d)
    both = rows.withColumn("model", F.lit("forward")).unionByName(rows.withColumn("score", -F.col("score")).withColumn("model", F.lit("reverse")))
    return studies.compare(both, "forward")[0]


@query("m22_compare_tests")
def m22_compare_tests(spark, d):
    """The paired tests of the same comparison, 200 000 flips, Holm-corrected over datasets."""
    rows = S.scored(spark, d)
    both = rows.withColumn("model", F.lit("forward")).unionByName(rows.withColumn("score", -F.col("score")).withColumn("model", F.lit("reverse")))
    return studies.compare(both, "forward")[1]


@query("m24_fresh_questions")
def m24_fresh_questions(spark, d):
    rows = _regression(spark, d)
    at = X.uniform(F.col("query_id").cast("string"))
    old, fresh = rows.where(at < 0.6), rows.where(at >= 0.3)
    return studies.fresh_questions(old, fresh, models.Config("ridge", "ridge", True, (("alpha", 100.0),)), ("x1", "x2", "x4"))[0]


@query("m28_train")
def m28_train(spark, d):
    return studies.train(_regression(spark, d), models.Config("ridge", "ridge", True, (("alpha", 100.0),)), ("x1", "x2", "x4"))[1]
