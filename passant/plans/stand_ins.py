"""The tables that stand in for questions, passages, scored pairs and answers, as Spark frames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passant.functions import text as X
from passant.operators import labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """pid, text, title, body, dataset (language): documents as passages."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("pid"), F.coalesce("text", F.lit("")).alias("text")).select("pid", "text", X.title_of(F.col("text")).alias("title"), X.body_of(F.col("text")).alias("body"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query: all words of the benchmark items."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(X.words(F.col("text")), " ").alias("query"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """query_id, passage_id, dataset, y, score: events of a user, with many tied scores."""
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("passage_id"), F.col("event_type").alias("dataset"), F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("score"))


def qa(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, prediction, golds: every turn and the next one, in any script."""
    return labels.turn_pairs(table(spark, d, "conversations")).select("pair_id", "prediction", F.array("gold").alias("golds"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A grouped feature matrix: an order's lines."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("passage_id"), F.col("l_returnflag").alias("dataset"), F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("x2"), F.col("l_discount").alias("x3"), F.col("l_tax").alias("x4"))


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP, CONTENT_STOP = _array(X.STOPWORDS), _array(X.CONTENT_STOPWORDS)


def tok(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({STOP}, w))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def ordered_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def norm(text: str) -> str:
    """Articles are matched with their neighbours; twice, as neighbours may be shared. RE2 has no look-around."""
    once = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    plain = once.format(once.format(f"lower({text})"))
    return f"trim(regexp_replace(regexp_replace({plain}, '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"


def u(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) / 4294967296.0)"


CORPUS = "corpus AS (SELECT doc_id AS pid, coalesce(text, '') AS text FROM documents)"
QUESTIONS = f"questions AS (SELECT item_id AS query_id, array_to_string({words('text')}, ' ') AS query FROM benchmark)"
SCORED = "scored AS (SELECT user_id AS query_id, event_id AS passage_id, event_type AS dataset, value AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events)"
TURNS = "qa AS (SELECT pair_id, prediction, gold FROM (SELECT conv_id || ':' || turn AS pair_id, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS gold FROM conversations) turns WHERE gold IS NOT NULL AND prediction IS NOT NULL)"
LINES = "lines AS (SELECT l_orderkey AS query_id, l_linenumber AS passage_id, l_returnflag AS dataset, l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4 FROM lineitem)"
BM25 = f"""{CORPUS}, {QUESTIONS},
 toks AS (SELECT pid, {tok('text')} AS toks FROM corpus), dls AS (SELECT pid, len(toks) AS dl, toks FROM toks),
 stats AS (SELECT count(*) AS n_docs, sum(dl) / greatest(count(*), 1) AS avgdl FROM dls),
 terms AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM questions),
 tf AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, dl, unnest(toks) AS term FROM dls) x WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 df AS (SELECT t.term, count(tf.pid) AS df FROM (SELECT DISTINCT term FROM terms) t LEFT JOIN tf ON t.term = tf.term GROUP BY 1),
 weights AS (SELECT query_id, terms.term, ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM terms JOIN df ON terms.term = df.term, stats),
 hits AS (SELECT query_id, pid, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN weights ON tf.term = weights.term GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pid) - 1 AS rank FROM hits)"""
PER_QUERY = """
 pq0 AS (SELECT *, y - min(y) OVER (PARTITION BY query_id) AS g, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS p,
   row_number() OVER (PARTITION BY query_id ORDER BY y DESC, passage_id) AS i,
   rank() OVER (PARTITION BY query_id ORDER BY y) + (count(*) OVER (PARTITION BY query_id, y) - 1) / 2.0 AS ry,
   rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS rs FROM scored),
 pq1 AS (SELECT *, avg(g) OVER (PARTITION BY query_id, score) AS tied FROM pq0),
 pq2 AS (SELECT query_id, any_value(dataset) AS ds, count(*) AS n, stddev_pop(y) AS sd, stddev_pop(score) AS ss, CASE WHEN stddev_pop(rs) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(ry, rs) / (stddev_pop(ry) * stddev_pop(rs)) END AS rho,
   sum(CASE WHEN p <= 10 THEN tied / log2(p + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS idcg,
   CASE WHEN max(CASE WHEN p = 1 THEN y END) >= max(y) THEN 1.0 ELSE 0.0 END AS top1 FROM pq1 GROUP BY query_id),
 pq AS (SELECT query_id, ds, ss, coalesce(rho, 0.0) AS spearman, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, CAST(top1 AS DOUBLE) AS top1 FROM pq2 WHERE n >= 2 AND sd >= 1e-12)"""
