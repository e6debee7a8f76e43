"""The opN_ queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passant.llm import merkle, mixing, pq_dedup

TOKENIZER_COUNTS = "piece_bpe_32k.model"
TOKENIZER_PACKING = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    from passant.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=200, digests=True).withColumnRenamed("n_tokens", "n_bytes")


def op7_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and n_spans) for every document."""
    from passant.llm.block_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=35, digests=True).withColumnRenamed("n_tokens", "n_words")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    from passant.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(TOKENIZER_COUNTS), limit=4096)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    from passant.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), most_labels=16_000, threshold=0.3)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    from passant.llm.stream_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, p and kept for every document."""
    from passant.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 largest inner products of each query."""
    from passant.llm.pivot_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, factor=64)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every document."""
    from passant.llm.secret_scan import BASE_RULES, find_secrets, joined

    found = find_secrets(_table(spark, sf_dir, "documents"), BASE_RULES)
    of = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    spans = joined(F.col("spans"), BASE_RULES)
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    from passant.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer(TOKENIZER_PACKING), capacity=2048, end_id=0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every document."""
    from passant.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every document."""
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_hash([*map(F.col, merkle.FIELDS[:-1]), lower]))
    rows = merkle.manifest(docs, also={"tampered": tampered})
    return merkle.checked(rows, F.coalesce("tampered", "leaf")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run, exponent_milli and the digests of runs and kept words for every document."""
    from passant.llm.common import whole_text
    from passant.llm.periodic import collapse_runs, listed, longest, planted

    docs = _table(spark, sf_dir, "documents").select("doc_id", whole_text(F.col("text")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.withColumn("words", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, words))
    docs = docs.select("doc_id", F.coalesce(F.array_join(planted(F.col("doc_id"), F.col("words")), " "), "text").alias("text"))
    found = collapse_runs(docs, least=12).withColumn("best", longest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    digests = [F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, *digests)


def op13_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    return pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def _secrets_oracle() -> str:
    """What lies between matches and the matches themselves, measured in turn."""
    from passant.llm.secret_scan import BASE_RULES

    kinds = []
    for order, rule in enumerate(BASE_RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, list_sum([length(gap[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(hit[j]) FOR j IN range(1, i)]), 0) AS start, length(hit[i]) AS size FROM "
            f"(SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}') AS hit, regexp_extract_all(text, '{pattern}', {rule.group}) AS judged FROM d) x) y WHERE length(judged[i]) >= {rule.least}"
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS MATERIALIZED ({' UNION ALL '.join(kinds)}),
        j AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, k) AS spans FROM s GROUP BY 1)
        SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id = j.doc_id"""


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash": op10_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_pivot_search": op4_pivot_search,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_block_dedup": op7_block_dedup,
    "op8_token_counts": op8_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pq_near_dedup": op13_pq_near_dedup,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op13_pq_near_dedup": pq_dedup.oracle(),
    "op5_secret_scan": _secrets_oracle(),
    "op7_block_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w) x),
        rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN rep ON win.h = rep.h, (SELECT unnest(range(0, 35)) AS j) o),
        edge AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone),
        g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (q IS NULL OR q < p - 1) AS n_spans FROM edge GROUP BY 1),
        kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.i = gone.p GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_pivot_search": """
        WITH s AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM s q JOIN s c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
