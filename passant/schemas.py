"""Table schemas and the order of the feature columns."""

from __future__ import annotations

from pyspark.sql import types as T

PASSAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("bm25", T.DoubleType()), T.StructField("proxy_label", T.DoubleType())])
ITEM = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("gold_answers", T.ArrayType(T.StringType())), T.StructField("pool", T.StringType()), T.StructField("passages", T.ArrayType(PASSAGE)),
])
#: A sample of the older loaders.
SAMPLE = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("is_positive", T.BooleanType())]))),
    T.StructField("dataset", T.StringType()),
])
CORPUS_LINE = T.StructType([T.StructField("id", T.StringType()), T.StructField("contents", T.StringType())])

GROUPS = {
    "d1": ("bm25_norm", "dense_score", "rank", "score_gap"),
    "d2": ("token_length", "readability", "source_credibility"),
    "d3": ("entity_overlap", "answerability"),
    "d4": ("entailment", "contradiction"),
    "d5": ("entropy", "delta_entropy", "perplexity"),
}
FEATURES = tuple(c for group in GROUPS.values() for c in group)
