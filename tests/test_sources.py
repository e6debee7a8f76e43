"""Parsers, file scans, resumable tables, the streaming merge and the entry."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from passant.functions import scorers
from passant.operators import retrieval
from passant.plans import catalog
from passant.sources import archives, files, parsers
from passant.streaming import topk


def test_flashrag(spark):
    rows = spark.createDataFrame([(0, "a?", ["x", " "]), (1, "b?", [""]), (2, "a?", ["y"]), (3, "c?", ["z"])], "ordinal long, question string, golden_answers array<string>")
    assert [(r["query_id"], r["gold_answers"]) for r in parsers.flashrag(rows, "nq").orderBy("query_id").collect()] == [("nq:0", ["x"]), ("nq:2", ["y"]), ("nq:3", ["z"])]
    assert [(r["query_id"], r["query"]) for r in parsers.flashrag(rows, "popqa", True).collect()] == [("popqa:1", "c?")]


def test_hotpot(spark):
    rows = spark.createDataFrame([("1", "q", "Yes ", (["T"], [["s1", "s2"]])), ("2", "q", "Paris", (["T", "U"], [["s1", "s2"]]))], "id string, question string, answer string, context struct<title: array<string>, sentences: array<array<string>>>")
    got = parsers.hotpot(rows).collect()
    assert [r["query_id"] for r in got] == ["hotpotqa:2"]
    assert [(p["id"], p["text"]) for p in got[0]["passages"]] == [("hotpotqa:2:p0", '"T"\ns1 s2')]


def test_musique(spark):
    rows = spark.createDataFrame([("1", "q", "a", ["b", "a", ""], True, [(7, "T", "p")]), ("2", "q", "a", [], False, [])], "id string, question string, answer string, answer_aliases array<string>, answerable boolean, paragraphs array<struct<idx: int, title: string, paragraph_text: string>>")
    got = parsers.musique(rows).collect()
    assert len(got) == 1 and got[0]["gold_answers"] == ["a", "b"] and got[0]["passages"][0]["id"] == "musique:1:p7"


def test_ragbench_proxy(spark):
    rows = spark.createDataFrame([(0, "q", ["d0", "d1"], [[["a", "x"], ["b", "y"]], []], ["a"]), (1, "q", ["only"], [[]], [])], "ordinal long, question string, documents array<string>, documents_sentences array<array<array<string>>>, all_utilized_sentence_keys array<string>")
    got = parsers.ragbench(rows).collect()
    assert len(got) == 1 and [p["proxy_label"] for p in got[0]["passages"]] == [0.5, 0.0]


def test_legacy(spark):
    rows = spark.createDataFrame([(0, "q", ["No Answer Present."], (["t"], [1])), (1, "q", ["a"], ([" ", "t"], [0, 1]))], "ordinal long, query string, answers array<string>, passages struct<passage_text: array<string>, is_selected: array<int>>")
    got = parsers.load_legacy("msmarco", rows).collect()
    assert [(p["id"], p["is_positive"]) for r in got for p in r["passages"]] == [("msmarco_1_1", True)]
    assert parsers.load_legacy("msmarco", rows, 1).count() == 0
    with pytest.raises(ValueError):
        parsers.load_legacy("other", rows)
    with pytest.raises(ValueError):
        parsers.build_dataset(spark, "other", "/nowhere")


def test_legacy_ragbench(spark):
    schema = "ordinal long, question string, response string, documents array<string>, documents_sentences array<array<array<string>>>, all_relevant_sentence_keys array<string>"
    rows = [(0, "q", "r", ["d0", "d1", "d2"], [[["a", "x"], ["b", "y"]], []], ["c", "b", "b"]), (1, "q", "r", ["d"], None, ["a"]), (2, "q", "r", ["d"], [[["a", "x"]]], None), (3, "q", "r", [], [], ["a"])]
    got = parsers.load_legacy("ragbench", spark.createDataFrame(rows, schema)).collect()
    assert [[(p["id"], p["text"], p["is_positive"]) for p in r["passages"]] for r in got] == [[("ragbench_0_0", "d0", True), ("ragbench_0_1", "d1", False), ("ragbench_0_2", "d2", False)], [("ragbench_1_0", "d", False)], [("ragbench_2_0", "d", False)], []]


def test_legacy_ragbench_long_document(spark, tmp_path):
    """A document's lines are split once, however many there are: not once for each line, and not again to filter by their number."""
    lines = [" ".join(f"w{i}_{j}" for j in range(10)) for i in range(3000)] + ["w7_3 w2999_9 other"]
    docs = spark.createDataFrame([(1, "\n".join(lines), "en"), (2, None, "en"), (3, "one two", "de")], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r["passage_id"]: r for r in catalog.queries()["s15_legacy_ragbench"](spark, f"file://{tmp_path}").collect()}
    assert time.monotonic() - began < 20
    assert len(got) == 3003 and {k for k, r in got.items() if r["is_positive"]} == {"ragbench_1_7", "ragbench_1_2999", "ragbench_1_3000", "ragbench_2_0", "ragbench_3_0"}
    assert (got["ragbench_1_5"]["query"], got["ragbench_1_5"]["answers"], got["ragbench_1_5"]["text"]) == (lines[0], "w0_0", lines[5]) and got["ragbench_3_0"]["answers"] == "one"


def test_natural_questions(spark):
    schema = "ordinal long, question struct<text: string>, annotations struct<short_answers: array<struct<text: array<string>>>>, long_answer_candidates struct<start_token: array<int>, end_token: array<int>>, document struct<tokens: struct<token: array<string>, is_html: array<boolean>>>"
    rows = spark.createDataFrame([(0, ("q",), ([(["g"],)],), ([0, 2], [2, 2]), ((["<p>", "a", "b"], [True, False, False]),))], schema)
    got = parsers.load_legacy("natural_questions", rows).collect()
    assert [(p["id"], p["text"]) for p in got[0]["passages"]] == [("nq_0_0", "a b")]


def test_triviaqa(spark):
    rows = spark.createDataFrame([(0, "q", ("v", []), (["w", " "],), (["s"],))], "ordinal long, question string, answer struct<value: string, aliases: array<string>>, entity_pages struct<wiki_context: array<string>>, search_results struct<search_context: array<string>>")
    got = parsers.load_legacy("triviaqa", rows).collect()[0]
    assert got["answers"] == ["v"] and [p["id"] for p in got["passages"]] == ["triviaqa_0_wikipedia_0", "triviaqa_0_web_0"]


def test_zip_and_corpus(spark, tmp_path):
    lines = [json.dumps({"id": i, "contents": f'"T{i}"\nbody {i}'}) for i in range(5)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("c.jsonl", "\n".join([lines[0], "", *lines[1:]]))
    got = files.corpus(archives.zipped_lines(spark, f"file://{tmp_path}/c.zip")).orderBy("pid").collect()
    assert [(r["pid"], r["title"], r["body"]) for r in got] == [(str(i), f"T{i}", f"body {i}") for i in range(5)]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/test/P17.test.json", json.dumps([{"question": "q", "answers": ["a"]}, {"question": "r", "answers": [""]}]))
        z.writestr("x/dev/P17.dev.json", "[]")
    items = parsers.entity_questions(files.zip_members(spark, f"file://{tmp_path}/e.zip")).collect()
    assert [i["query_id"] for i in items] == ["entityquestions:P17-0"]


def test_resumable_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.write_table(spark.createDataFrame([("a", 1)], "dataset string, x int"), path)
    files.write_table(spark.createDataFrame([("a", 9), ("b", 2)], "dataset string, x int"), path)
    assert sorted((r["dataset"], r["x"]) for r in files.read_table(spark, path).collect()) == [("a", 1), ("b", 2)]
    files.write_table(spark.createDataFrame([("a", 9)], "dataset string, x int"), path, force=True)
    assert sorted((r["dataset"], r["x"]) for r in files.read_table(spark, path).collect()) == [("a", 9), ("b", 2)]


def test_prompts_are_asked_once(spark):
    prompts = spark.createDataFrame([("p1",), ("p1",), ("p2",)], "prompt string")
    cache = spark.createDataFrame([("p2",)], "prompt string").select(F.sha1(F.col("prompt").cast("binary")).alias("key"), F.lit("old").alias("answer"))
    answers, new = scorers.answered(prompts, cache, scorers.mock_answerer)
    assert new.count() == 1 and answers.count() == 3 and answers.where("answer = 'old'").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    docs = [(i, f"{'paris' if i % 3 else 'cats'} text {i}") for i in range(12)]
    for part in range(3):
        spark.createDataFrame(docs[part::3], "pid long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")
    asked = spark.createDataFrame([("q", "paris text")], "query_id string, query string")
    weights = retrieval.vocabulary(asked).withColumns({"idf": F.lit(1.0), "avgdl": F.lit(3.0)})
    stream = spark.readStream.schema("pid long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    got = topk.stream_top_k(spark, stream, weights, 4, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    want = retrieval.top_k(topk.score_batch(spark.createDataFrame(docs, "pid long, text string"), weights), 4)
    assert sorted(r["pid"] for r in got.collect()) == sorted(r["pid"] for r in want.collect())
    again = topk.stream_top_k(spark, stream, weights, 4, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    assert sorted(r["pid"] for r in again.collect()) == sorted(r["pid"] for r in want.collect())


def test_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    weights = spark.createDataFrame([], "query_id string, term string, idf double, avgdl double")
    stream = spark.readStream.schema("pid long, text string").parquet(f"file://{tmp_path}/in")
    assert topk.stream_top_k(spark, stream, weights, 4, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_under_changing_statistics(spark, tmp_path):
    """After every batch the same as a run over all rows so far, and again after a restart with more files."""
    words = "paris rome cats dogs rivers of the".split()
    queries = spark.createDataFrame([(1, "cats in Paris"), (2, "rivers"), (3, "nothing known")], "query_id long, query string")
    rows = [(i, " ".join(words[(i * j + i) % 7] for j in range(i % 9))) for i in range(60)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("pid long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    plain = lambda df: sorted((r["query_id"], r["pid"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert topk.stream_bm25(spark, stream, queries, 4, out, check).count() == 0
    for n, part in enumerate((rows[:10], rows[10:11], rows[11:])):
        spark.createDataFrame(part, "pid long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        got = topk.stream_bm25(spark, stream, queries, 4, out, check)
        so_far = spark.createDataFrame([r for p in (rows[:10], rows[10:11], rows[11:])[: n + 1] for r in p], "pid long, text string")
        assert plain(got) == plain(retrieval.bm25_top_k(so_far, queries, 4))
        assert plain(spark.read.parquet(f"{out}/version={n}")) == plain(got)
