"""The Merkle manifest against a plain tree, and what its proofs are good for."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passant.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_tree(nodes):
    """The root and each node's steps (place, siblings)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[i].append((p % 16, [x for j, x in enumerate(run) if j != p % 16]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    out, tops = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by[source])
        root, proofs = plain_tree([x[2] for x in leaves])
        tops.append(root)
        out.append((leaves, root, proofs))
    root, above = plain_tree(tops)
    return [(x[3], x[2], sub, root, p + up) for (leaves, sub, proofs), up in zip(out, above, strict=True) for x, p in zip(leaves, proofs, strict=True)]


def given(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["place"], list(s["siblings"])) for s in r["proof"]]) for r in df.collect()]


def test_messy_rows(messy, rows):
    wanted = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    assert sorted(given(merkle.manifest(messy)), key=str) == sorted(plain(wanted), key=str)


@pytest.mark.parametrize("sizes", [{"hot": 5000, "sixteen": 16, "seventeen": 17, "one": 1, None: 257}, {f"s{i}": 1 + i % 3 for i in range(40)}, {"only": 1}])
def test_sizes_of_groups(spark, sizes):
    rows = [(10_000 * k + i, s, "en" if i % 2 else None, i, f"text {i}") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(given(merkle.manifest(docs)), key=str) == sorted(plain(rows), key=str)


def test_rows_that_repeat_are_leaves_side_by_side(spark):
    rows = [(7, "s", None, 1, "same")] * 100 + [(8, "s", None, 1, "other"), (None, "s", None, None, None), (None, "s", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(given(merkle.manifest(docs)), key=str) == sorted(plain(rows), key=str)


def test_empty(empty):
    assert merkle.checked(merkle.manifest(empty), F.col("leaf")).count() == 0


def test_proofs_tell_tampered_rows(spark):
    rows = [(i, f"s{i % 3}", "en", 4, f"Text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    bad = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_hash([F.col(c) for c in merkle.FIELDS[:-1]] + [F.lower("text")]))
    got = merkle.checked(merkle.manifest(docs, also={"bad": bad}), F.coalesce("bad", "leaf")).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    for r in got:
        assert r["proof_sha256"] == h(*(x for s in r["proof"] for x in s["siblings"]))


def test_a_hot_group_is_many_files(spark):
    """One group holds nearly all rows; its places come from files, and no window holds more than a run."""
    from passant.llm.common import shared_dir

    nodes = spark.range(50_000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, groups = merkle._placed(nodes, shared_dir(spark))
        assert {r["grp"]: r["n"] for r in groups.collect()} == {"rare": 500, "hot": 49_500}
        assert placed.where("grp = 'hot'").agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()[:] == (0, 49_499, 49_500)
        assert placed.groupBy("tree", F.expr("at div 16")).count().agg(F.max("count")).first()[0] == 16
        assert placed.where("grp = 'hot'").select(F.min("key").over(merkle.Window.partitionBy(F.lit(1)).orderBy("at").rowsBetween(1, 1)).alias("next"), "key").where("next <= key").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
