"""A Merkle manifest of a dataset: one tree of leaves for each group, and one tree of their subroots.

A leaf is the SHA-256 of a row's fields, each with its length. Leaves of a group stand in order; every `fanout`
consecutive nodes are a run, and a run's parent is the SHA-256 of its nodes in turn, level by level, until one is left.
The subroots, in order of their groups, make the root the same way.

Levels are windows: partitioned by group and parent index, an ordered full-frame collect_list gives each node its whole
run, which is both the parent's preimage and the node's siblings; the first node of each run stands for the parent, so
parents are deduplicated before the next level. A window holds `fanout` nodes at most, whatever the size of a group.

Places in a group need no window over the group: nodes are dealt out by ranges of (group, order) and written, and a
node's place is its index in its file plus what earlier files hold of the group. A group with a third of all rows is
ranges of many files. Proofs are joined from the top down; each level has a sixteenth of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, shared_dir

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
_STEPS = "array<struct<place: int, siblings: array<string>>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields in turn: `-` for null, else the number of UTF-8 bytes, `:` and the value."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to with the siblings of a proof."""

    def up(node: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["place"])
        after = F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """The SHA-256 of all siblings of a proof, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def _placed(nodes: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """nodes (grp, key, node, ...) with tree, n and at (the place in the group from 0, by key and node, null first), and
    the groups: grp, tree, n. Rows that are equal in all three are dealt out by where they were written first."""
    nodes, file, row = located(materialize(nodes, f"{base}/nodes"))
    by = [*(F.col(c).asc_nulls_first() for c in ("grp", "key", "node")), F.xxhash64(file, row), F.col(row)]
    laid = nodes.repartitionByRange(*by).sortWithinPartitions(*by).drop(file, row).withColumn("part", F.spark_partition_id())
    laid, file, row = located(materialize(laid, f"{base}/laid"))
    # a group has a span for each file at most
    spans = laid.groupBy("grp", "part", file).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("held"))
    spans = materialize(spans, f"{base}/spans")
    groups = materialize(spans.groupBy("grp").agg(F.sum("held").alias("n")).withColumn("tree", F.monotonically_increasing_id()), f"{base}/groups")
    before = F.sum("held").over(Window.partitionBy("grp").orderBy("part", file)) - F.col("held")
    starts = spans.select(F.col("grp").alias("g"), F.col(file).alias("f"), (before - F.col("first")).alias("shift"))
    starts = starts.join(groups.withColumnRenamed("grp", "h"), F.col("g").eqNullSafe(F.col("h"))).drop("h")
    whole = laid.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col(file) == F.col("f")))
    return whole.withColumn("at", F.col(row) + F.col("shift")).drop(file, row, "part", "g", "f", "shift"), groups


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes of trees that aren't at their root yet, with parent, place in its run and the whole run."""
    whole = Window.partitionBy("tree", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = nodes.where("n > 1").withColumns({"parent": F.expr(f"at div {fanout}"), "place": F.expr(f"int(at % {fanout})")})
    return below.withColumn("run", F.collect_list("node").over(whole))


def _climb(leaves: DataFrame, largest: int, fanout: int, base: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves (tree, at, n, node), and each tree's root (tree, node)."""
    levels = [leaves.select("tree", "at", "n", "node")]
    while largest > 1:
        parents = _runs(levels[-1], fanout).where("place = 0")
        parents = parents.select("tree", F.col("parent").alias("at"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("node"))
        levels.append(materialize(parents, f"{base}/level{len(levels)}"))
        largest = -(-largest // fanout)
    roots = levels[0].where("n = 1").select("tree", "node")
    for level in levels[1:]:
        roots = roots.unionByName(level.where("n = 1").select("tree", "node"))
    return levels[1:], roots


def _descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """leaves with proof: the steps from each leaf to its tree's root and then those of above (tree, rest)."""
    proofs: DataFrame | None = None
    for nodes in [*reversed(levels), leaves]:
        kept = [c for c in nodes.columns if nodes is leaves or c in ("tree", "at")]
        own = nodes.where("n = 1").join(above, "tree").select(*kept, F.col("rest").alias("proof"))
        if proofs is not None:
            others = F.filter(F.transform("run", lambda h, i: F.when(i != F.col("place"), h)), lambda h: h.isNotNull())
            up = proofs.select("tree", F.col("at").alias("parent"), F.col("proof").alias("rest"))
            step = F.array(F.struct("place", others.alias("siblings"))).cast(_STEPS)
            inner = _runs(nodes, fanout).join(up, ["tree", "parent"]).select(*kept, F.concat(step, "rest").alias("proof"))
            own = own.unionByName(inner)
        proofs = own
    return proofs


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", fanout: int = FANOUT, also: dict[str, Column] | None = None) -> DataFrame:
    """order, leaf, subroot, root, proof and the columns `also` for every row of docs.

    proof: for each level from the leaf's to the root's the node's place in its run and its siblings. Only the columns
    named are read (and what `also` is computed from). Null fields are part of a leaf as `-`; a null group is a group
    of its own and comes first; in a group a null order comes first, and ties go by the leaf. Rows that repeat are
    leaves of their own, which stand side by side; which of them stands first changes no hash. A group of one row has
    its leaf as subroot, and a table of one group its subroot as root. An empty table gives an empty result.
    """
    base, names = shared_dir(docs.sparkSession), list(also or {})
    carried = [(also or {})[c].alias(f"also_{i}") for i, c in enumerate(names)]
    nodes = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("key"), leaf_hash([F.col(c) for c in fields]).alias("node"), *carried)
    leaves, groups = _placed(nodes, f"{base}/leaves")
    levels, roots = _climb(leaves, groups.agg(F.max("n")).first()[0] or 0, fanout, f"{base}/leaves")
    # the tree above has a leaf for each group
    tops = roots.join(groups.select("tree", "grp"), "tree").select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node", F.col("tree").alias("below"))
    crowns, crown = _placed(tops, f"{base}/tops")
    upper, root = _climb(crowns, crown.agg(F.max("n")).first()[0] or 0, fanout, f"{base}/tops")
    end = root.select(F.col("node").alias("root"), F.array().cast(_STEPS).alias("rest"), "tree")  # one row
    steps = materialize(_descend(crowns, upper, end.select("tree", "rest"), fanout), f"{base}/steps")
    tree = steps.select(F.col("below").alias("tree"), F.col("node").alias("subroot"), F.col("proof").alias("rest"))
    found = _descend(leaves, levels, tree.select("tree", "rest"), fanout).join(tree.drop("rest"), "tree")
    root = F.lit(next((r["root"] for r in end.take(1)), None)).cast("string")
    given = [F.col(f"also_{i}").alias(c) for i, c in enumerate(names)]
    return found.select(F.col("key").alias(order), F.col("node").alias("leaf"), "subroot", root.alias("root"), "proof", *given)


def checked(rows: DataFrame, claimed: Column) -> DataFrame:
    """rows of a manifest with proof_sha256, folded_root (of the claimed leaf with the row's siblings) and verified."""
    fold = rows.withColumns({"proof_sha256": proof_hash(F.col("proof")), "folded_root": folded(claimed, F.col("proof"))})
    return fold.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(value: str) -> str:
    """CRC-32 of a short ASCII string: its bits in turn, lowest first, through the polynomial's shift register."""
    bits = f"[(ascii({value}[1 + i // 8]) >> CAST(i % 8 AS INTEGER)) & 1 FOR i IN range(8 * length({value}))]"
    return f"xor(list_reduce([CAST(x AS BIGINT) FOR x IN list_prepend(4294967295, {bits})], lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def oracle(depth: int = 6) -> str:
    """DuckDB SQL of op11's rows for trees of up to 16^depth leaves."""

    def leaf(text: str) -> str:
        framed = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(framed)})"

    def tree(s: str, r: str) -> list[str]:
        out = []
        for i in range(depth):
            out.append(f"{r}{i} AS MATERIALIZED (SELECT tree, pos // {FANOUT} AS pos, n, list(node ORDER BY pos) AS run FROM {s}{i} WHERE n > 1 GROUP BY tree, pos // {FANOUT}, n)")
            out.append(f"{s}{i + 1} AS MATERIALIZED (SELECT tree, pos, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(array_to_string(run, '')) AS node FROM {r}{i})")
        return out

    def fold(p: str, r: str, first: str) -> list[str]:
        out = [f"{p}0 AS ({first})"]
        for i in range(depth):
            own = f"({p}{i}.pos // {FANOUT**i}) % {FANOUT}"
            left, right = f"array_to_string(run[1:{own}], '')", f"array_to_string(run[{own} + 2:], '')"
            out.append(f"{p}{i + 1} AS MATERIALIZED (SELECT {p}{i}.* REPLACE (CASE WHEN run IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN run IS NULL THEN sib ELSE sib || {left} || {right} END AS sib) FROM {p}{i} LEFT JOIN {r}{i} ON {p}{i}.tree = {r}{i}.tree AND {p}{i}.pos // {FANOUT ** (i + 1)} = {r}{i}.pos)")
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents)",
        "o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l)",
        "s0 AS (SELECT tree, pos, n, leaf AS node FROM o)",
        *tree("s", "r"),
        f"subroots AS MATERIALIZED ({' UNION ALL '.join(f'SELECT tree, node FROM s{i} WHERE n = 1' for i in range(depth + 1))})",
        "t0 AS (SELECT 0 AS tree, tree - 1 AS pos, count(*) OVER () AS n, node FROM subroots)",
        *tree("t", "q"),
        f"root AS ({' UNION ALL '.join(f'SELECT node AS root FROM t{i} WHERE n = 1' for i in range(depth + 1))})",
        *fold("p", "r", "SELECT *, claimed AS f, '' AS sib FROM o"),
        *fold("u", "q", f"SELECT doc_id, leaf, f, sib, 0 AS tree, p{depth}.tree - 1 AS pos, subroots.node AS subroot FROM p{depth} JOIN subroots ON p{depth}.tree = subroots.tree"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM u{depth}, root"
