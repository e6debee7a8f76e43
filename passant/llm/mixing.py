"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents are counted in cells (source, language, topic). Raking scales the cells' token weights by turns until the
weights of the sources, of the languages and of the topics are their targets. A document is kept with the probability
rate * raked weight of its cell / tokens of its cell, decided by a hash of its doc_id.

No cell can give more than all it has, so its weight is at most tokens / rate. Targets are tempered shares: the share of
tokens to a power below 1, which raises small groups, times the one factor at which they sum to all tokens when no
group's target is over its bound. A turn that raises a group leaves the cells at their bound and raises the others more.
Probabilities are therefore calibrated: they need no clipping, and expected shares are the targets as far as the cells
allow, which marginals() reports. The cells are raked on the driver while there are few, which is checked; beyond that
by DataFrame rounds, each of them written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.llm.common import located, materialize, only_rows, scan_of, whole_text

AXES = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, RATE = 24, 0.5
CLOSE = 1e-13  # a round that moves no group by more than this share of all tokens is the last
MOST_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def form(n_tokens: Column) -> Column:
    """The stand-in topic of tables that have none: how long a text is."""
    return F.when(n_tokens < 100, "note").when(n_tokens < 1000, "article").otherwise("book")


def measured(docs: DataFrame, topic: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and the columns carried of every row; null text counts as empty."""
    n = F.regexp_count(whole_text(F.col("text")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), n.alias("n_tokens"), *carried, *([topic.alias("topic")] if topic is not None else []))
    return rows if topic is not None else rows.withColumn("topic", form(F.col("n_tokens")))


def _targets(share: Mapping, total: float, temper: float, rate: float) -> dict:
    """The target of each group of one axis: its tempered share, or all it has."""
    power = {c: (t / total) ** temper for c, t in share.items() if t}
    free, factor = sum(power.values()), 0.0
    given, full = 0.0, set()
    while free > 0 and (factor := (total - given) / free) and (more := {c for c in power if c not in full and power[c] * factor > share[c] / rate}):
        full |= more
        given, free = sum(share[c] / rate for c in full), sum(x for c, x in power.items() if c not in full)
    return {c: share[c] / rate if c in full else power.get(c, 0.0) * factor for c in share}


def rake(tokens: list[float], places: list[tuple], temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, rate: float = RATE) -> list[float]:
    """The factor of each cell, 1 / rate at most; places holds its category on each axis."""
    total, most = sum(tokens), [t / rate for t in tokens]
    targets: list[dict] = []
    for axis, name in enumerate(AXES):
        share: dict = {}
        for t, p in zip(tokens, places, strict=True):
            share[p[axis]] = share.get(p[axis], 0.0) + t
        targets.append(_targets(share, total, temper[name], rate))
    weight = list(map(float, tokens))
    for _ in range(rounds):
        moved = 0.0
        for axis, target in enumerate(targets):
            have, full = dict.fromkeys(target, 0.0), dict.fromkeys(target, 0.0)
            for w, m, p in zip(weight, most, places, strict=True):
                have[p[axis]] += w
                full[p[axis]] += w if w >= m else 0.0
            moved = max([moved, *(abs(target[c] - have[c]) for c in target)])
            scale = {c: (target[c] - full[c]) / (have[c] - full[c]) if target[c] > have[c] > full[c] else target[c] / have[c] if have[c] else 0.0 for c in target}
            weight = [min(m, w * scale[p[axis]]) for w, m, p in zip(weight, most, places, strict=True)]
        if moved <= CLOSE * total:
            break
    return [w / t if t else 1.0 for w, t in zip(weight, tokens, strict=True)]


def _far_targets(cells: DataFrame, name: str, total: float, temper: float, rate: float) -> DataFrame:
    """_targets() of one axis as a table (_c, _target)."""
    groups = materialize(cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t")).select(F.col(name).alias("_c"), "t", F.when(F.col("t") > 0, F.pow(F.col("t") / (total or 1.0), temper)).otherwise(0.0).alias("x")))
    factor = 0.0
    while True:
        full = F.col("x") * factor > F.col("t") / rate
        given, free = groups.agg(F.sum(F.when(full, F.col("t") / rate)), F.sum(F.when(~full, F.col("x")))).first()
        raised = (total - (given or 0.0)) / free if free else factor
        if raised <= factor * (1 + 1e-12):
            return groups.select("_c", F.least(F.col("t") / rate, F.col("x") * factor).alias("_target"))
        factor = raised


def _rake_far(cells: DataFrame, temper: Mapping[str, float], rounds: int, rate: float) -> DataFrame:
    """The same by DataFrame rounds, for more cells than the driver should hold."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    targets = [materialize(_far_targets(cells, name, total, temper[name], rate)) for name in AXES]
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    most, w = F.col("tokens") / rate, F.col("weight")
    for _ in range(rounds):
        for name, target in zip(AXES, targets, strict=True):
            have = rows.groupBy(name).agg(F.sum("weight").alias("_have"), F.sum(F.when(w >= most, w).otherwise(0.0)).alias("_full")).select(F.col(name).alias("_n"), "_have", "_full")
            rows = rows.join(have, F.col(name).eqNullSafe(F.col("_n"))).join(target, F.col(name).eqNullSafe(F.col("_c")))
            up = (F.col("_target") > F.col("_have")) & (F.col("_have") > F.col("_full"))
            scale = F.when(up, (F.col("_target") - F.col("_full")) / (F.col("_have") - F.col("_full"))).when(F.col("_have") > 0, F.col("_target") / F.col("_have")).otherwise(0.0)
            rows = rows.withColumn("weight", F.least(most, w * scale)).select(*AXES, "tokens", "weight")
        rows = materialize(rows)
    return rows.select(*AXES, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("factor"))


def mix(docs: DataFrame, topic: Column | None = None, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, rate: float = RATE, most_cells: int = MOST_CELLS, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, p, kept and the columns carried for every row of docs (doc_id, text, source, lang).

    Null source, language or topic is a category of its own. Null text counts as empty; a cell without a token has
    factor 1. Rows that repeat a doc_id share its draw, and so do null doc_ids. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = materialize(measured(docs, topic, carried))
    cells = materialize(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() <= most_cells:
        held = [(*(r[a] for a in AXES), float(r["tokens"])) for r in cells.orderBy(*AXES).collect()]
        factor = rake([h[3] for h in held], [h[:3] for h in held], temper, rounds, rate)
        factors = spark.createDataFrame([(*h[:3], f) for h, f in zip(held, factor, strict=True)], ", ".join(f"{a} string" for a in AXES) + ", factor double")
        factors = F.broadcast(factors)  # most_cells rows at most
    else:
        factors = _rake_far(cells, temper, rounds, rate)
    right = factors.select(*[F.col(a).alias(f"_{a}") for a in AXES], "factor")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("topic").eqNullSafe(F.col("_topic"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    p = F.least(F.lit(1.0), F.lit(rate) * F.col("factor"))
    out = rows.join(right, same).withColumn("p", p).withColumn("kept", draw < F.col("p"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("p", 6).alias("p"), "kept", *carried)


def marginals(mixed: DataFrame, temper: Mapping[str, float] = TEMPER, rate: float = RATE) -> DataFrame:
    """axis, category, tokens, target, expected and drawn (tokens of the sample) of each group of each axis of mix()'s
    result. expected differs from target only where no weights of the cells meet all targets at once, or by the rounding
    of p. An empty table gives an empty result; without a token all targets are 0."""
    n = F.col("n_tokens")
    cells = materialize(mixed.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"), F.sum(n * F.col("p")).alias("expected"), F.sum(F.when(F.col("kept"), n).otherwise(0)).alias("drawn")))
    total, parts = float(cells.agg(F.sum("tokens")).first()[0] or 0.0), []
    for name in AXES:
        target = _far_targets(cells, name, total, temper[name], rate)
        sums = cells.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "drawn")])
        parts.append(sums.join(target, F.col(name).eqNullSafe(F.col("_c"))).select(F.lit(name).alias("axis"), F.col(name).alias("category"), "tokens", (F.col("_target") * rate).alias("target"), "expected", "drawn"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are sampled, with all their columns; nulls, repeats and empty tables are as in mix()."""
    docs, file, row = located(scan_of(docs).docs)
    stay = mix(docs, **how, carried=(file, row)).where("kept").select(file, row)
    return only_rows(docs, file, row, stay).drop(file, row)


def oracle(rounds: int = ROUNDS, rate: float = RATE, temper: Mapping[str, float] = TEMPER, table: str = "documents") -> str:
    """DuckDB SQL for mix(): the rounds are written out."""
    ctes = [
        f"m AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM {table})",
        "r AS (SELECT *, CASE WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM m)",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)",
        "t AS (SELECT sum(tokens) AS total FROM c)",
    ]
    for a in AXES:
        ctes.append(f"p_{a} AS (SELECT {a} AS k, CASE WHEN sum(tokens) > 0 THEN (sum(tokens) / (SELECT total FROM t)) ** {temper[a]} ELSE 0.0 END AS x, sum(tokens) / {rate} AS most FROM c GROUP BY 1)")
        ctes.append(f"l_{a} AS (SELECT max(((SELECT total FROM t) - coalesce(before, 0.0)) / onward) AS factor FROM (SELECT sum(most) OVER (ORDER BY most / x, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(x) OVER (ORDER BY most / x, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM p_{a} WHERE x > 0) y)")
        ctes.append(f"g_{a} AS MATERIALIZED (SELECT k, CASE WHEN x > 0 THEN least(most, x * (SELECT factor FROM l_{a})) ELSE 0.0 END AS target FROM p_{a})")
    last, n = "w0", 0
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM c)")
    for _ in range(rounds):
        for a in AXES:
            n += 1
            ctes.append(f"w{n} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(tokens / {rate}, weight * CASE WHEN target > have AND have > at_most THEN (target - at_most) / (have - at_most) WHEN have > 0 THEN target / have ELSE 0.0 END) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {a}) AS have, sum(CASE WHEN weight >= tokens / {rate} THEN weight ELSE 0.0 END) OVER (PARTITION BY {a}) AS at_most FROM {last}) x JOIN g_{a} ON {a} IS NOT DISTINCT FROM k)")
            last = f"w{n}"
    ctes.append(f"f AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1.0 END AS factor FROM {last})")
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(factor, 6) AS factor, round(least(1.0, {rate} * factor), 6) AS p,
               CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS UBIGINT) / 4294967296.0 < least(1.0, {rate} * factor) AS kept
        FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.lang IS NOT DISTINCT FROM f.lang AND r.topic IS NOT DISTINCT FROM f.topic"""
