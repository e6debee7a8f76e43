"""Model-backed scorers: anything with a backend behind it is a pandas UDF, and a mock of plain hash expressions stands in.

A backend is a factory, called once in each worker; its models stay loaded for the worker's life.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passant.functions import text as X

_LOADED: dict[Any, Any] = {}


def loaded(factory: Callable[[], Any]) -> Any:
    """The factory's product, kept in the worker. Factories are told apart by their qualified name."""
    key = f"{factory.__module__}.{getattr(factory, '__qualname__', repr(factory))}"
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


#: Characters that a prompt's longest neighbour in a batch may have, times its own.
WASTE = 1.1


def length_batches(lengths: Sequence[int], budget: int, most: int, waste: float = WASTE) -> list[tuple[int, int]]:
    """Ranges of ascending lengths: `most` at most, no more than the budget when padded to the longest, and no length of
    which is `waste` times the shortest or more. A length over the budget is a batch alone."""
    out, start = [], 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= most or n * (i - start + 1) > budget or n > waste * max(1, lengths[start])):
            out.append((start, i))
            start = i
    return [*out, (start, len(lengths))] if len(lengths) else out


def generate(rows: DataFrame, prompt: str, out: str, factory: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32, budget: int = 1 << 16) -> DataFrame:
    """rows with an answer to each prompt (null to a null one).

    Prompts are dealt out by ranges of their length, so a task has prompts of like lengths from the whole table, and cut in
    batches of like cost: `batch` prompts and `budget` characters at most, padded to the longest. Equal lengths are spread
    over tasks by hash.
    """
    import pyarrow as pa

    at = rows.schema.names.index(prompt)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(factory)
        for part in batches:
            texts = part.column(at).to_pylist()
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
            said: list[str | None] = [None] * len(texts)
            for a, b in length_batches([len(texts[i]) for i in order], budget, batch):
                for i, value in zip(order[a:b], model([texts[i] for i in order[a:b]]), strict=True):
                    said[i] = value
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], [*part.schema.names, out])

    laid = rows.repartitionByRange(F.length(prompt), F.xxhash64(prompt)).sortWithinPartitions(F.length(prompt))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{out}` string"])
    return laid.mapInArrow(answer, schema)


def score_pairs(rows: DataFrame, left: str, right: str, out: str, factory: Callable[[], Callable[[list[str], list[str]], list[Any]]], kind: str = "double") -> DataFrame:
    """rows with a score of each pair: double (cross-encoder, Yes/No margin), array<double> (NLI or next-token logits),
    or struct<sum_logprob: double, n_tokens: int> (sequence log-probabilities)."""

    @F.pandas_udf(kind)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series | pd.DataFrame]:
        model = loaded(factory)
        for a, b in batches:
            got = model(a.tolist(), b.tolist())
            yield pd.DataFrame(got) if kind.startswith("struct") else pd.Series(got)

    return rows.sortWithinPartitions(F.length(right)).withColumn(out, score(left, right))


def mean_logprob(result: Column) -> Column:
    """Of struct<sum_logprob, n_tokens>; 0 for an empty continuation."""
    return F.coalesce(F.try_divide(result["sum_logprob"], result["n_tokens"].cast("double")), F.lit(0.0))


def perplexity(result: Column) -> Column:
    return F.exp(-mean_logprob(result))


def answered(prompts: DataFrame, cache: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """prompts (prompt) with their answers, and the new cache rows (key, answer): each missing prompt is asked once."""
    keyed = prompts.withColumn("key", F.sha1(F.col("prompt").cast("binary")))
    missing = keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    new = generate(missing, "prompt", "answer", factory).select("key", "answer")
    return keyed.join(cache.select("key", "answer").unionByName(new), "key"), new


def mock_probe(query: Column, passage: Column) -> dict[str, Column]:
    """h_base, entropy, delta_entropy, perplexity from hashes, in the ranges of a real probe."""
    base = F.lit(2.5) + F.lit(1.5) * X.uniform(query)
    entropy = F.lit(0.5) + F.lit(4.5) * X.uniform(F.concat(query, passage))
    return {"h_base": base, "entropy": entropy, "delta_entropy": base - entropy, "perplexity": F.exp(entropy)}


def mock_nli(claim: Column, passage: Column) -> Column:
    """Three logits: contradiction, entailment, neutral."""
    part = lambda name: F.lit(4.0) * X.uniform(F.concat(F.lit(f"{name}:"), claim, passage)) - 2.0
    return F.array(part("c"), part("e"), part("n"))


def picked(probabilities: Column, labels: list[str], name: str) -> Column:
    """The probability of a label by the model's own names; 0 where it has none of that name."""
    lower = [x.lower() for x in labels]
    return F.element_at(probabilities, lower.index(name) + 1) if name in lower else F.lit(0.0)


def mock_answer(prompts: list[str]) -> list[str]:
    """A deterministic answer: the first capitalised words of the prompt's last passage or question."""
    out = []
    for p in prompts:
        body = p.rpartition("Question:")[0] or p
        names = [w.strip(".,?") for w in body.split() if w[:1].isupper()]
        out.append(" ".join(names[-2:]) or "unknown")
    return out


def mock_answerer() -> Callable[[list[str]], list[str]]:
    return mock_answer
