"""Quality classifier: Bradley-Terry ranking on text features, with a threshold at a score quantile.

A document's strength is linear in its features. A labelled good document beats a labelled bad one; the weights are
learned by logistic loss on the feature differences of such preference pairs. A Bradley-Terry strength has no zero, so
it is tied to the labels afterwards: strengths at or below the quantile that bad documents make up in the sample are
rejected, and that quantile is where the score, a logistic curve of the strength, crosses the threshold.

Training reads a sample of labelled documents of bounded size (`most_labels`); scoring reads every whole text, in
one pass without a shuffle. Labels, language, source and identifiers are not features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passant.llm.common import whole_text

FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "letters", "upper", "digits", "spaces", "other_ascii",
    "non_ascii", "sentence_ends", "commas", "caps_words", "marked_words", "symbol_runs", "lines", "repeated_lines", "mean_line", "squeezed", "repeated_pairs", "doubled", "empty",
)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KNOWN_MARKS = frozenset(b".,;:!?'\"()-")
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _KNOWN_MARKS])
_MARK_BYTES = bytes(_MARKS.tolist())


def features(text: bytes) -> list[float]:
    """The features of a text's UTF-8 bytes; an empty text, or one of white space, has zeros and `empty`."""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(words), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    caps = sum(1 for w in words if len(w) > 2 and w.isupper())
    stripped = text.translate(None, _MARK_BYTES)
    marks = size - len(stripped)
    squeezed = len(zlib.compress(text[:65536], 1)) / min(size, 65536) if size <= 65536 else float(np.mean([len(zlib.compress(text[i : i + 65536], 1)) / len(text[i : i + 65536]) for i in range(0, size, 65536)]))
    pairs = n - 1 - len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    return [
        np.log(n), size / n, float((lengths > 12).mean()), float((lengths <= 2).mean()), len(seen) / n, max(seen.values()) / n, count[_LETTER].sum() / size, count[65:91].sum() / size,
        count[48:58].sum() / size, count[_SPACE].sum() / size, marks / size, count[128:].sum() / size, (count[33] + count[46] + count[63]) / n, count[44] / n, caps / n,
        min(1.0, marks / n), float(marks > 0.02 * size), np.log(len(lines) + 1), 1 - len(set(lines)) / max(1, len(lines)), np.log(n / max(1, len(lines)) + 1), squeezed, pairs / n, sum(map(eq, words, words[1:])) / n, 0.0,
    ]


@dataclass(frozen=True)
class Model:
    """strength = weights . ((x - mean) / scale, and its square); score = logistic(slope * (strength - cut) + offset)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    offset: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.strengths(x) - self.cut) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def fit(x: np.ndarray, good: np.ndarray, threshold: float = 0.3, pairs_each: int = 24, ridge: float = 1.0, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton steps on the penalised logistic loss of pair differences.

    Without both labels there is nothing to prefer: the weights are zero, and the score is the share of good labels.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = expanded(x, mean, scale)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = np.zeros(z.shape[1])
    if not len(up) or not len(down):
        share = np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99)
        return Model(mean, scale, w, 0.0, 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    few, many = (down, up) if len(down) < len(up) else (up, down)
    a, b = np.repeat(few, pairs_each), rng.choice(many, len(few) * pairs_each)
    d = z[b] - z[a] if few is down else z[a] - z[b]  # winner minus loser
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    s = z @ w
    cut = float(np.quantile(s, len(down) / len(s)))  # as many are rejected as are labelled bad
    spread = float(np.abs(s - cut).mean()) or 1.0
    return Model(mean, scale, w, cut, 2.0 / spread, float(np.log(threshold / (1 - threshold))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 16_000, threshold: float = 0.3) -> Model:
    """Fit on labelled rows that aren't held out; of more than most_labels, those with the smallest hash of doc_id.

    A document labelled more than once counts by its mean label, one whose doc_id repeats by the mean of its texts'
    features, so what reaches the driver is a row for each label, however often its doc_id repeats; null labels and null
    doc_ids are left out.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    # bounded by most_labels, whatever the size of labels; so is what is broadcast and what reaches the driver
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [features(t.as_buffer().to_pybytes()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    each = joined.mapInArrow(act, "doc_id long, good int, x array<double>").groupBy("doc_id", "good")
    rows = each.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(FEATURES))]).alias("x")).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, rows.column("good").to_numpy()[order].astype(int), threshold)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return rows.mapInArrow(act, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, most_labels: int = 16_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; other columns are not read).

    Null text counts as empty and has a score like any other. Null doc_ids are scored, not held out. Repeated rows each
    give a row. Empty labels give one score for all; an empty docs table gives an empty result.
    """
    scored = score(docs, train(docs, labels, most_labels, threshold))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, labels: DataFrame, most_labels: int = 16_000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns, in one pass over the texts.

    Null text counts as empty and is judged like any other; null doc_ids and rows that repeat are each judged by their text.
    Names that clash don't matter, and the text's column may be written in any case. An empty table gives an empty result;
    without labels of both kinds all rows have one score, and stay or go together.
    """
    model = train(docs, labels, most_labels, threshold)
    at = [c.lower() for c in docs.columns].index("text")

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(act, docs.schema)
