"""Substring deduplication by a depth-limited suffix sort.

Suffixes are ordered only through their first `window` bytes, by most-significant-digit passes: the leading digit is
the suffix's anchor (see repeats), by which suffixes are dealt out; each further pass orders what is still undecided by
its next eight bytes, the most significant first, and leaves out suffixes that stand alone. After the last pass, the
groups that remain are exactly the repeated windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from passant.llm.repeats import Finder, bytes_as_tokens, bytes_exactly, refine

WINDOW, GRAM, DIGIT = 200, 48, 8


def radix_passes(values: np.ndarray, raw: np.ndarray, start: np.ndarray, anchor: np.ndarray, windows: np.ndarray, kind: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which windows are equal to another one; see repeats.Resolve."""
    total = int(windows.sum())
    owner = np.repeat(np.arange(len(start)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + start[owner]
    # leading digit: the anchor and where in the window it is
    group = kind[owner].astype(np.int64) * (window + 1) + (anchor[owner] - at)
    width = min(DIGIT, window)
    word = np.zeros(max(0, len(raw) - width + 1), np.uint64)
    for i in range(width):
        word = word << np.uint64(8) | raw[i : i + len(word)]
    edges = [*range(0, window - width, width), window - width]  # the last digit may overlap the one before
    rows = np.argsort(group, kind="stable")
    left = refine(rows, group[rows], ((lambda live, e=e: word[at[live] + e]) for e in edges))
    out = np.zeros(total, bool)
    out[left] = True
    return out


def finder(window: int = WINDOW) -> Finder:
    def resolve(*what: np.ndarray) -> np.ndarray:
        return radix_passes(*what, window=window)

    return Finder(window, max(1, min(GRAM, window // 2)), bytes_as_tokens, bytes_exactly, resolve)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens (bytes), n_removed, n_spans and kept (the bytes that remain) for every row of docs.

    Every byte goes that is covered by a string of `window` bytes which also starts anywhere else, in another row or the
    same one; strings are judged on the input. docs: doc_id, text; other columns are not read. Null text counts as
    empty. Rows that repeat, with or without their doc_id, are copies: each has its own result row. An empty table gives
    an empty result. digests: kept_sha256 in place of kept.
    """
    return finder(window).by_document(docs, by_words=False, digests=digests)
