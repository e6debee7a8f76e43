"""Substring deduplication over words by fixed-block anchors.

A window of w words holds, wherever it starts, a whole block of the blocks of (w + 1) // 2 words that a reference is
cut into. Where an anchor brings stretches of texts together (see repeats), each stretch's non-overlapping blocks are
indexed, and every rolling block of every stretch is probed in that index. A block that is indexed and found at two
places is a hit at all of them. A window's first hit names it: equal windows have the same hit at the same place. From
there windows are extended, word by word, first over the block itself, then to the right and to the left; those that no
other window keeps up with drop out. What reaches a window's both ends is repeated, and the union of these windows are
the maximal exact repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from passant.llm.repeats import Finder, Prints, mixed, refine, words_as_tokens, words_exactly

WINDOW, GRAM = 35, 9


def block_hits(values: np.ndarray, words: np.ndarray, start: np.ndarray, anchor: np.ndarray, windows: np.ndarray, kind: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which windows are equal to another one; see repeats.Resolve."""
    block = (window + 1) // 2
    length = windows + window - 1
    prints = Prints(values, 0)
    salt = mixed(kind.astype(np.uint64) + np.uint64(1))  # stretches with different anchors don't meet
    # index: blocks of each stretch, one after the other
    blocks = length // block
    of = np.repeat(np.arange(len(start)), blocks)
    place = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
    index = np.unique(prints.at(place, block) ^ salt[of])
    # probe: every rolling block
    rolling = length - block + 1
    owner = np.repeat(np.arange(len(start)), rolling)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(rolling) - rolling, rolling) + start[owner]
    probe = prints.at(at, block) ^ salt[owner]
    found = np.searchsorted(index, probe)
    hit = index[np.minimum(found, len(index) - 1)] == probe
    hit &= np.bincount(found[hit], minlength=len(index) + 1)[found] > 1  # a place that only finds itself is no hit
    # a window's first hit, if it holds one: its rolling blocks are window - block + 1
    ahead = np.minimum.accumulate(np.where(hit, np.arange(len(hit)), len(hit))[::-1])[::-1]
    first = np.repeat(np.cumsum(rolling) - rolling, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    into = ahead[first] - first
    maybe = np.flatnonzero(into <= window - block)
    into = into[maybe]
    place = at[first[maybe] + into]
    group = found[first[maybe] + into] * (window + 1) + into

    def extension() -> Iterator[Callable[[np.ndarray], np.ndarray]]:
        for i in range(block):
            yield lambda live, i=i: words[place[live] + i]
        for i in range(block, window):  # all windows of a group have as many words to a side
            yield lambda live, i=i: np.where(into[live] + i < window, words[np.minimum(place[live] + i, len(words) - 1)], -1)
        for i in range(1, window - block + 1):
            yield lambda live, i=i: np.where(into[live] >= i, words[place[live] - np.minimum(i, into[live])], -1)

    rows = np.argsort(group, kind="stable")
    out = np.zeros(int(windows.sum()), bool)
    out[maybe[refine(rows, group[rows], extension())]] = True
    return out


def finder(window: int = WINDOW) -> Finder:
    def resolve(*what: np.ndarray) -> np.ndarray:
        return block_hits(*what, window=window)

    return Finder(window, max(1, min(GRAM, window // 2)), words_as_tokens, words_exactly, resolve)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens (words), n_removed, n_spans and kept (the words that remain, joined by a space) for every row.

    Every word goes that is covered by a window of so many words whose words also start, in that order, anywhere else, in
    another row or the same one; windows are judged on the input. docs: doc_id, text; other columns are not read. Null
    text has no words. Rows that repeat, with or without their doc_id, are copies: each has its own result row. An empty
    table gives an empty result. digests: kept_sha256 in place of kept.
    """
    return finder(window).by_document(docs, by_words=True, digests=digests)
