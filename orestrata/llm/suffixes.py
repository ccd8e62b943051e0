"""Suffix arrays by two-stage sorting, in arrays.

A suffix that is smaller than its successor is sorted directly. The others follow
from these: in a scan of the buckets of first bytes in ascending order, the
predecessor of each suffix that has its place goes to the next free place of its
own bucket, if it is larger than that suffix. Buckets are scanned whole: those
predecessors that begin with the same byte are found a level at a time.

Suffixes are told apart by their first ``depth`` bytes; suffixes that agree in all
of them come in any order. The end of the text counts as zero bytes.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at each place as a number that sorts like them, with places beyond the end up to ``depth`` bytes on."""
    padded = np.zeros(len(text) + depth + 16, dtype=np.uint8)
    padded[: len(text)] = text
    eight = np.lib.stride_tricks.as_strided(padded, (len(text) + depth + 8, 8), (1, 1))
    return np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it sorts before the one that begins a byte later; the last doesn't."""
    n = len(text)
    step = np.full(n, -1, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    decided = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(decided[::-1])[::-1]  # the next place whose byte differs from the one after it
    return step[at] > 0


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their first ``depth`` bytes, eight bytes at a time among those that still agree."""
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    same = np.zeros(len(places), dtype=bool)  # as the one before
    same[1:] = key[1:] == key[:-1]
    for d in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        key = words[places[at] + d]
        order = np.lexsort((key, group))
        places[at] = places[at][order]
        key = key[order]
        same[at[1:]] &= key[1:] == key[:-1]
    return places


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The places of ``text`` (bytes) in the order of the suffixes that begin there, by their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    words = words_at(text, depth) if words is None else words
    direct = sorted_directly(np.flatnonzero(smaller_than_successor(text)), words, depth)
    cuts = np.searchsorted(text[direct], np.arange(257, dtype=np.int16))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1], dtype=np.int64))
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, dtype=np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == c]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        here = np.concatenate(bucket)
        out.append(here)
        before = here[here > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.diff(first, prepend=-1)) if len(first) else []
        for i, j in zip(edges, [*edges[1:], len(first)] if len(first) else []):
            waiting[first[i]].append(before[i:j])
    return np.concatenate(out)


def common_prefixes(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix of a sorted list has in common with the one before it, up to ``depth``; the first has none."""
    common = np.zeros(len(places), dtype=np.int64)
    alive = np.arange(1, len(places))
    for d in range(0, depth, 8):
        a, b = words[places[alive] + d], words[places[alive - 1] + d]
        same = a == b
        differs = alive[~same]
        x = (a ^ b)[~same]
        for k in range(7):  # leading bytes that agree
            x_agrees = (x >> np.uint64(8 * (7 - k))) == 0
            common[differs] += x_agrees
        alive = alive[same]
        common[alive] += 8
    return np.minimum(common, depth)
