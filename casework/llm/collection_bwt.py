"""Column-wise multi-document construction of suffix order and common prefixes.

Documents are aligned and taken in one symbol each per round, from the right to the left. A round updates
the order of all suffixes that start in its column (the new symbols in that order are the column of the
collection's Burrows-Wheeler transform) and the common prefix of each with the one before it: stable
sorting by the new symbol keeps the order of the rounds before, and two suffixes that get the same symbol
share one symbol more than the least shared between their places in the last round. Each round reads the
arrays of the last one in sequence and writes new ones; nothing else is kept.
"""

from __future__ import annotations

import numpy as np

NONE = -1  # before a document's first and after its last symbol


def columns(texts: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, int]:
    """The documents as rows of a matrix aligned at their anchors, and the anchors' column."""
    left = int(anchors.max(initial=0))
    sizes = np.array([len(t) for t in texts])
    width = left + int((sizes - anchors).max(initial=0))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    matrix = np.full((len(texts), width), NONE, np.int16)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    matrix[row, left - anchors[row] + np.arange(len(flat)) - first[row]] = flat
    return matrix, left


def suffix_rounds(matrix: np.ndarray, groups: np.ndarray):
    """For each column from the right: its index, the order of the rows, and common prefixes in it.

    Rows are compared within their group only; ``groups`` is sorted. Entry k is what row order[k] shares
    with order[k - 1]; a last entry 0 follows.
    """
    rows, width = matrix.shape
    order = np.arange(rows)
    shared = np.zeros(rows + 1, np.int32)
    for column in range(width - 1, -1, -1):
        symbol = matrix[order, column].astype(np.int64)
        group = groups[order]
        by = np.argsort(group * 257 + symbol + 1, kind="stable")
        same = np.flatnonzero(
            (group[by][1:] == group[by][:-1]) & (symbol[by][1:] == symbol[by][:-1]) & (symbol[by][1:] != NONE)
        )
        new = np.zeros(rows + 1, np.int32)
        if len(same):
            spans = np.column_stack([by[same] + 1, by[same + 1] + 1]).ravel()
            new[same + 1] = np.minimum.reduceat(shared, spans)[::2] + 1
        order, shared = order[by], new
        yield column, order, shared


def repeated_starts(
    texts: list[bytes], anchors: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int
) -> np.ndarray:
    """Row i, column s: whether the string of ``length`` at s of document i is in another one of its group
    at the same place beside the anchor; false from ``starts[i]`` on."""
    matrix, left = columns(texts, anchors)
    found = np.zeros((len(texts), int(starts.max(initial=0))), bool)
    for column, order, shared in suffix_rounds(matrix, groups):
        if column > left:
            continue
        long = (shared[:-1] >= length) | (shared[1:] >= length)
        row = order[long]
        start = column - left + anchors[row]
        own = (start >= 0) & (start < starts[row])
        found[row[own], start[own]] = True
    return found
