"""Groups of rows that follow each other in the Arrow batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """(rows, bounds of the groups in them); a group is never cut, and only the last one of a batch is held back.

    The rows of a group have equal values in the integer columns `by` and follow each other.
    """
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        edges = _edges(now, by)
        cut = edges[-1] if edges else 0
        held = now.slice(cut)
        if cut:
            yield now.slice(0, cut), list(zip([0, *edges[:-1]], edges, strict=True))
    if held is not None and held.num_rows:
        yield held, [(0, held.num_rows)]


def _edges(rows: pa.Table, by: list[str]) -> list[int]:
    marks = [np.asarray(rows.column(c).combine_chunks()) for c in by]
    return (np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def pairs_between(start: np.ndarray, split: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all i in start:split and j in split:end of each group, and all i < j where split is start; at most
    about `most` pairs at a time (or those of one row).
    """
    rows = np.where(split > start, split - start, end - start)
    left = np.repeat(np.arange(len(start)), rows)
    within = np.arange(len(left)) - np.repeat(np.cumsum(rows) - rows, rows)
    i = start[left] + within
    first = np.where(split[left] > start[left], split[left], i + 1)
    count = end[left] - first
    done = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + most, side="right")) - 1)
        n = count[lo:hi]
        yield np.repeat(i[lo:hi], n), np.arange(done[hi] - done[lo]) - np.repeat(done[lo:hi] - done[lo], n) + np.repeat(first[lo:hi], n)
        lo = hi
