"""Array parts of suffix-array deduplication: sampled suffixes of a block of texts, and the logarithmic index family."""

from __future__ import annotations

import numpy as np

from textloom.llm.common import prefix_sums, span_hashes

POSITION_BITS = 24
SEGMENT = 1 << 20


def segments(offsets: np.ndarray, length: int, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into segments of at most `most` window starts, overlapping by length - 1 bytes: text number, begin, end."""
    sizes = np.diff(offsets)
    n = np.maximum(0, -(-(sizes - length + 1) // most))
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[doc] + nth * most
    return doc, begin, np.minimum(begin + most + length - 1, offsets[doc + 1])


def sampled_suffixes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """For every window of `length` bytes inside a segment, its least anchor; windows that follow each other and share it are one run.

    The anchor of a window is the place in it whose next length // 2 bytes hash least, so equal windows have it at the
    same offset, and windows can repeat only among runs whose anchors start with the same bytes. A run: anchor, first and
    last window start, `prefix` (hash of the anchor's bytes) and `whole` (hash of all bytes of its windows, and of where
    the anchor stands in them).
    """
    k = length // 2
    n, w = len(data), length - k + 1
    if n >= 1 << POSITION_BITS:
        raise ValueError("a block is too long")
    none = {x: np.zeros(0, np.int64) for x in ("segment", "anchor", "first", "last")} | {x: np.zeros(0, np.uint64) for x in ("prefix", "whole")}
    if n < length or not len(begins):
        return none
    sums = prefix_sums(data)
    at = np.arange(n - k + 1)
    hashes = span_hashes(sums, at, at + k)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least, span = (hashes & ~low) | at.astype(np.uint64), 1
    while span * 2 <= w:
        np.minimum(least[:-span], least[span:], out=least[:-span])
        span *= 2
    least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(begins)), ends - begins - length + 1)
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    first, last, anchor = starts[head], starts[tail], anchor[head]
    whole = span_hashes(sums, first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return {"segment": owner[head], "anchor": anchor, "first": first, "last": last, "prefix": hashes[anchor], "whole": whole}


class IndexFamily:
    """Sorted suffix arrays of geometrically growing sizes.

    add() sorts a batch into a suffix array of its own and scans it against every level: entries that some level or the
    batch itself has again are matches, and so is the level's entry. Entries that no level has yet become a level of their own,
    one for each key, and levels of similar size merge, so each entry is merged a logarithmic number of times. Keys are
    fingerprints of the suffixes' first bytes: any order that keeps equal beginnings together serves.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []  # key, whether it has been a match, further columns

    def add(self, key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Which entries are matches, the numbers of those that enter the family, and the columns of older entries that are matches from now on."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        kinds, many = key[head], np.diff(np.append(head, len(key)))
        known, again = np.zeros(len(kinds), bool), []
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], kinds), len(level[0]) - 1)
            same = level[0][at] == kinds
            known |= same
            woken = at[same][~level[1][at[same]]]
            level[1][woken] = True
            again.append(tuple(c[woken] for c in level[2:]))
        matched = np.zeros(len(key), bool)
        matched[order] = np.repeat(known | (many > 1), many)
        new = order[head[~known]]
        if len(new):
            self._push((kinds[~known], (many > 1)[~known], *(c[new] for c in columns)))
        return matched, new, tuple(np.concatenate(c) for c in zip(*again, strict=True)) if again else tuple(c[:0] for c in columns)

    def _push(self, level: tuple[np.ndarray, ...]) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")  # of two sorted runs: a merge
            self.levels.append(tuple(np.concatenate(c)[order] for c in zip(a, b, strict=True)))
