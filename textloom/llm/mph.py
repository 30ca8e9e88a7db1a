"""Minimal perfect hashing by levels of collision-free bits, built and read with whole-array operations."""

from __future__ import annotations

import numpy as np

from textloom.llm.common import mix


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys to 0 .. n - 1. Other keys get -1 or any index: compare a stored fingerprint.

    At each level the keys left are dealt over `gamma` bits a key; those alone on a bit keep it, the others go to the
    next level. A key's number is the rank of its bit over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - bits + total)
            total += int(bits.sum())
        self.size = total

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((0xA0761D6478BD642F * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        left, levels = np.asarray(keys, np.uint64), []
        if len(np.unique(left)) != len(left):
            raise ValueError("a minimal perfect hash needs distinct keys")
        while len(left):
            size = max(64, -int(-len(left) * gamma // 64) * 64)
            at = cls._places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._places(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(len(b) for b in self.levels)], "<u8").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[MinimalPerfectHash, int]:
        """The index and how many bytes it took."""
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<u8", n, 8).astype(int), 8 * (n + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels), at
