"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash resolves pre-tokens that are whole entries of the vocabulary; the others are merged by rank
with a heap over linked bytes. Resolved pre-tokens are kept in a bounded memo of each Python worker.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated documents each give a row; any length
of text or pre-token works (merging takes n log n). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, strings
from textloom.llm.mph import MinimalPerfectHash

MEMO_ENTRIES = 300_000


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, ranks), np.uint64, len(ranks))
        self.index = MinimalPerfectHash.build(keys)
        at = self.index.lookup(keys)
        self.ids, self.prints = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint64)
        self.ids[at], self.prints[at] = np.fromiter(ranks.values(), np.int64, len(ranks)), keys
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """The id of each piece that is one token, else -1."""
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        at = self.index.lookup(keys)
        found = (at >= 0) & (self.prints[at] == keys) if len(self.ids) else np.zeros(len(pieces), bool)
        out = np.where(found, self.ids[at] if len(self.ids) else -1, -1)
        for k in np.flatnonzero(found):  # equal fingerprints need not be equal bytes
            if self.tokens[out[k]] != pieces[k]:
                out[k] = -1
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until no pair has a rank."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or (mid := after[i]) >= n or after[mid] != end:
                continue
            alive[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                stop = after[end]
                if (r := rank(piece[i:stop])) is not None:
                    heappush(heap, (r, i, stop))
            if (left := before[i]) >= 0 and (r := rank(piece[left:end])) is not None:
                heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if new := [*(set(chain.from_iterable(split)) - memo.keys())]:
            pieces = [w.encode("utf-8", "replace") for w in new]
            for w, piece, i in zip(new, pieces, self.whole(pieces).tolist(), strict=True):
                memo[w] = i.to_bytes(4, "little") if i >= 0 else np.array(self.merged(piece), "<u4").tobytes()
        return [b"".join(map(memo.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _loaded(path: str, pattern: str) -> Vocabulary:
    return Vocabulary.load(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, kept: str = "doc_id") -> DataFrame:
    """Columns doc_id, n_tokens and ids (little-endian unsigned 32-bit). `vocabulary` is a rank file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(vocabulary, pattern)
        for batch in blocks(batches, "text"):
            ids = v.encode(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(kept).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(vocabulary, pattern)
        for batch in blocks(batches, "ids"):
            decoded = [v.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
