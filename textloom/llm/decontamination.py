"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items.

A text is normalised by one byte table (A-Z lower-cased, what is no word byte a blank), its words are joined by one
blank and scanned once; word numbers lead back to offsets in the original text.

Defined cases: a null or empty text, or one without words, has no words and no hits; an item without words has no
window; items that share a window each count; rows that repeat an item_id count as one item; a null item_id is the
item "null"; repeated documents each give a row; an empty benchmark hits nothing. Other columns are ignored by
decontaminate() and kept by cleaned(), but for those named like a column that it adds.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, fresh, numbered, strings, written

NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_BYTES = 256 << 10  # an automaton has some 15 nodes a byte of them

HIT = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("item", T.StringType())]))
_HIT = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS), ("contaminated", pa.bool_())])
OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, contaminated boolean"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split()


def windows(items: list[tuple[str, str]], width: int) -> dict[bytes, list[str]]:
    """Each window with the ids of its items."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found[b" ".join(w[i : i + width])].add(item)
    return {k: sorted(v) for k, v in found.items()}


def automaton(items: list[tuple[str, str]], width: int):
    """None if there is no window."""
    made = ahocorasick.Automaton()
    for window, ids in windows(items, width).items():
        made.add_word(f" {window.decode('latin-1')} ", (window.count(b" "), ids))
    if not len(made):
        return None
    made.make_automaton()
    return made


def scan(text: bytes, made) -> tuple[list[bytes], list[tuple[int, int, str]]]:
    """The words, and for each occurrence of a window its first and last word and an item."""
    w = text.translate(NORMAL).split()
    if made is None or not w:
        return w, []
    joined = b" " + b" ".join(w) + b" "
    found = list(made.iter(joined.decode("latin-1")))
    if not found:
        return w, []
    number = np.cumsum(np.frombuffer(joined, np.uint8) == 32)
    return w, [(int(number[end]) - 2 - more, int(number[end]) - 2, item) for end, (more, ids) in found for item in ids]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets of runs of words."""
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[edge[2 * a]]), "end": int(points[edge[2 * b + 1]])} for a, b in runs]


def runs_of(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_made: dict[str, object] = {}


def _automaton(shared, width: int):
    """The automaton of a broadcast (name, items); a worker keeps the last one that it made."""
    name, items = shared.value
    if (name, width) not in _made:
        _made.clear()
        _made[name, width] = automaton(items, width)
    return _made[name, width]


def shards(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items, streamed to the driver in lists of at most `limit` bytes of text (or one item)."""
    part, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator():
        if part and size + len(row[1]) > limit:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    yield part


def _only_hits(shared, width: int, row: str):
    """(row, hits) of the texts in which a window of one shard occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shared, width)
        for batch in blocks(batches, "text"):
            found = [[{"first": a, "last": b, "item": i} for a, b, i in scan(t.encode("utf-8", "replace"), made)[1]] for t in strings(batch.column("text"))]
            keep = [k for k, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], _HIT)], names=[row, "hits"])

    return run


def scanned(docs: DataFrame, benchmark: DataFrame, width: int, shard_bytes: int, names: list[str], added: T.StructType, result: Callable) -> DataFrame:
    """The columns `names` of the documents and those that result(texts, words, hits) gives for a batch.

    A benchmark of one shard is one pass without a shuffle. A larger one takes one job a shard, each of which holds one
    automaton and writes its hits alone; they come back to the documents by a row number.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.col("text").cast("string"))
    share = lambda part: spark.sparkContext.broadcast((uuid.uuid4().hex, part))
    parts = shards(benchmark, shard_bytes)
    first, more = next(parts), next(parts, None)
    hits, shared = None, None
    if more is None:
        shared = share(first)
    else:
        row, hits = fresh([*docs.columns, "hits"], "row"), fresh(docs.columns, "hits")
        docs, tables = numbered(docs, row, "decontamination-rows"), []
        for part in chain([first, more], parts):
            one = share(part)
            tables.append(written(docs.select(row, "text").mapInArrow(_only_hits(one, width, row), T.StructType([docs.schema[row], T.StructField("hits", HIT)])), "hits"))
            one.destroy()
        every = reduce(DataFrame.unionAll, tables).groupBy(row).agg(F.flatten(F.collect_list("hits")).alias(hits))
        docs = docs.join(every, row, "left").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shared, width) if shared is not None else None
        for batch in blocks(batches, "text"):
            texts = batch.column("text").to_pylist()
            had = batch.column(hits).to_pylist() if hits else [None] * len(texts)
            counts, found = [], []
            for text, before in zip(texts, had, strict=True):
                w, now = scan((text or "").encode("utf-8", "replace"), made)
                counts.append(len(w))
                found.append([(h["first"], h["last"], h["item"]) for h in before or ()] + now)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *result(texts, counts, found)], names=[*names, *added.names])

    schema = T.StructType([*(f for n in names for f in docs.schema if f.name == n), *added])
    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: words, words inside a window's occurrence, items hit, spans of the original, and the verdict.

    contaminated: some word is hit, and share * n_hit >= n_words.
    """

    def result(texts, counts, found):
        rows = []
        for text, n, hits in zip(texts, counts, found, strict=True):
            runs = runs_of([x[:2] for x in hits])
            n_hit = sum(b - a + 1 for a, b in runs)
            rows.append((n, n_hit, sorted({x[2] for x in hits}), original_spans(text, runs) if runs else [], n_hit > 0 and share * n_hit >= n))
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scanned(rows, benchmark, width, shard_bytes, ["doc_id"], T.StructType.fromDDL(OUT), result)


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of the documents, `contaminated`, and `clean`: the text without the words that are hit."""
    docs = docs.drop("contaminated", "clean")

    def result(texts, counts, found):
        verdicts, clean = [], []
        for text, n, hits in zip(texts, counts, found, strict=True):
            runs = runs_of([x[:2] for x in hits])
            n_hit = sum(b - a + 1 for a, b in runs)
            verdicts.append(n_hit > 0 and share * n_hit >= n)
            at, parts = 0, []
            for s in original_spans(text, runs) if runs else ():
                parts.append(text[at : s["start"]])
                at = s["end"]
            clean.append(text if text is None or not runs else "".join((*parts, text[at:])))
        return [pa.array(verdicts, pa.bool_()), pa.array(clean, pa.string())]

    return scanned(docs, benchmark, width, shard_bytes, docs.columns, T.StructType.fromDDL("contaminated boolean, clean string"), result)
