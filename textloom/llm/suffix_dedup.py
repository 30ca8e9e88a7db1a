"""Exact substring deduplication over a logarithmic family of suffix arrays.

Texts are UTF-8 bytes. A byte goes if some string of `length` bytes that covers it starts anywhere else too, in the same
document or another. Three steps, each over whole texts:

1. Each block of documents gives the suffixes at its sampled anchors (see suffix_core). They are dealt by the bytes after
   the anchor; a task takes them in batches, each of which is sorted and scanned against the levels of its index family.
   Runs of windows that the scan meets again as a whole are settled.
2. Runs that share their anchor's bytes but not all their windows go, one of each kind, with their bytes, through a second
   family, of all their suffixes, whose scan settles single windows.
3. Spans come back to the documents, and their union is cut out.

Shorter repeats can be reported too: the steps then run with `passage` bytes over all texts, and with `length` bytes only
over what is inside repeats of `passage` bytes, as every longer repeat is.

Anchors that hold many rows are found from a sample of the documents that only decides how rows are dealt: runs of such
an anchor are spread by their own bytes in step 1 and cut by the anchor's offset in step 2. Texts are read again rather
than shuffled: a bitmap of bounded size tells which documents a join is about, and only these go through it.

Bytes are compared by 64-bit fingerprints: n different strings hold a false match with a probability of n * n / 2 ** 65.

Defined cases: null text is empty; texts shorter than `length` are kept; repeated rows repeat each other; doc_id is a
column like others, so null and repeated ids matter nothing; an empty table gives no rows. All columns of the input are
returned, but for those named like a column that dedup() adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, chosen, free, fresh, members, numbered, prefix_sums, span_hashes, utf8, written
from textloom.llm.suffix_core import IndexFamily, sampled_suffixes, segments

# place: the first window's start, then in 15, 15 and 2 bits the anchor and the last window from there and how hot the run is
_RUN = {"prefix": pa.int64(), "whole": pa.int64(), "key": pa.int64(), "base": pa.int32(), "place": pa.int64()}
_SETTLED = {"span": pa.bool_(), "prefix": pa.int64(), "key": pa.int64(), "base": pa.int32(), "place": pa.int64(), "repeats": pa.bool_()}
_CONTEXT = {"deal": pa.int64(), "key": pa.int64(), "first": pa.int32(), "repeats": pa.bool_(), "context": pa.binary()}
_SPAN = {"key": pa.int64(), "start": pa.int32(), "end": pa.int32()}
_PIECE = {"key": pa.int64(), "base": pa.int32(), "text": pa.binary()}
_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
BATCH = 1 << 17
LONGEST = (1 << 15) - 1


def _ddl(names: dict) -> str:
    return ", ".join(f"{k} {_TYPES[t]}" for k, t in names.items())


def _batch(names: dict, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(columns, names.values(), strict=True)], names=[*names])


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, anchor, last and hot of places."""
    first = place >> 32
    return first, first + ((place >> 17) & LONGEST), first + ((place >> 2) & LONGEST), place & 3


def _runs(keyed: DataFrame, length: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The sampled suffixes of (key, base, text). hot: anchors, and whole runs, that hold many rows."""
    hot_prefix, hot_whole = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            keys, base = _array(batch, "key"), _array(batch, "base")
            data, offsets = utf8(batch.column("text"))
            doc, begin, end = segments(offsets, length)
            for a, b in _groups(begin, end):
                lo = begin[a]
                r = sampled_suffixes(data[lo : end[b - 1]], begin[a:b] - lo, end[a:b] - lo, length)
                owner = doc[a:b][r["segment"]]
                prefix, whole = r["prefix"].view(np.int64), r["whole"].view(np.int64)
                state = np.isin(prefix, hot_prefix).astype(np.int64)
                state[np.isin(whole, hot_whole)] = 2
                first = r["first"] - (offsets[owner] - lo) + base[owner]
                place = (first << 32) | ((r["anchor"] - r["first"]) << 17) | ((r["last"] - r["first"]) << 2) | state
                yield _batch(_RUN, prefix, whole, keys[owner], base[owner].astype(np.int32), place)

    return keyed.mapInArrow(run, _ddl(_RUN))


def _groups(begin: np.ndarray, end: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring segments, at most `most` bytes together (or one)."""
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + most, "right")))
        yield a, b
        a = b


def _gathered(batches: Iterator[pa.RecordBatch], names: dict) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of BATCH rows or more at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(tuple(_array(batch, c) for c in names))
        size += batch.num_rows
        if size >= BATCH:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 of one task: spans of runs that repeat as a whole, and one run of each kind where kinds share an anchor's bytes."""
    runs, anchors = IndexFamily(), IndexFamily()
    for prefix, whole, key, base, place in _gathered(batches, _RUN):
        columns = (prefix, key, base, place)
        kind = prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ whole.view(np.uint64)
        matched, new, woken = runs.add(kind, *columns)
        matched |= place & 3 == 2
        span = tuple(np.concatenate([c[matched], w]) for c, w in zip(columns, woken, strict=True))
        mixed, _, older = anchors.add(prefix[new], *(c[new] for c in columns), matched[new])
        mixed |= place[new] & 3 > 0
        kinds = tuple(np.concatenate([c[new][mixed], w]) for c, w in zip((*columns, matched), older, strict=True))
        for flag, found, repeats in ((True, span, np.ones(len(span[0]), bool)), (False, kinds[:4], kinds[4])):
            for i in range(0, len(repeats), 50_000):
                yield _batch(_SETTLED, np.full(len(repeats[i : i + 50_000]), flag), *(c[i : i + 50_000] for c in found), repeats[i : i + 50_000])
    free()


def _contexts(length: int, width: int = 8):
    """Step 2, before dealing: the bytes of each run; runs of hot anchors are cut where the anchor's offset changes by `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            deal, keys, firsts, again, found = [], [], [], [], []
            columns = [batch.column(c) for c in ("key", "base", "text", "runs")]
            for key, base, text, runs in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3].to_pylist(), strict=True):
                for r in runs:
                    first, anchor, end, hot = (int(x) for x in _parts(r["place"]))
                    while first <= end:
                        part = (anchor - first) // width if hot else 0
                        last = min(end, anchor - part * width) if hot else end
                        deal.append((r["prefix"] + part * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63))
                        keys.append(key)
                        firsts.append(first)
                        again.append(r["repeats"])
                        found.append(text[first - base : last - base + length])
                        first = last + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((deal, keys, firsts, again, found), _CONTEXT.values(), strict=True)], names=[*_CONTEXT])

    return run


def _match(length: int):
    """Step 2 of one task: the windows, of runs that do not repeat as a whole, that stand in another run too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily()
        for batch in blocks(batches, "context"):
            data, offsets = utf8(batch.column("context"))
            sums = prefix_sums(data)
            sizes = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = offsets[owner] + nth
            columns = (_array(batch, "key")[owner], (_array(batch, "first")[owner] + nth).astype(np.int32), _array(batch, "repeats")[owner])
            matched, _, woken = family.add(span_hashes(sums, start, start + length), *columns)
            key, at, repeats = (np.concatenate([c[matched], w]) for c, w in zip(columns, woken, strict=True))
            key, at = key[~repeats], at[~repeats]
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))[: len(key)])
            tail = np.append(head[1:], len(key)) - 1
            yield _batch(_SPAN, key[head], at[head], (at[tail] if len(key) else at) + np.int32(length))

    return run


def hot_runs(keyed: DataFrame, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and whole runs that would hold over an eighth of a task's even share, at most 8 n of each, by one document in 64."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sample = _runs(keyed.where(F.pmod(F.xxhash64("key"), F.lit(64)) == 0), length, none).select("prefix", "whole")
    counts = sample.groupBy("prefix", "whole").count()
    counts = written(counts, "suffix-sample")
    least = max(16, (counts.agg(F.sum("count")).first()[0] or 0) // (8 * n))
    take = lambda c: np.array([r[0] for r in counts.groupBy(c).agg(F.sum("count").alias("n")).where(F.col("n") >= least).collect()], np.int64)
    return take("prefix"), take("whole")


def _bitmap(df: DataFrame, key: str = "key"):
    return df.sparkSession.sparkContext.broadcast(members(df.select(F.xxhash64(key).alias("hash"))))


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """key and spans, a list of (start, end), of repeated strings in the texts of a written table (key, base, text). Positions count from the text's base; spans may overlap."""
    if not 1 < length <= LONGEST:
        raise ValueError(f"length must be between 2 and {LONGEST}")
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _runs(keyed, length, hot_runs(keyed, length, n))
    hot = F.col("place").bitwiseAND(3)
    deal = F.when(hot == 0, F.col("prefix")).when(hot == 1, F.col("prefix").bitwiseXOR(F.col("whole"))).otherwise(F.xxhash64("key", "place"))
    settled = written(runs.repartition(n, deal).mapInArrow(_settle, _ddl(_SETTLED)), "suffix-settled")
    first = F.shiftright("place", 32)
    last = first + F.shiftright("place", 2).bitwiseAND(LONGEST)
    whole = settled.where("span").select("key", first.cast("int").alias("start"), (last + length).cast("int").alias("end"))
    kinds = settled.where("not span").groupBy("key", "base").agg(F.collect_list(F.struct("prefix", "place", "repeats")).alias("runs"))
    about = _bitmap(settled.where("not span").select("key").distinct())
    contexts = chosen(keyed, "key", about).join(kinds, ["key", "base"]).mapInArrow(_contexts(length), _ddl(_CONTEXT))
    single = contexts.repartition(n, "deal").mapInArrow(_match(length), _ddl(_SPAN))
    spans = written(whole.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans", "zstd")
    about.destroy()
    return spans


def _pieces(length: int):
    """The parts of texts that are inside their spans and `length` bytes long or longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = [(k, a, t[a:b]) for k, t, s in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True) for a, b in union(s) if b - a >= length]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.values(), strict=True)], names=[*_PIECE])

    return run


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans grown to whole UTF-8 characters, so that what is left is text again."""
    grown = []
    for a, b in spans:
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        grown.append({"start": a, "end": b})
    return union(grown)


ADDED = "n_bytes long, n_removed long, n_spans long, n_repeated long, removed array<struct<start: int, end: int>>, kept binary"
_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def dedup(docs: DataFrame, length: int = 400, passage: int | None = None, whole_characters: bool = False) -> DataFrame:
    """All columns, and n_bytes, n_removed, n_spans, n_repeated, removed (the spans in bytes) and kept (the bytes left).

    n_repeated: bytes inside strings of `passage` bytes (`length` unless given, and never more) that start anywhere else too;
    those that are in no string of `length` bytes that does are told by it and not removed.
    """
    added = T.StructType.fromDDL(ADDED)
    docs = docs.drop(*added.names)
    keep = docs.columns
    key = fresh([*keep, "key", "hash", "spans"], "row")
    docs = numbered(docs, key, "suffix-rows")
    keyed = docs.select(F.col(key).alias("key"), F.lit(0).alias("base"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    shorter = min(passage or length, length)
    reported = repeated_spans(keyed, shorter)
    about = _bitmap(reported)
    spans = reported.select(F.col("key").alias(key), F.struct(F.col("spans").alias("reported"), F.col("spans").alias("removed")).alias("spans"))
    if shorter < length:
        inside = chosen(keyed, "key", about).join(reported, "key")
        removed = repeated_spans(written(inside.mapInArrow(_pieces(length), _ddl(_PIECE)), "suffix-pieces", "zstd"), length)
        both = reported.join(removed.withColumnRenamed("spans", "removed"), "key", "left")
        spans = both.select(F.col("key").alias(key), F.struct(F.col("spans").alias("reported"), "removed").alias("spans"))

    def result(batch: pa.RecordBatch, spans: list[dict | None]) -> pa.RecordBatch:
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        cut = [union(s["removed"]) if s else [] for s in spans]
        if whole_characters:
            cut = [whole(t, s) for t, s in zip(texts, cut, strict=True)]
        kept = []
        for text, gone in zip(texts, cut, strict=True):
            at, parts = 0, []
            for a, b in gone:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join((*parts, text[at:])) if gone else text)
        new = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
            pa.array([len(s) for s in cut], pa.int64()),
            pa.array([sum(b - a for a, b in union(s["reported"])) if s else 0 for s in spans], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in cut], _REMOVED),
            pa.array(kept, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *added.names])

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            yield result(batch, batch.column("spans").to_pylist())

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            yield result(batch, [None] * batch.num_rows)

    schema = T.StructType([*docs.select(*(f"`{c}`" for c in keep)).schema, *added])
    hit = chosen(docs, key, about).join(spans, key, "left").mapInArrow(with_spans, schema)
    return hit.unionAll(chosen(docs, key, about, inside=False).mapInArrow(without, schema))
