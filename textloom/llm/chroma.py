"""Chroma fingerprints of media columns, and their alignment.

Samples are cut into overlapping frames; the energy of each frame's spectrum is folded into twelve pitch classes, smoothed
over time and normalised: an image of pitch classes over time. Sixteen filters, differences of rectangle sums read from an
integral image, are each quantised to two Gray-coded bits, which gives one 32-bit integer for each place of a window that
slides over the image. Samples are read as a stream, so a recording of any length costs the memory of its integers.
Recordings are aligned by the integers that they share: the histogram of offsets between equal signs of integers names
offsets, and the bit errors over the whole overlap at each decide. An overlap of few integers proves less than a long one,
so the share of errors that it may have falls with its length.

Equal contents are one class, fingerprinted and aligned once. Queries are recordings flagged as such, held against all
classes.

Defined cases: null media is empty; a recording with fewer frames than the filters' window has no integers and matches
nothing but equal contents; silence and held notes have a fingerprint like any sound, and meet as runs; repeated rows share a class; an empty table gives no rows; columns other
than the keys, the media and the flag are ignored.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, mix, written


@dataclass(frozen=True)
class Settings:
    rate: int = 11025
    frame: int = 4096
    step: int = 1365
    low: float = 28.0
    high: float = 3520.0
    min_overlap: int = 16  # or all of the shorter recording; shorter overlaps may have a share of errors in proportion
    max_error: float = 0.15
    min_votes: int = 1


WINDOW = 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3.0


def filters() -> list[tuple[int, int, int, int, float]]:
    """Sixteen filters by rule: kind, first pitch class, pitch classes, frames, quantiser's step."""
    out = []
    for i in range(16):
        kind = i % 6
        height = (12, 4, 6, 8, 9, 3)[(i * 5 + i // 6) % 6]
        width = (4, 6, 8, 12, 16, 15)[(i + i // 6) % 6]
        out.append((kind, (i * 7) % (13 - height), height, width, 0.05 + 0.01 * (i % 3)))
    return out


def wav_samples(raw: bytes | None, rate: int) -> Iterator[np.ndarray]:
    """Mono samples in -1 .. 1 at `rate`, by linear interpolation, in pieces."""
    if not raw:
        return
    with wave.open(io.BytesIO(raw)) as w:
        kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[w.getsampwidth()]
        total, ratio = w.getnframes(), w.getframerate() / rate
        n, done, seen, last = max(1, round(total / ratio)), 0, 0, np.zeros(0, np.float32)
        while seen < total:
            x = np.frombuffer(w.readframes(READ), kind).astype(np.float32).reshape(-1, w.getnchannels()).mean(1)
            if not len(x):
                return
            x = (x - 128) / 128 if w.getsampwidth() == 1 else x / float(1 << (8 * w.getsampwidth() - 1))
            seen += len(x)
            x = np.concatenate([last, x])  # the sample before, for the places between
            stop = n if seen >= total else min(n, int((seen - 1) / ratio) + 1)
            at = np.arange(done, stop) * ratio - (seen - len(x))
            done, last = stop, x[-1:]
            yield np.interp(at, np.arange(len(x)), x).astype(np.float32)


NOTE, TONES, CHORD = 512, 36, 3
READ = 1 << 16  # samples decoded at a time
FRAMES = 1 << 12  # frames turned into integers at a time


@cache
def _tones(rate: int, note: int) -> np.ndarray:
    return (np.sin(2 * np.pi * np.arange(note) * (220 * 2 ** (np.arange(TONES)[:, None] / 12)) / rate) / CHORD).astype(np.float32)


def spoken(text: str | None, rate: int, note: int = NOTE) -> Iterator[np.ndarray]:
    """A melody for a text, in pieces: each word is a chord of CHORD tones, `note` samples long, that its letters choose. A stand-in for recordings in tables of text."""
    words = (text or "").split()
    tones, step = _tones(rate, note), max(1, READ // note)
    for i in range(0, len(words), step):
        hashed = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words[i : i + step]], np.int64)
        yield sum(tones[hashed // TONES**k % TONES] for k in range(CHORD)).ravel()


def energies(pieces: Iterable[np.ndarray], s: Settings) -> Iterator[np.ndarray]:
    """Blocks of frames by twelve pitch classes: the energy of each."""
    freq = np.fft.rfftfreq(s.frame, 1 / s.rate)
    used = (freq >= s.low) & (freq <= s.high)
    fold = np.zeros((int(used.sum()), 12), np.float32)
    fold[np.arange(len(fold)), np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    shape, held = np.hamming(s.frame).astype(np.float32), np.zeros(0, np.float32)
    for piece in pieces:
        held = np.concatenate([held, piece])
        n = (len(held) - s.frame) // s.step + 1
        for i in range(0, n, 256):
            part = np.lib.stride_tricks.sliding_window_view(held, s.frame)[i * s.step : (min(n, i + 256) - 1) * s.step + 1 : s.step]
            spectrum = np.fft.rfft(part * shape)[:, used]
            yield (spectrum.real**2 + spectrum.imag**2) @ fold
        held = held[max(0, n) * s.step :]


def smoothed(padded: np.ndarray) -> np.ndarray:
    """Frames smoothed over time, each of length 1 (or 0 in silence); two frames at either end of `padded` go."""
    n = max(0, len(padded) - 4)
    image = sum(w * padded[k : k + n] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((image**2).sum(1, keepdims=True))
    return np.where(norm > 0.01, image / np.maximum(norm, 0.01), 0)


def recording_codes(pieces: Iterable[np.ndarray], s: Settings) -> np.ndarray:
    """The integers of one recording, from its samples in pieces."""
    out, held, waiting = [], np.zeros((0, 12)), 0
    more, last = [], None
    for block in energies(pieces, s):
        more += [block[:1], block[:1], block] if last is None else [block]  # the first frame stands for two before it
        last, waiting = block[-1:], waiting + len(block)
        if waiting >= FRAMES:
            held, more, waiting = np.concatenate([held, *more]), [], 0
            out.append(codes(smoothed(held)))
            held = held[max(0, len(held) - WINDOW - 3) :]
    if last is not None:
        out.append(codes(smoothed(np.concatenate([held, *more, last, last]))))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def codes(image: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for each place of the window."""
    n = len(image) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, p0: int, p1: int) -> np.ndarray:
        return sums[t + t1, p1] - sums[t + t0, p1] - sums[t + t1, p0] + sums[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w, step in filters():
        a, b = p + h, p + h // 2
        whole = area(0, w, p, a)
        if kind == 0:
            plus, minus = whole, np.full(n, w * h * 0.12)  # about what a chord of a few notes spreads over twelve classes
        elif kind == 1:
            plus = area(0, w, p, b)
            minus = whole - plus
        elif kind == 2:
            plus = area(0, w // 2, p, a)
            minus = whole - plus
        elif kind == 3:
            plus = area(0, w // 2, p, b) + area(w // 2, w, b, a)
            minus = whole - plus
        elif kind == 4:
            plus, inner = area(0, w, p + h // 3, p + 2 * h // 3), 2 * h // 3 - h // 3
            minus = (whole - plus) * (inner / (h - inner))
        else:
            plus, inner = area(w // 3, 2 * w // 3, p, a), 2 * w // 3 - w // 3
            minus = (whole - plus) * (inner / (w - inner))
        value = np.log1p(np.maximum(plus, 0)) - np.log1p(np.maximum(minus, 0))
        level = (value > -step).astype(np.uint32) + (value > 0) + (value > step)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbouring levels differ in one bit
    return out


def fingerprint(media: DataFrame, decode: Callable[[object, int], Iterable[np.ndarray]] = wav_samples, settings: Settings = Settings()) -> DataFrame:
    """(class_id, media) to (class_id, codes array<int>). A task holds a piece of one recording's samples at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", 256 << 10):
            found = [recording_codes(decode(x, settings.rate), settings).view(np.int32) for x in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(found, pa.list_(pa.int32()))], names=["class_id", "codes"])

    return media.select("class_id", "media").mapInArrow(run, "class_id long, codes array<int>")


GAPS = ((0, 6, 12, 18), (0, 4, 8, 12), (0, 2, 4, 6))  # of the integers of a key: sixteen signs of each of four
NEAR = ((0, 2), (0, 1), (0,))  # keys of recordings with fewer than SHORT integers, which may lack some of those: signs of two, or one whole
SHORT = 10
BLOCK_CODES, BATCH_CODES, BATCH_PLACES = 1 << 20, 1 << 16, 1 << 19  # integers of queries held by a task, of recordings looked up at once, places compared at once


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """The signs of up to four integers, or one integer, in 64 bits."""
    if len(parts) == 1:
        return parts[0].astype(np.uint64)
    out = np.zeros(len(parts[0]), np.uint64)
    for k in range(0, len(parts), 2):
        two = (parts[k] & np.uint32(0xAAAAAAAA)) | ((parts[k + 1] & np.uint32(0xAAAAAAAA)) >> np.uint32(1))
        out = (out << np.uint64(32)) | two
    return out


def keys(flat: np.ndarray, ends: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, recording, place, length) of recordings laid end to end: a run of places with one key, as silence and held notes have, is one row.

    Short recordings ask by the near keys too, and all answer; long ones ask so of short recordings only.
    """
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - ends[owner]
    short, every = sizes[owner] < SHORT, np.ones(len(flat), bool)
    kinds = [(k, gaps, every) for k, gaps in enumerate(GAPS)]
    for k, gaps in enumerate(NEAR):  # even: short ones ask all; odd: long ones ask short ones
        kinds += [(len(GAPS) + 2 * k, gaps, short if asked else every), (len(GAPS) + 2 * k + 1, gaps, ~short if asked else short)]
    kinds = [(k, gaps, valid & (at + gaps[-1] < sizes[owner])) for k, gaps, valid in kinds]
    out = []
    for kind, gaps, valid in kinds:
        i = np.flatnonzero(valid)
        key = mix(_packed([flat[i + g] for g in gaps]) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64)))  # kinds apart but for chance, which the bit errors undo
        first = np.ones(len(i), bool)
        first[1:] = (key[1:] != key[:-1]) | (owner[i[1:]] != owner[i[:-1]])
        start = np.flatnonzero(first)
        out.append((key[start], owner[i[start]], at[i[start]], np.diff(np.append(start, len(i)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SEEN_BITS = 27


class Asked:
    """The keys of a block of queries, sorted, with the distinct ones, where each begins, and a bitmap of 16 MB that tells most other keys apart without a search."""

    def __init__(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        order = np.argsort(rows[0], kind="stable")
        key, self.owner, self.at, self.length = (c[order] for c in rows)
        self.begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        self.key = key[self.begin]
        self.begin = np.append(self.begin, len(key))
        self.bits = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
        place = self.key >> np.uint64(64 - SEEN_BITS)
        np.bitwise_or.at(self.bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are asked for, and the range of rows that ask for each."""
        place = key >> np.uint64(64 - SEEN_BITS)
        some = np.flatnonzero((self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        at = np.searchsorted(self.key, key[some])
        same = self.key[np.minimum(at, len(self.key) - 1)] == key[some]
        return some[same], self.begin[at[same]], self.begin[at[same] + 1]


def _votes(asked: Asked, rows: tuple, x_sizes: np.ndarray, y_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, recording, offset, votes): runs of one key may begin or end together."""
    hit, low, high = asked.find(rows[0])
    owner, at, length = (c[hit] for c in rows[1:])
    hit = np.arange(len(hit))
    less = int(x_sizes.max(initial=0))
    span, many = less + int(y_sizes.max(initial=0)) + 1, max(1, len(x_sizes))
    total, codes, counts = np.cumsum(high[hit] - low[hit]), [], []
    while len(hit):
        stop = max(1, int(np.searchsorted(total, BATCH_PLACES, "right")))
        part, n = hit[:stop], high[hit[:stop]] - low[hit[:stop]]
        r = np.repeat(part, n)
        q = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
        begin, end = at[r] - asked.at[q], at[r] + length[r] - asked.at[q] - asked.length[q]
        v, two, pair = np.minimum(length[r], asked.length[q]), np.flatnonzero(begin != end), (owner[r] * many + asked.owner[q]) * span + less
        code, count = _summed(np.append(pair + begin, (pair + end)[two]), np.append(v, v[two]))
        codes.append(code), counts.append(count)
        hit, total = hit[stop:], total[stop:] - total[stop - 1]
    if not codes:
        return (np.zeros(0, np.int64),) * 4
    code, votes = _summed(np.concatenate(codes), np.concatenate(counts)) if len(codes) > 1 else (codes[0], counts[0])
    pair, offset = np.divmod(code, span)
    return pair % many, pair // many, offset - less, votes


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code)
    code, count = code[order], count[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[start], np.add.reduceat(count, start)


def _errors(x: np.ndarray, x0: np.ndarray, y: np.ndarray, y0: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit errors of x[x0 : x0 + n] against y[y0 : y0 + n], each n at least 1."""
    out, done, total = np.zeros(len(n), np.int64), 0, np.cumsum(n)
    while done < len(n):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + BATCH_PLACES, "right")))
        m = n[done:stop]
        begin = np.cumsum(m) - m
        step = np.arange(int(m.sum()))
        bits = np.bitwise_count(x[step + np.repeat(x0[done:stop] - begin, m)] ^ y[step + np.repeat(y0[done:stop] - begin, m)])
        out[done:stop] = np.add.reduceat(bits, begin, dtype=np.int64)
        done = stop
    return out


def allowed(n: np.ndarray, s: Settings) -> np.ndarray:
    """The share of errors that an overlap of n integers may have."""
    return s.max_error * np.minimum(1.0, n / s.min_overlap)


def _tested(x: np.ndarray, x0: np.ndarray, y: np.ndarray, y0: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Which overlaps have no more errors than allowed, and their bit errors. One whose first half has too many for the whole is not read on."""
    half = (n + 1) // 2
    errors = _errors(x, x0, y, y0, half)
    most = allowed(n, s)
    ok = np.flatnonzero(errors <= 32.0 * n * most)
    rest = ok[n[ok] > half[ok]]
    errors[rest] += _errors(x, (x0 + half)[rest], y, (y0 + half)[rest], (n - half)[rest])
    error = errors[ok] / (32.0 * n[ok])
    good = error <= most[ok]
    return ok[good], error[good]


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in codes], np.int64)
    return codes.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32), np.concatenate([[0], np.cumsum(sizes)])


FOUND = "query_id long, match_id long, offset int, overlap int, votes long, bit_error double"


def _held(prints: DataFrame, block: tuple[np.ndarray, pa.Array], settings: Settings) -> DataFrame:
    """All recordings against one block of queries. Every offset that any key names is tested by its bit errors."""
    shared = prints.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = shared.value
        x, x_ends = _flat(codes)
        asked = Asked(keys(x, x_ends, True))
        for batch in batches:
            y_all, ends_all = _flat(batch.column("codes"))
            names, i = batch.column("class_id").to_numpy(zero_copy_only=False), 0
            while i < len(names):
                j = max(i + 1, int(np.searchsorted(ends_all, ends_all[i] + BATCH_CODES, "right")) - 1)
                y, y_ends, own = y_all[ends_all[i] : ends_all[j]], ends_all[i : j + 1] - ends_all[i], names[i:j]
                nx, ny = np.diff(x_ends), np.diff(y_ends)
                q, r, offset, votes = _votes(asked, keys(y, y_ends, False), nx, ny)
                i = j
                begin = np.maximum(0, -offset)
                overlap = np.minimum(nx[q] - begin, ny[r] - offset - begin)
                least = np.minimum(settings.min_overlap, np.minimum(nx[q], ny[r]))
                ok = np.flatnonzero((ids[q] != own[r]) & (overlap >= least) & (votes >= settings.min_votes))
                q, r, offset, votes, begin, overlap = (c[ok] for c in (q, r, offset, votes, begin, overlap))
                ok, error = _tested(x, x_ends[q] + begin, y, y_ends[r] + begin + offset, overlap, settings)
                q, r, offset, votes, overlap = (c[ok] for c in (q, r, offset, votes, overlap))
                order = np.lexsort((offset, -overlap, error, r, q))
                best = order[np.append(True, (q[order][1:] != q[order][:-1]) | (r[order][1:] != r[order][:-1]))[: len(order)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[q[best]], own[r[best]], offset[best].astype(np.int32), overlap[best].astype(np.int32), votes[best], error[best])], names=["query_id", "match_id", "offset", "overlap", "votes", "bit_error"])

    return prints.select("class_id", "codes").mapInArrow(run, FOUND)


def aligned(prints: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, match_id, offset, overlap, votes, bit_error): for each query class and any other class the offset of least bit error.

    prints: (class_id, codes). Equal contents are one class already. Places are looked up by keys of sign bits (the Gray codes' upper halves, which noise turns least)
    of spaced integers. All offsets that at least `min_votes` keys name are tested, and the bit errors alone decide. An overlap has
    `min_overlap` integers, or all of the shorter recording where it has fewer. A task holds one block of queries; recordings are
    read once for each block.
    """
    asked = written(prints.where(F.size("codes") > 0).join(queries.select("class_id"), "class_id", "left_semi"), "chroma-asked")
    n = max(1, -(-(asked.agg(F.sum(F.size("codes"))).first()[0] or 0) // BLOCK_CODES))
    found = None
    for i in range(n):
        block = asked.where(F.pmod(F.xxhash64(F.col("class_id"), F.lit(7)), F.lit(n)) == i).toArrow().combine_chunks()
        codes = block.column("codes").combine_chunks()
        part = _held(prints, (block.column("class_id").to_numpy().astype(np.int64), codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes), settings)
        found = part if found is None else found.unionAll(part)
    return found


def search(media: DataFrame, keys: list[str], decode: Callable[[object, int], Iterable[np.ndarray]] = wav_samples, settings: Settings = Settings()) -> DataFrame:
    """media: keys, media, is_query. A row for each recording: keys, class_id, n_codes, is_query and, for queries, matches between classes."""
    raw = F.coalesce(F.col("media").cast("binary"), F.lit(b""))
    rows = media.select(*keys, "media", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.xxhash64(raw).alias("class_id"))
    classes = rows.groupBy("class_id").agg(F.first("media").alias("media"), F.max("is_query").alias("asked"))
    prints = written(fingerprint(classes, decode, settings), "chroma-prints")
    asked = rows.where("is_query").select("class_id").distinct()
    found = written(aligned(prints, asked, settings), "chroma-matches")
    lists = found.groupBy(F.col("query_id").alias("class_id")).agg(F.sort_array(F.collect_list(F.struct("match_id", "offset", "overlap", "votes", "bit_error"))).alias("matches"))
    out = rows.drop("media").join(prints.select("class_id", F.size("codes").alias("n_codes")), "class_id").join(lists, "class_id", "left")
    return out.select(*keys, "class_id", "n_codes", "is_query", F.when(F.col("is_query"), F.coalesce("matches", F.expr("array()").cast("array<struct<match_id: bigint, offset: int, overlap: int, votes: bigint, bit_error: double>>"))).alias("matches"))
