"""Token-id files: raw id payloads in shards with a minimal perfect hash index from document keys to offsets.

A shard: magic, ids (16 or 32 bits, little-endian), then a footer: document ids, where each document's ids begin, the
minimal perfect hash, for each of its numbers the document's place and a 32-bit fingerprint of the key, a JSON header,
its length, magic. The hash gives a document's ids with one index lookup; the fingerprint tells foreign keys.

Defined cases: a null or empty text has the end id only; a null doc_id comes first and is looked up as None; rows that
repeat a doc_id are all kept, next to each other, and looked up by their number among them; an empty table makes no
shard and no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.llm.common import blocks, mix, new_path, prefix_sums, span_hashes, strings, written
from textloom.llm.mph import MinimalPerfectHash

MAGIC = b"TLIDS\0\0\1"
SHARD_IDS = 16 << 20
MEMO_ENTRIES = 800_000


# -- the file format


def keys_of(doc_ids: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """A 64-bit key of each document id and its number among equal ones, which stand together."""
    new = np.ones(len(doc_ids), bool)
    new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (is_null[1:] != is_null[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(doc_ids)) - starts[np.cumsum(new) - 1]
    return key(doc_ids, nth, is_null)


def key(doc_ids, nth, is_null) -> np.ndarray:
    x = mix(np.asarray(doc_ids, np.int64).view(np.uint64) * np.uint64(2) + np.asarray(is_null, np.uint64))
    x ^= (np.asarray(doc_ids, np.int64) < 0).astype(np.uint64) << np.uint64(63)  # the doubling drops the top bit
    return mix(x + np.asarray(nth, np.uint64) * np.uint64(0x9FB21C651E98DF25))


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.n_ids = out, width, 0
        self.doc_ids: list[int | None] = []
        self.starts = [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n_ids += len(ids) // self.width
        self.doc_ids.append(doc_id)
        self.starts.append(self.n_ids)

    def close(self) -> None:
        is_null = np.array([d is None for d in self.doc_ids], bool)
        doc_ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        keys = keys_of(doc_ids, is_null)
        index = MinimalPerfectHash.build(keys)
        at = index.lookup(keys)
        places, prints = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4")
        places[at], prints[at] = np.arange(len(keys)), keys >> np.uint64(32)
        parts = {"doc_ids": doc_ids.tobytes(), "null": is_null.tobytes(), "starts": np.array(self.starts, "<i8").tobytes(), "index": index.to_bytes(), "places": places.tobytes(), "prints": prints.tobytes()}
        for raw in parts.values():
            self.out.write(raw)
        head = json.dumps({"width": self.width, "n_ids": self.n_ids, "parts": {k: len(v) for k, v in parts.items()}}).encode()
        self.out.write(head + len(head).to_bytes(8, "little") + MAGIC)
        self.out.close()


class ShardReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token-id shard")
        n = int.from_bytes(tail[:8], "little")
        head = json.loads(file.read_at(n, size - 16 - n))
        self.width, self.n_ids = head["width"], head["n_ids"]
        at, part = 8 + self.width * self.n_ids, {}
        for k, length in head["parts"].items():
            part[k] = file.read_at(length, at)
            at += length
        self.doc_ids, self.is_null = np.frombuffer(part["doc_ids"], "<i8"), np.frombuffer(part["null"], bool)
        self.starts = np.frombuffer(part["starts"], "<i8")
        self.index, _ = MinimalPerfectHash.from_bytes(part["index"])
        self.places, self.prints = np.frombuffer(part["places"], "<u4"), np.frombuffer(part["prints"], "<u4")

    def places_of(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the shard, -1 for a key that it does not hold (but for 2 ** -32 of them)."""
        at = self.index.lookup(keys)
        known = (at >= 0) & (self.prints[at] == (keys >> np.uint64(32)).astype(np.uint32)) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.places[at].astype(np.int64) if len(self.prints) else -1, -1)

    def ids_at(self, place: int) -> np.ndarray:
        a, b = int(self.starts[place]), int(self.starts[place + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, 8 + a * self.width), f"<u{self.width}")

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        place = int(self.places_of(key([doc_id or 0], [nth], [doc_id is None]))[0])
        return None if place < 0 else self.ids_at(place)


# -- a tokenizer file read by the tokenizers library, with memos of white-space chunks and of their pieces

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"  # fixed by the tokenizer file


SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of single bytes, and of two-byte characters from U+0080 on (by 64 for each first byte from 0xC2): what PIECE takes them for, and in lower case the (second) byte. ODD: left to the library."""

    def kind(c: str) -> int:
        if c in " \n":
            return SPACE
        if not c.isprintable() and c != "\xad" or c.isspace() or ord(c) > 0x12F:
            return ODD
        return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], SIGN)

    single = np.array([kind(chr(b)) if b < 128 else ODD for b in range(256)], np.uint8)
    lower = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
    double = np.array([*(kind(chr(c)) for c in range(0x80, 0x140)), ODD], np.uint8)
    second = np.array([*(chr(c).lower().encode()[-1] for c in range(0x80, 0x140)), 0], np.uint8)
    return single, lower, double, second


class PieceMemo:
    """Ids of pieces by a 64-bit hash of their bytes: sorted keys, and where each one's ids stand."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, f"<u{self.width}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64) // self.width
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")  # of two sorted runs: a merge
        self.keys, self.starts, self.sizes = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.starts, starts), (self.sizes, sizes)))


class WordPieces:
    """Ids by the tokenizers library, each distinct piece of the file's own pattern once.

    Texts of Latin letters, digits and signs are cut into pieces all at once, as bytes; the library sees a piece when it comes for
    the first time, many in one text. All other texts go by chunks, see chunked().
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = width
        self.cut = self._cut()
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.memo = PieceMemo(width)

    def _cut(self):
        """The pattern, if the file normalises and splits as this class assumes, else None: chunks are then encoded whole."""
        spec = json.loads(self.tokenizer.to_str())
        says = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        assumed = all(x in says for x in ('"NFC"', '"Lowercase"', '"Removed"', "'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"))
        return regex.compile(PIECE) if assumed else None

    # no white space, no combining marks, and letters whose lower case is one letter by any rule
    _latin = regex.compile("[\x21-\x7e\xa1-į]*")

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are one word each: many in one text, cut behind the tokens that end a word."""
        out = []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, f"<u{self.width}")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):
                out += self._raw(part)
                continue
            raw, at = ids.tobytes(), [0, *(ends * self.width).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _resolve(self, new: set[str]) -> None:
        """Put the ids of chunks that are not known yet into the memo."""
        chunks, pieces = self.chunks, self.pieces
        if len(chunks) > MEMO_ENTRIES:
            chunks.clear()
        if len(pieces) > MEMO_ENTRIES:
            pieces.clear()
        words, signed, cut, rest = [], [], [], []
        for c in new:
            if not self.cut or not ((c.isascii() and c.isprintable()) or self._latin.fullmatch(c)):
                rest.append(c)
            elif c.isalpha():
                words.append((c, c.lower()))
            elif c[:-1].isalpha() and c[-1] in ".,;:!?":  # letters and one sign
                signed.append((c, c[:-1].lower(), c[-1]))
            else:
                cut.append((c, self.cut.findall(c.lower())))
        need = {w for _, w in words}
        need.update(x[1] for x in signed)
        need.update(x[2] for x in signed)
        need.update(chain.from_iterable(x[1] for x in cut))
        fresh = [*(need - pieces.keys())]
        pieces.update(zip(fresh, self._words(fresh), strict=True))
        for c, w in words:
            chunks[c] = pieces[w]
        for c, w, sign in signed:
            chunks[c] = pieces[w] + pieces[sign]
        for c, parts in cut:
            chunks[c] = b"".join(map(pieces.__getitem__, parts))
        chunks.update(zip(rest, self._raw(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut or not texts:
            return self.chunked(texts)
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n\n\n", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw])
        starts, stops, lowered, odd = pieces_of(data, ends)
        keys = span_hashes(prefix_sums(lowered), starts, stops)
        kinds, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.memo.keys) > MEMO_ENTRIES:
            self.memo.clear()
        _, known = self.memo.find(kinds)
        if not known.all():
            said, new = lowered.tobytes(), first[~known]
            words = [said[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            self.memo.add(kinds[~known], self._words(words))
        at, _ = self.memo.find(kinds)
        sizes, begin = self.memo.sizes[at][inverse], self.memo.starts[at][inverse]
        upto = np.cumsum(sizes)
        ids = self.memo.ids[np.repeat(begin - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        per_text = np.bincount(np.searchsorted(ends, starts, "right"), sizes, minlength=len(texts)).astype(np.int64)
        flat, edge = ids.tobytes(), np.concatenate([[0], np.cumsum(per_text) * self.width]).tolist()
        out = [flat[a:b] for a, b in zip(edge, edge[1:])]
        for i, other in zip(odd, self.chunked([texts[i] for i in odd]), strict=True):
            out[i] = other
        return out

    def chunked(self, texts: list[str]) -> list[bytes]:
        """Each distinct chunk between blanks once: white space never stands inside a token of this tokenizer, so chunks between blanks and line ends are independent. Chunks of plain letters and signs are cut further by the file's own pattern."""
        flat, ends = [], [0]
        for t in texts:
            flat += t.replace("\n", " ").split(" ")
            ends.append(len(flat))
        found = [*map(self.chunks.get, flat)]
        holes, i = [], -1
        with suppress(ValueError):  # from index(), after the last one
            while True:
                i = found.index(None, i + 1)
                holes.append(i)
        if holes:
            self._resolve({flat[i] for i in holes})
            for i in holes:
                found[i] = self.chunks[flat[i]]
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]


def pieces_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Where the pieces of PIECE begin and end in texts that end (with a line end) at `ends`; all bytes in lower case; and the texts with characters that are left to the library, which have no pieces here."""
    single, lower, double, second = _classes()
    kind, lowered = single[data], lower[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high]
        code = np.where((lead >= 0xC2) & (lead <= 0xC4), (lead.astype(np.int64) - 0xC2) * 64 + (data[high + 1] & 0x3F), len(double) - 1)
        kind[high] = kind[high + 1] = double[code]
        fine = high[double[code] != ODD]
        lowered[fine + 1] = second[code[double[code] != ODD]]
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == ODD), "right")).tolist()
    for i in odd:
        kind[(ends[i - 1] if i else 0) : ends[i]] = SPACE
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == DIGIT) & ((data[1:] & 0xC0) != 0x80))
    # 's 't 'm 'd 're 've 'll: an apostrophe by itself takes these letters with it
    quote = np.flatnonzero((data[:-2] == 0x27) & (kind[:-2] == SIGN) & (kind[1:-1] == LETTER))
    quote = quote[new[quote]]
    a, b = lowered[quote + 1], lowered[quote + 2]
    both = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    taken = quote + np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 2, np.where(both, 3, 0))
    quote, taken = quote[taken > quote], taken[taken > quote]
    new[quote + 1] = False
    new[taken] = True
    edge = np.flatnonzero(new)
    inside = kind[edge] != SPACE
    return edge[inside], np.append(edge[1:], len(data))[inside], lowered, odd


@cache
def _word_pieces(path: str, width: int) -> WordPieces:
    return WordPieces(path, width)


def encoder(path: str, width: int) -> Callable[[list[str]], list[bytes]]:
    return _word_pieces(path, width).encode


# -- over tables


def write_shards(docs: DataFrame, folder: str, make_encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, width: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents in ascending order of doc_id; a manifest row for each shard.

    Documents are range-partitioned and sorted; a task closes a shard after shard_ids ids, so it holds one block of
    texts and one shard's index at a time.
    """
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, name, seq, made = make_encoder(), None, "", 0, []

        def closed():
            shard.close()
            first = shard.doc_ids[0]
            made.append((name, seq, first, len(shard.doc_ids), shard.n_ids))

        for batch in blocks(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(strings(batch.column("text"))), strict=True):
                if shard is None:
                    out, name = files.create(folder, ".ids")
                    shard = ShardWriter(out, width)
                shard.add(doc_id, ids + end)
                if shard.n_ids >= shard_ids:
                    closed()
                    shard, seq = None, seq + 1
        if shard is not None:
            closed()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["name", "seq", "first_doc", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "name string, seq int, first_doc long, n_docs long, n_ids long"), "ids-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds `base`, the ids in all shards before; one small row a shard."""
    w = Window.orderBy(F.col("first_doc").asc_nulls_first(), "seq", "name").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32, all from the files, found through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.random(folder, name) as f:
                    shard = ShardReader(f)
                    places = shard.places_of(keys_of(shard.doc_ids, shard.is_null))
                    if (places < 0).any():
                        raise ValueError(f"{name}: a document is not in the index")
                    n = shard.starts[places + 1] - shard.starts[places]
                    crc = [zlib.crc32(shard.ids_at(p).astype("<u4").tobytes()) for p in places.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), pa.int64(), mask=shard.is_null), pa.array(base + shard.starts[places]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    spread = manifest.select("name", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, vocabulary: str, end_id: int, width: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, write the shards to the shared folder and read them back. width 2 holds vocabularies of at most 65,536."""
    folder = new_path(docs.sparkSession, "ids")
    manifest = write_shards(docs, folder, partial(encoder, vocabulary, width), end_id, width, shard_ids)
    return read_shards(with_base(manifest), folder)
