"""Cross-entropy difference between a target and a background language model.

Both are models of pairs of neighbouring words over one shared vocabulary (all words of the corpus and one mark for a
text's begin and end), counted over all documents: the background from every text, the target from those flagged. A pair is
smoothed towards the single word, and this towards the uniform over the vocabulary; both models are smoothed alike. A
text's score is the mean over its words and its end of the target's loss less the background's, in nats: lower is more
like the target.

What is counted grows with the corpus, so no task and not the driver ever holds it all. Texts are written in blocks. A block
sends its distinct words and pairs once, as sorted and packed hashes, to the tasks that own their ranges; these add up the
blocks' counts and send back the sums in the block's own order; the block then scores its texts. A word that stands
everywhere costs a range one number a block, so no range is hot. How many ranges there are follows the corpus, whatever the
session's partitions, so that a range fits a worker; it is added up slice by slice. The exchange has a row for each block and
range: for more ranges, take larger blocks.

Words are what stands between ASCII blanks, told apart by 55-bit hashes. Defined cases: a null or empty text has no tokens
and scores 0; without a target document the target model is the uniform one; a null doc_id or flag is no target; repeated
documents count and score each; texts of any length are counted and scored in pieces that know the word before them; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, free, mix, prefix_sums, span_hashes, utf8, written

STRENGTH = 8.0
BLOCK_BYTES = 2 << 20
RANGE_WORDS = 3 << 20  # a range's share of the corpus's words, at most: about as many keys
SLICE_KEYS = 1 << 18
TASK_BLOCKS = 8
HASH_BYTES = 1 << 18
OUT_BYTES = 4 << 20
BROADCAST_IDS = 1 << 20
BOUNDARY = np.uint64(0x9D39247E33776D41)  # the hash of the mark at a text's begin and end
_BLANK = np.zeros(256, bool)
BLANKS = "\t\n\v\f\r "
_BLANK[[ord(c) for c in BLANKS]] = True

BLOCK = "block long, row array<long>, doc_id array<long>, is_target array<boolean>, before array<string>, ends array<boolean>, text array<string>, words long"
PART = "block long, part int, keys binary, n_all binary, n_target binary"
SUMS = "block long, part int, n_all binary, n_target binary, kinds long, total_all long, total_target long"
PIECE = "row long, doc_id long, n_tokens long, n_scored long, target double, background double"


def _pieces(text: str, most: int) -> Iterator[tuple[str | None, str, bool]]:
    """(the word before or null, piece, whether it is the last): pieces of about `most` characters, cut at blanks."""
    before, at = None, 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in BLANKS)
        if cut < 0:
            cut = min((k for k in (text.find(c, at + most) for c in BLANKS) if k >= 0), default=len(text))
        piece = text[at:cut]
        yield before, piece, False
        words = piece.rstrip(BLANKS)
        before, at = words[max(words.rfind(c) for c in BLANKS) + 1 :] or before, cut
    yield before, text[at:], True


def _blocks(limit: int):
    """Documents to BLOCK rows of at most `limit` characters of text, each piece with the number of its document, and how many words a block has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        block, row, held, size, words = serial, serial, [], 0, 0

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*held, strict=True), kinds, strict=True)), pa.array([words], pa.int64())], names=["block", "row", "doc_id", "is_target", "before", "ends", "text", "words"])

        for batch in blocks(batches, "text", limit):
            for doc_id, text, flag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "is_target")), strict=True):
                for before, piece, last in _pieces(text, limit):
                    if held and size + len(piece) > limit:
                        yield made()
                        block, held, size, words = block + 1, [], 0, 0
                    held.append((row, doc_id, flag, before, last, piece))
                    size += len(piece)
                    words += 1 + sum(map(piece.count, BLANKS))  # at most, with the text's end
                row += 1
        if held:
            yield made()

    return run


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has."""
    data, offsets = utf8(texts)
    count = len(offsets) - 1
    spaced = np.full(len(data) + count + 1, 32, np.uint8)
    spaced[np.arange(len(data)) + 1 + np.repeat(np.arange(count), np.diff(offsets))] = data
    edge = np.flatnonzero(np.diff((~_BLANK[spaced]).astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    owner = np.searchsorted(offsets[1:] + np.arange(1, count + 1), starts, "left")
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # some bytes at a time, as running sums take many times the text
        a = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, a + HASH_BYTES, "right")))
        out[at:stop] = span_hashes(prefix_sums(spaced[a : ends[stop - 1]]), starts[at:stop] - a, ends[at:stop] - a)
        at = stop
    return out, np.bincount(owner, minlength=count)


class Block:
    """The n-grams of a block's pieces: `keys`, distinct and sorted, and for each predicted token the places of its word, context and pair in them."""

    def __init__(self, texts: pa.Array, before: pa.Array, ends: np.ndarray):
        words, self.sizes = word_hashes(texts)
        first, known = word_hashes(before)
        lead = np.full(len(known), BOUNDARY)
        lead[known > 0] = first  # a word before is one word
        scored = self.sizes + (ends & ((self.sizes > 0) | (known > 0)))
        self.scored, self.owner = scored, np.repeat(np.arange(len(scored)), scored)
        begin = np.cumsum(scored) - scored
        token = np.full(int(scored.sum()), BOUNDARY)
        token[np.arange(len(words)) + np.repeat(begin - (np.cumsum(self.sizes) - self.sizes), self.sizes)] = words
        context = np.append(BOUNDARY, token)[: len(token)]
        heads, some = begin[scored > 0], scored > 0
        context[heads] = lead[some]
        odd, even = np.uint64(1), ~np.uint64(1)
        one = lambda x: (mix(x) >> np.uint64(8)) | odd
        two = (mix(mix(context) * np.uint64(3) + token) >> np.uint64(8)) & even
        self.keys, places = np.unique(np.concatenate([one(token), two, one(lead[some])]), return_inverse=True)
        self.word, self.pair = places[: len(token)], places[len(token) : 2 * len(token)]
        self.context = np.append(0, self.word)[: len(token)]
        self.context[heads] = places[2 * len(token) :]

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How often each key stands in the flagged pieces."""
        chosen = flags[self.owner]
        return np.bincount(np.concatenate([self.word[chosen], self.pair[chosen]]), minlength=len(self.keys))


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, low bytes first, in as many bytes as the largest needs (a leading byte tells it): high ones, mostly 0, compress well."""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _of_row(batch: pa.RecordBatch, i: int) -> tuple[Block, np.ndarray]:
    value = lambda c: batch.column(c)[i].values
    flags = value("is_target").to_numpy(zero_copy_only=False).astype(bool)
    return Block(value("text"), value("before"), value("ends").to_numpy(zero_copy_only=False).astype(bool)), flags


def _send(parts: int):
    """A block's keys and counts, cut at the borders of `parts` equal ranges of keys."""
    borders = np.array([(k << 56) // parts for k in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, flags = _of_row(batch, i)
                cuts = [0, *np.searchsorted(block.keys, borders).tolist(), len(block.keys)]
                counts = block.counts(np.ones(len(flags), bool)), block.counts(flags)
                rows = []
                for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        rows.append((part, _planes(np.diff(block.keys[a:b], prepend=np.uint64(0))), *(_planes(c[a:b]) for c in counts)))
                if rows:
                    part, *blobs = zip(*rows, strict=True)
                    name = batch.column("block")[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.int64()), pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["block", "part", "keys", "n_all", "n_target"])
        free()

    return run


def _joined(blobs: list[bytes]) -> np.ndarray:
    """The numbers of all blobs, end to end."""
    ends = np.cumsum([0, *((len(x) - 1) // x[0] for x in blobs)])
    out = np.empty(int(ends[-1]), np.uint64)
    for x, a, b in zip(blobs, ends[:-1], ends[1:], strict=True):
        out[a:b] = _numbers(x)
    return out


def _sum_up(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[int, list[int]]:
    """Put the sum over all places of its key in each place of the counts; how many words there are and their totals. A slice of the keys' values at a time, as sorting takes many times what is sorted."""
    low, high, cuts = int(keys.min()), int(keys.max()) + 1, -(-len(keys) // SLICE_KEYS)
    borders, kinds, totals = [low + (high - low) * k // cuts for k in range(cuts + 1)], 0, [0] * len(counts)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        at = np.flatnonzero((keys >= np.uint64(a)) & (keys < np.uint64(b)))
        found, place = np.unique(keys[at], return_inverse=True)
        word = found & np.uint64(1) == 1
        kinds += int(word.sum())
        for k, n in enumerate(counts):
            sums = np.bincount(place, n[at], minlength=len(found)).astype(np.int64)
            totals[k] += int(sums[word].sum())
            n[at] = sums[place]
    return kinds, totals


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all blocks of one range's keys, for each block in its order; and, in a row of no block, how many words there are and their totals."""
    names, rows = ["block", "part", "n_all", "n_target", "kinds", "total_all", "total_target"], []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("part", "block", "keys", "n_all", "n_target")), strict=True)
        del batch
    rows.sort(key=lambda r: r[:2], reverse=True)
    while rows:
        part, own = rows[-1][0], []
        while rows and rows[-1][0] == part:
            own.append(rows.pop())
        _, name, keys, *counts = map(list, zip(*own, strict=True))
        del own
        ends = np.cumsum([(len(x) - 1) // x[0] for x in keys])
        counts = [_joined(counts.pop(0)) for _ in range(2)]
        whole = np.empty(int(ends[-1]), np.uint64)
        for i, b in enumerate(ends):
            whole[b - (len(keys[i]) - 1) // keys[i][0] : b] = np.cumsum(_numbers(keys[i]))
            keys[i] = None
        kinds, totals = _sum_up(whole, counts)
        del whole
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.int64()) for x in (kinds, *totals))], names=names)
        at = begin = 0
        while at < len(name):
            sent, size, first = ([], []), 0, at
            while at < len(name) and size < OUT_BYTES:
                for x, n in zip(sent, counts, strict=True):
                    x.append(_planes(n[begin : ends[at]]))
                    size += len(x[-1])
                begin, at = ends[at], at + 1
            yield pa.RecordBatch.from_arrays([pa.array(name[first:at], pa.int64()), pa.array([part] * (at - first), pa.int32()), *(pa.array(x, pa.binary()) for x in sent), *(pa.nulls(at - first, pa.int64()) for _ in range(3))], names=names)
    free()


def _losses(block: Block, counts: np.ndarray, total: int, kinds: int, strength: float) -> np.ndarray:
    """The loss of each predicted token."""
    single = (counts[block.word] + strength / max(kinds, 1)) / (total + strength)
    return -np.log((counts[block.pair] + strength * single) / (counts[block.context] + strength))


def _score(kinds: int, totals: tuple[int, int], strength: float):
    """Blocks, each followed by the sums of its keys by range, to the pieces' losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            block, rows, doc_ids, sums = held
            n_all, n_target = (np.concatenate([_numbers(x) for x in c]) if c else np.zeros(0) for c in zip(*sums, strict=True)) if sums else (np.zeros(0), np.zeros(0))
            loss = [np.bincount(block.owner, _losses(block, n.astype(np.float64), t, kinds, strength), minlength=len(block.sizes)) for n, t in ((n_target, totals[1]), (n_all, totals[0]))]
            return pa.RecordBatch.from_arrays([rows, doc_ids, pa.array(block.sizes, pa.int64()), pa.array(block.scored, pa.int64()), *map(pa.array, loss)], names=["row", "doc_id", "n_tokens", "n_scored", "target", "background"])

        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("part")[i].as_py() < 0:
                    if held:
                        yield result()
                    held = (_of_row(batch, i)[0], batch.column("row")[i].values, batch.column("doc_id")[i].values, [])
                else:
                    held[3].append((batch.column("n_all")[i].as_py(), batch.column("n_target")[i].as_py()))
        if held:
            yield result()
        free()

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, strength: float = STRENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score all documents against the target documents, given by the doc_id column of `targets`.

    doc_id, n_tokens (words), target_loss, background_loss (means over words and end) and score, their difference.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    small = chosen.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flagged = rows.join(F.broadcast(chosen) if small else chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    held = written(flagged.mapInArrow(_blocks(block_bytes), BLOCK), "lm-blocks", "zstd")
    words, parts = held.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    ranges, tasks = max(n, -(-words // RANGE_WORDS)), max(n, -(-parts // TASK_BLOCKS))
    sent = held.mapInArrow(_send(ranges), PART)
    sums = written(sent.repartitionById(ranges, F.col("part")).mapInArrow(_add, SUMS), "lm-sums", "zstd")
    kinds, *totals = sums.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "total_all", "total_target"))).first()
    whole = held.drop("words").withColumn("part", F.lit(-1)).unionByName(sums.where("block is not null").select("block", "part", "n_all", "n_target"), allowMissingColumns=True)
    pieces = whole.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(_score(kinds, tuple(totals), strength), PIECE)
    each = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_scored", "target", "background")))
    mean = lambda c: (F.col(c) / F.greatest("n_scored", F.lit(1))).alias(f"{c}_loss")
    return each.select("doc_id", "n_tokens", mean("target"), mean("background")).withColumn("score", F.col("target_loss") - F.col("background_loss"))
