"""A supervised classifier of documents over hashed subword embeddings.

A document's features are its words, the character n-grams of each word (with marks at its ends) and its pairs of
neighbouring words, hashed into one table of learned vectors. The document's vector is their average, in which a feature
that occurs c times weighs sqrt(c) (so a text that says the same again and again has a shorter vector than one that
does not); it goes through a softmax over two classes. Vectors and output weights are trained by stochastic gradient
descent in numpy, in one task, on a bounded sample of labelled documents. As the output is linear in the average, scoring
needs one number for each feature.

Defined cases: a null or empty text has no features and scores as the bias alone; labels that are neither 0 nor 1, and
labels without a document, are not used; with no usable label, or only one class, every score is that class' share (0.5
without any); repeated documents each give a row, and train once; in a text of over PIECE characters the pairs of words
across its cuts into pieces are not counted; other columns are kept, but for one named like the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, mix, prefix_sums, span_hashes, strings

BUCKET_BITS, DIM, NGRAMS = 20, 8, (3, 4)
SAMPLE, SAMPLE_BYTES = 4000, 8 << 20
EPOCHS, STEPS, RATE, SEED = 8, 16_000, 0.5, 11
PIECE = 1 << 19


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature of texts in lower case, in no order."""
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    gap = (points <= 32) | (points == 0xA0) | (points == 0x3000)
    points = np.where(gap, np.uint32(32), points)
    sums = prefix_sums(points)
    edge = np.flatnonzero(np.diff(gap.astype(np.int8)))
    starts, stops = edge[::2] + 1, edge[1::2] + 1
    words = span_hashes(sums, starts, stops)
    text_of = np.searchsorted(ends, starts, "right")
    follows = np.flatnonzero(text_of[1:] == text_of[:-1]) + 1
    pairs = mix(words[follows - 1] * np.uint64(0x5851F42D4C957F2D) + words[follows])
    at, found = [starts, starts[follows]], [words, pairs]
    inner = ~gap
    for n in NGRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        good = inner[1 : 1 + m].copy()
        for k in range(2, n - 1):
            good &= inner[k : k + m]
        i = np.flatnonzero(good)
        at.append(i)
        found.append(span_hashes(sums, i, i + n))
    return np.searchsorted(ends, np.concatenate(at), "right"), (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most PIECE characters, cut at blanks where there are any."""
    while len(text) > PIECE:
        cut = text.rfind(" ", 1, PIECE) if " " in text[1:PIECE] else PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each text, how often each occurs, and where each text's begin (n + 1 offsets)."""
    texts = [t.lower() for t in texts]
    kinds, counts, sizes = [], [], []
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            dense = np.zeros(1 << BUCKET_BITS, np.int64)
            for piece in _pieces(texts[i]):
                dense += np.bincount(_buckets([piece])[1], minlength=1 << BUCKET_BITS)
            kinds.append(np.flatnonzero(dense))
            counts.append(dense[kinds[-1]])
            sizes.append([len(kinds[-1])])
            i += 1
            continue
        stop, held = i, 0
        while stop < len(texts) and len(texts[stop]) <= PIECE and (held == 0 or held + len(texts[stop]) <= PIECE):
            held += len(texts[stop])
            stop += 1
        owner, bucket = _buckets(texts[i:stop])
        key = np.sort((owner << BUCKET_BITS) | bucket)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        kinds.append(key[head] & ((1 << BUCKET_BITS) - 1))
        counts.append(np.diff(np.append(head, len(key))))
        sizes.append(np.bincount(key[head] >> BUCKET_BITS, minlength=stop - i))
        i = stop
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(kinds).astype(np.int32), np.concatenate(counts).astype(np.int32), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Model:
    """weights: for each feature its logit; score is the sigmoid of their average and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[str]) -> np.ndarray:
        kinds, counts, offsets = features(texts)
        logit = _per_text(self.weights[kinds] * np.sqrt(counts), offsets) / np.maximum(_per_text(counts, offsets), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Model:
    """`epochs` rounds over the sample, more if that is fewer than `steps` documents."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(1 << BUCKET_BITS), np.log(share / (1 - share)))
    docs = []
    for i in range(0, len(texts), 64):
        kinds, counts, offsets = features(texts[i : i + 64])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            docs.append((kinds[a:b], (np.sqrt(counts[a:b]) / max(1, counts[a:b].sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-steps // len(docs)))
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            kinds, share = docs[k][0], docs[k][1][:, None]
            now = rate * (1 - step / steps)
            step += 1
            hidden = (vectors[kinds] * share).sum(0) if len(kinds) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            slope = p / p.sum()
            slope[y[k]] -= 1
            if len(kinds):
                # each feature's step is that of the document, not a share of it, as the average has hundreds of features
                vectors[kinds] -= now * np.sqrt(share) * (slope @ out)
            out -= now * np.outer(slope, hidden)
            bias -= 0.1 * now * slope
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


def sample_of(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int) -> DataFrame:
    """(doc_id, label, text) of at most `sample` labelled documents and `sample_bytes` bytes of text: those whose hashed id is least.

    Ids are chosen from the labels, then texts by their sizes, so no more text than that reaches one task. Of a repeated
    doc_id the text of least hash counts; texts of over an eighth of `sample_bytes` are not trained on.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(*order).limit(sample)
    rows = docs.select(F.col("doc_id").cast(dict(labels.dtypes)["doc_id"]).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sized = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))).alias("least"))
    so_far = F.sum("least.size").over(Window.orderBy(*order))  # over `sample` rows at most
    fits = sized.where(F.col("least.size") <= sample_bytes // 8).withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("doc_id", "label", F.col("least.hash").alias("hash"))
    return rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(fits), ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample (see sample_of) in one task; its weights alone, 2 ** BUCKET_BITS numbers, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            ys += batch.column("label").to_pylist()
        model = train(texts, ys)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    rows = sample_of(docs, labels, label, sample, sample_bytes).repartition(1).sortWithinPartitions("doc_id")
    found = rows.select("text", "label").mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"]) if found else train([], [])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns and the score of each whole text. The model's table is broadcast: 2 ** BUCKET_BITS numbers at any size."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in blocks(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.score(strings(batch.column("text"))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows never trained on: crc32 of the id as text leaves remainder 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))
