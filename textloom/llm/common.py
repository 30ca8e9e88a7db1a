"""Shared parts of the operators: shared folder, Arrow text access, vectorised hashing.

Sizes of the blocks that a task holds at once are bounded by bytes, not by rows, so one very long text or a batch
of long texts costs the same memory as any other.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all is one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="textloom-")
        named = "file://" + shared_dir.own
    return named.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/textloom/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what new_path() named inside. For callers that have written their result: DataFrames returned from inside may still read it."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            drop_path(spark, _made.pop())


def written(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """`name`, or with underscores before it until no column has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str, what: str) -> DataFrame:
    """The rows, each with a number of its own in column `name`: written, so that it stays the row's when tasks run again."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), what, "zstd")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by new_path() by the session's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


MEMBER_BITS = 27


def members(hashes: DataFrame) -> tuple[int, bytes]:
    """A bitmap of the values of `hash`, 16 bits a row but 2 ** MEMBER_BITS at most (16 MB): it lets all members by, and others in error, all of them where it is full."""
    bits = min(MEMBER_BITS, max(15, (16 * hashes.count()).bit_length()))
    at = hashes.select((F.shiftrightunsigned("hash", 64 - bits) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(((1 << bits) // 32768, 4096), np.uint8)
    for part, raw in parts:
        out[part - 1] = np.frombuffer(raw, np.uint8)
    return bits, out.tobytes()


def may_be_member(hashes: np.ndarray, found: tuple[int, bytes]) -> np.ndarray:
    bits, raw = found
    at = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (np.frombuffer(raw, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def chosen(df: DataFrame, key: Column | str, found, inside: bool = True) -> DataFrame:
    """The rows whose `key` may be one of a broadcast bitmap's members (see members()), or those whose key is none."""
    columns, name = df.columns, fresh(df.columns, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = may_be_member(batch.column(name).to_numpy(zero_copy_only=False), found.value)
            yield batch.select(columns).filter(pa.array(mask == inside))

    return df.withColumn(name, F.xxhash64(key)).mapInArrow(run, df.schema)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of `column`, or one row. Frees the worker's spare memory at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    free()


def free() -> None:
    """Give memory that Python workers no longer use back to the machine: idle workers stay, and their memory is an executor's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and where each begins (n + 1 offsets). Null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK_BYTES + 4096)
        for k, base in (("up", int(_MULT)), ("down", pow(int(_MULT), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the hash of any span is a difference of two of them."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte span [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty."""
    return column.fill_null("").to_pylist()
