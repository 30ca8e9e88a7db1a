"""Jaccard join of documents on word shingles with token-combination prefixes.

A document is the set of its distinct n-word shingles (64-bit hashes). Documents of one set are one class, and classes are
joined. Shingles have a global order: rare ones first, then frequent ones, each by hash. A class may miss at most
slack = size - ceil(threshold * size) of its shingles in any partner, so it indexes a prefix of that order that stays
covered when any `slack` shingles go: a rare shingle covers one by itself; frequent shingles are dealt into groups, cover
all but one of each group, and are indexed as pairs within a group. Linked classes therefore share an indexed key. The
number of groups depends on the size class, and a class is also indexed under all larger size classes where a partner can
be.

Frequency is told by a table of counters of fixed size over all documents: it decides only how shingles are indexed.

Candidates are tested by a bitmap (the difference of two sets is at least the number of differing parity bits) and then by
the whole sets. First each key's classes are held against the key's leader, which settles groups of copies in one link a
class; then all pairs of one key that are still in different components are tested. No links or sets reach the driver.

Defined cases: null and empty texts, and texts without words, have size 0 and link with nothing; with fewer than n words
the sequence is one shingle; repeated rows link (equal sets); a null doc_id links but is never the name of a component; an
empty table gives no rows; thresholds under a quarter are refused. Other columns are ignored.

Sets and shingles are named by 64-bit hashes: of n different sets two share a name with a probability of n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import blocks, free, may_be_member, members, mix, prefix_sums, span_hashes, utf8, written
from textloom.llm.components import connected

LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)
SKETCH_BITS, SKETCH_PARTS = 21, 32
SMALL = 64
STAR_ROUNDS = 2
MIN_BITS = 8


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, ordered by both."""
    count = len(offsets) - 1
    spaced = np.full(len(data) + count + 1, 32, np.uint8)  # a blank before, between and after texts
    spaced[np.arange(len(data)) + 1 + np.repeat(np.arange(count), np.diff(offsets))] = _LOWER[data]
    edge = np.flatnonzero(np.diff((spaced != 32).astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    words = span_hashes(prefix_sums(spaced), starts, ends)
    owner = np.searchsorted(offsets[1:] + np.arange(1, count + 1), starts, "left")
    sizes = np.bincount(owner, minlength=count)
    firsts = np.cumsum(sizes) - sizes

    def joined(at: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(at), width, np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
        return out

    at = np.arange(max(0, len(words) - n + 1))
    at = at[owner[at] == owner[at + n - 1]] if len(at) else at
    found, text = [joined(at, n)], [owner[at]]
    for width in range(1, n):
        short = np.flatnonzero(sizes == width)
        found.append(joined(firsts[short], width))
        text.append(short)
    found, text = np.concatenate(found), np.concatenate(text)
    order = np.argsort(found)
    narrow = text[order].astype(np.uint16 if count < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = order[np.argsort(narrow, kind="stable")]
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return text[new], found[new]


def digests(text: np.ndarray, found: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit name of each text's set."""
    a, b = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    if len(text):
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        a[text[head]] = np.add.reduceat(mix(found + np.uint64(1)), head)
        b[text[head]] = np.bitwise_xor.reduceat(mix(found ^ np.uint64(0x94D049BB133111EB)), head)
    return mix(a ^ mix(b + np.uint64(7)))


def bitmaps(text: np.ndarray, found: np.ndarray, count: int) -> pa.Array:
    """Parity of each text's shingles over as many bits as it has shingles, rounded up to a power of two, in 64-bit words. A bitmap of half the length is the exclusive or of its halves."""
    sizes = np.bincount(text, minlength=count)
    bits = 1 << np.maximum(MIN_BITS, np.ceil(np.log2(np.maximum(1, sizes))).astype(np.int64))
    ends = np.cumsum(bits)
    at = (ends - bits)[text] + (found & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(ends[-1]) if count else 0) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends // 64]), pa.int32()), pa.array(words))


_SURVEY = {"doc_id": pa.int64(), "row_key": pa.int64(), "n_shingles": pa.int64(), "node": pa.int64(), "bits": pa.list_(pa.int64()), "part": pa.int32(), "counts": pa.binary()}


def _survey(n: int):
    """A row for each document, then the task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in blocks(batches, "text", 1 << 20):
            count = batch.num_rows
            text, found = shingles(*utf8(batch.column("text")), n)
            names, sizes = digests(text, found, count), np.bincount(text, minlength=count)
            _, once = np.unique(names, return_index=True)  # copies in a block count once
            counted = np.zeros(count, bool)
            counted[once] = True
            at = (found[counted[text]] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            counters += np.bincount(at, minlength=1 << SKETCH_BITS).astype(np.uint32)
            bits = bitmaps(text, found, count)
            nulls = pa.nulls(count, pa.int32()), pa.nulls(count, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(names.view(np.int64), mask=sizes == 0), bits, *nulls], names=[*_SURVEY])
        parts = np.minimum(counters, 65535).astype("<u2").reshape(SKETCH_PARTS, -1)
        planes = [x.view(np.uint8).reshape(-1, 2).T.tobytes() for x in parts]  # low bytes, then high ones, which are mostly 0
        last = {"part": pa.array(np.arange(SKETCH_PARTS), pa.int32()), "counts": pa.array(planes, pa.binary())}
        yield pa.RecordBatch.from_arrays([last.get(k, pa.nulls(SKETCH_PARTS, t)) for k, t in _SURVEY.items()], names=[*_SURVEY])

    return run


def _sum_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            low, high = np.frombuffer(raw, np.uint8).reshape(2, -1).astype(np.uint32)
            sums[part] = low + (high << np.uint32(8)) + sums.get(part, np.zeros(len(low), np.uint32))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def frequent_table(survey: DataFrame) -> np.ndarray:
    """Packed bits: counters clearly above the mean, where frequent shingles fall. 2 ** SKETCH_BITS bits at any size."""
    parts = survey.where("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(_sum_counters, "part int, counts binary").collect()
    counters = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for part, raw in parts:
        counters[part] = np.frombuffer(raw, np.uint32)
    counters = counters.ravel()
    mean = float(counters.mean())
    return np.packbits(counters > mean + 6 * mean**0.5 + 24)


def size_class(n: int) -> int:
    return 0 if n < SMALL else (n // SMALL).bit_length()


def signatures(found: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is indexed, and the place in its order of each key's first shingle. found is sorted by hash."""
    n = len(found)
    slack = n - -(-num * n // den)
    keys, places = [], []
    for regime in range(size_class(n), size_class(n * den // num) + 1):
        salt = np.uint64((0xA24BAED4963EE407 * (regime + 1)) % (1 << 64))
        if regime == 0:
            keys.append(mix(found[: slack + 1] + salt))
            places.append(np.arange(slack + 1))
            continue
        rare, often = found[~frequent], found[frequent]
        single = rare[: slack + 1]
        keys.append(mix(single + salt))
        places.append(np.arange(len(single)))
        need = slack + 1 - len(single)
        if need <= 0:
            continue
        low = SMALL << (regime - 1)
        least = -(-num * low // den)  # the smallest set indexed here: its shingles must cover its prefix in so many groups
        groups = np.uint64(max(1, min(low - least, -(-num * least // den) - 1)))
        group = mix(often) % groups
        _, head = np.unique(group, return_index=True)
        covers = np.ones(len(often), np.int64)
        covers[head] = 0
        enough = int(np.searchsorted(np.cumsum(covers), need)) + 1
        if enough > len(often):
            raise AssertionError("a prefix cannot be covered")
        order = np.argsort(group[:enough], kind="stable")
        in_group = group[:enough][order]
        start = np.flatnonzero(np.append(True, in_group[1:] != in_group[:-1]))
        nth = np.arange(enough) - np.repeat(start, np.diff(np.append(start, enough)))
        second = np.repeat(np.arange(enough), nth)
        first = second - np.repeat(nth, nth) + (np.arange(len(second)) - np.repeat(np.cumsum(nth) - nth, nth))
        a, b = order[first], order[second]
        keys.append(mix(mix(often[a] + salt) * np.uint64(3) + often[b]))
        places.append(len(rare) + a)
    return np.concatenate(keys), np.concatenate(places)


PLACE_BITS = 8


def _index(shared, n: int, num: int, den: int):
    """(key, node): the low bits of a key are the place of its first shingle, as far as they hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).astype(bool)
        for batch in blocks(batches, "text", 1 << 20):
            text, found = shingles(*utf8(batch.column("text")), n)
            names = digests(text, found, batch.num_rows)
            frequent = often[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
            seen, out, sizes = set(), [], []
            for i, b in enumerate(ends.tolist()):
                a = int(ends[i - 1]) if i else 0
                if a == b or names[i] in seen:
                    continue
                seen.add(names[i])
                keys, places = signatures(found[a:b], frequent[a:b], num, den)
                low = np.uint64((1 << PLACE_BITS) - 1)
                out.append((keys & ~low) | np.minimum(places, int(low)).astype(np.uint64))
                sizes.append((names[i], len(keys)))
            if out:
                keys, nodes = np.concatenate(out), np.repeat(*(np.array(x) for x in zip(*sizes, strict=True)))
                for i in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(nodes[i : i + 50_000].view(np.int64))], names=["key", "node"])

    return run


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, leader) of the keys that more than one class has. A key's leader has the fewest rarer shingles."""
    parts = [(b.column("key").to_numpy(), b.column("node").to_numpy()) for b in batches]
    if not parts:
        return
    key, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, place = key >> PLACE_BITS, (key & ((1 << PLACE_BITS) - 1)).astype(np.uint8)
    parts.clear()
    order = np.argsort(key)
    key = key[order]
    alone = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True)
    key, order = key[~alone], order[~alone]
    node, place = node[order], place[order]
    order = np.lexsort((place, node, key))
    key, node, place = key[order], node[order], place[order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    key, node, place = key[new], node[new], place[new]
    order = np.lexsort((node, place, key))
    key, node = key[order], node[order]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    group = np.cumsum(head) - 1
    leader, several = node[head][group], (np.bincount(group) > 1)[group] if len(key) else head
    key, node, leader = key[several], node[several], leader[several]
    for i in range(0, len(key), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (key, node, leader)], names=["key", "node", "leader"])
    free()


def _sets(shared, n: int):
    """The sets of classes whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            text, found = shingles(*utf8(batch.column("text")), n)
            names = digests(text, found, batch.num_rows)
            good = may_be_member(names, shared.value)
            _, once = np.unique(names, return_index=True)
            first = np.zeros(len(names), bool)
            first[once] = True
            ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
            chosen = [i for i in np.flatnonzero(good & first).tolist() if ends[i] > (ends[i - 1] if i else 0)]
            signed = found.view(np.int64)
            for k in range(0, len(chosen), 200):
                part = chosen[k : k + 200]
                yield pa.RecordBatch.from_arrays([pa.array(names[part].view(np.int64)), pa.array([signed[(ends[i - 1] if i else 0) : ends[i]] for i in part], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


class Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, row: str | None):
        if not 0 < den <= 4 * num <= 4 * den:
            raise ValueError("the threshold must be a quarter at least, and 1 at most")
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        key = (F.col(row) if row else F.lit(None)).cast("long")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        ddl = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
        self.survey = written(self.docs.mapInArrow(_survey(n), ", ".join(f"{k} {ddl[t]}" for k, t in _SURVEY.items())), "jaccard-survey")
        self.rows = self.survey.where("part is null")

    def classes(self) -> DataFrame:
        """One row for each set: node, n and its bitmap."""
        return self.rows.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))

    def index(self) -> DataFrame:
        """(key, node, leader) of keys that more than one class has; all others end in the task that gets them."""
        shared = self.spark.sparkContext.broadcast(frequent_table(self.survey))
        rows = self.docs.select("text").mapInArrow(_index(shared, self.n, self.num, self.den), "key long, node long")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = written(rows.repartition(parts, F.shiftright("key", PLACE_BITS)).mapInArrow(_lead, "key long, node long, leader long"), "jaccard-keys")
        shared.destroy()
        return out

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * self.den) >= (F.greatest(a, b) * self.num)

    def may_link(self, a: str, b: str) -> Column:
        """False only for pairs whose sets differ too much: differing parity bits are a lower bound of the difference."""
        half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, 1 + size({x}) div 2, size({x}) div 2), (u, v) -> u ^ v)"
        as_long_as = lambda x, y: f"CASE WHEN size({x}) > size({y}) THEN {half(x)} ELSE {x} END"
        x, y = f"{a}.bits", f"{b}.bits"
        differ = F.expr(f"aggregate(zip_with({as_long_as(x, y)}, {as_long_as(y, x)}, (u, v) -> bit_count(u ^ v)), 0, (total, k) -> total + k)")
        return self.sizes_fit(F.col(f"{a}.n"), F.col(f"{b}.n")) & (differ * (self.den + self.num) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (self.den - self.num))

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """The sets of the classes in (a, b). The documents are read again; a bitmap tells which sets to send. A set that it lets by in error joins with nothing."""
        nodes = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-nodes")
        shared = self.spark.sparkContext.broadcast(members(nodes.select(F.col("node").alias("hash"))))
        sets = self.docs.mapInArrow(_sets(shared, self.n), "node long, shingles array<long>")
        out = written(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "jaccard-sets")
        shared.destroy()
        return out

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        same = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("same"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
        return written(same.where(F.col("same") * self.den >= (F.col("sizes") - F.col("same")) * self.num).select("a", "b"), "jaccard-links")

    def components(self) -> DataFrame:
        """(node, label) of all classes that link with another."""
        keys = self.index()
        classes = written(self.classes(), "jaccard-classes")
        led = keys.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("shared"))
        led = led.alias("p").join(classes.alias("s"), F.col("p.a") == F.col("s.node")).join(classes.alias("t"), F.col("p.b") == F.col("t.node")).where(self.may_link("s", "t"))
        led = written(led.select("a", "b", "shared"), "jaccard-led")
        sets = self.sets_of(led)
        # each round holds every class against one leader, of those it shares most keys with, that it is not yet joined to
        links = labels = None
        left = led
        for _ in range(STAR_ROUNDS):
            tried = left.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
            found = self.linked(tried, sets)
            links = found if links is None else links.unionByName(found)
            labels = connected(links)
            left = self.apart(left.join(tried, ["a", "b"], "left_anti"), labels)
        # what leaders have not settled: pairs with a leader, and any two classes of one key, in different components; a key of two classes has no pair but that with its leader
        rows = keys.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        open_keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high AND size > 2").select("key")
        rows = written(rows.join(open_keys, "key", "left_semi").join(classes, "node"), "jaccard-open")
        s, t = rows.alias("s"), rows.alias("t")
        crossing = s.join(t, (F.col("s.key") == F.col("t.key")) & (F.col("s.node") < F.col("t.node")) & (F.col("s.label") != F.col("t.label")) & self.may_link("s", "t"))
        crossing = crossing.select(F.col("s.node").alias("a"), F.col("t.node").alias("b"))
        rest = written(crossing.unionByName(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "jaccard-crossing")
        if rest.isEmpty():
            return labels
        known = sets.select("node")
        new = rest.join(known.withColumnRenamed("node", "a"), "a", "left_anti").select("a", F.col("a").alias("b")).unionByName(rest.join(known.withColumnRenamed("node", "b"), "b", "left_anti").select(F.col("b").alias("a"), "b"))
        if not new.isEmpty():
            sets = sets.unionByName(self.sets_of(new))
        return connected(links.unionByName(self.linked(rest, sets)))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose classes are in different components."""
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return written(both.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select(*pairs.columns), "jaccard-left")


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, row: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach), row_key, class_id (equal for equal sets) and component_key (the least class_id); both are null without words.

    `row` names a column of long numbers that is returned as row_key, for a caller that must tell rows of one doc_id apart.
    Documents link when den * intersection >= num * union of their sets of distinct n-word shingles.
    """
    join = Join(docs, n, num, den, row)
    labels = join.components()
    rows = join.rows.select("doc_id", "row_key", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "row_key", F.col("node").alias("class_id"), F.col("label").alias("component_key"))
