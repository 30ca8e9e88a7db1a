"""The pipeline's stages on planted cases; each is judged on its own input."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = after.join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.97 * before.join(labels, "doc_id").where("quality = 1").count()
    assert 0 < after.count() < before.count()
    model = quality.fit(before, labels.where(~quality.held_out()))
    rows = before.collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, model.score([r.text for r in rows]), strict=True) if s >= corpus_pipeline.MIN_QUALITY}


def test_jaccard(stages):
    before, after = stages["jaccard"]
    shingles = {}
    for r in before.collect():
        w = r.text.encode().lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    kept = sorted(r.doc_id for r in after.collect())
    assert not [(i, j) for i in kept for j in kept if i < j and alike(shingles[i], shingles[j])]
    assert all(any(alike(shingles[d], s) for o, s in shingles.items() if o != d) for d in shingles if d not in kept)


def test_suffixes(stages):
    before, after = stages["suffixes"]
    a, b = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
    assert a.keys() == b.keys()
    n, seen = corpus_pipeline.MIN_REPEAT, {}
    for d, t in a.items():
        raw = t.encode()
        for i in range(len(raw) - n + 1):
            seen.setdefault(raw[i : i + n], set()).add((d, i))
    hit = {d for at in seen.values() if len(at) > 1 for d, _ in at}
    assert {d for d in a if a[d] != b[d]} == hit


    n_bytes = {d: sum(len(t.encode()) for t in x.values()) for d, x in (("a", a), ("b", b))}
    for d in hit:
        raw, gone = a[d].encode(), set()
        for i in range(len(raw) - n + 1):
            if len(seen[raw[i : i + n]]) > 1:
                gone.update(range(i, i + n))
        kept = "".join(c for c, at in zip(a[d], byte_places(a[d]), strict=True) if not gone & set(at))
        assert b[d] == kept
    assert n_bytes["b"] < n_bytes["a"] and all(r.n_chars == len(r.text) for r in after.collect() if r.doc_id in hit)


def byte_places(text):
    at, out = 0, []
    for c in text:
        out.append(range(at, at := at + len(c.encode())))
    return out


def test_benchmark(spark, stages):
    """Against a search for every 13-word window in every text."""
    before, after = stages["benchmark"]
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(norm(r.text or ""))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(len(w[i : i + 13]), set()).add(tuple(w[i : i + 13]))
    want = {}
    for r in before.collect():
        found = list(word.finditer(norm(r.text)))
        w, hit = [m.group() for m in found], set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        at, parts = 0, []
        for i in sorted(hit):
            if i - 1 not in hit:
                parts.append(r.text[at : found[i].start()])
            at = found[i].end()
        want[r.doc_id] = "".join([*parts, r.text[at:]])
    assert {r.doc_id: r.text for r in after.collect()} == want and len(want) < before.count()


def test_tokens(stages):
    import hashlib

    before, after = stages["tokens"]
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
    assert {r.doc_id: r.text_sha256 for r in after.collect()} == want


def test_edges(spark):
    """Nulls, empty texts, repeated rows and empty tables pass every stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "fr", "s", None), (2, "", "fr", "s", 0), (None, "une petite phrase", "fr", "s", 17), (3, "x y z " * 200, "fr", None, 1200), (3, "x y z " * 200, "fr", None, 1200), (4, "é" * 500, None, "s", 500)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() <= n
            n = docs.count()


def test_rows_are_told_apart(spark):
    """Neither a null nor a column's name makes two rows one."""
    rows = [(5, None, "a"), (None, "5", "b"), (7, "", "c"), (7, "", "d"), (8, "one two three four five six", "e"), (None, "one two three four five six", "f")]
    docs = spark.createDataFrame([(d, t, "fr", "s", None, x, 1, 2.0, 3, "z") for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, row int, score double, kept int, `a.b` string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        kept[name] = {r._row for r in after.collect()}
        assert after.where("row = 1 AND score = 2.0 AND kept = 3 AND `a.b` = 'z'").count() == len(kept[name])
    assert kept == {"quality": kept["quality"], "jaccard": set("abcde"), "suffixes": set("abcdef"), "benchmark": set("abcdef")}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.where(F.length("ids") != 4 * F.col("n_tokens")).count() == 0
