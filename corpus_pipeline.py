"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

quality: documents that the classifier scores under 0.3 go.
jaccard: of documents linked by five-word shingles (similarity 0.8 or more) the one of the least doc_id stays.
suffixes: every byte inside a string of MIN_REPEAT bytes that stands anywhere else goes, its first copy too: whole documents
that repeat went in the stage before, so what still repeats is boilerplate, which says nothing of the text around it. Cuts
keep whole characters.
benchmark: documents in which a twentieth of the words or more are in benchmark windows go; other hits are cut out.
tokens: byte-level BPE ids of what is left, and whether they decode to the text.

In every stage: null and empty texts pass the filters; rows that repeat a doc_id and text are near duplicates of each
other, and one stays (all, where there is no word); an empty table gives none; further columns, whatever their names, come
through unchanged, but in the last stage, which returns its own. Null and repeated doc_ids are ids like others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontamination, jaccard_join, quality, suffix_dedup
from textloom.llm.common import fresh, new_path, numbered, scratch, table

MIN_QUALITY = 0.3
MIN_REPEAT = 200
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def _unpacked(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of the documents, with a new text and its length if one is given."""
    form = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if text is not None:
        form |= {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return df.select(*(form.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score MIN_QUALITY or more, an empty text among them if the share of good labels does."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return _unpacked(quality.score(_packed(docs), model).where(F.col("score") >= MIN_QUALITY), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row of the least doc_id stays (a null one only if there is no other); rows without words all stay."""
    row = fresh(docs.columns, "row")
    docs = numbered(docs, row, "jaccard-rows")
    groups = jaccard_join.jaccard_join(docs, n=5, num=80, den=100, row=row)
    least = groups.where("component_key IS NOT NULL").groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    kept = least.select(F.col("first.row_key").alias(row)).unionByName(groups.where("component_key IS NULL").select(F.col("row_key").alias(row)))
    return docs.join(kept, row, "left_semi").drop(row)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that stand in a repeat of MIN_REPEAT bytes; n_chars follows the text."""
    out = suffix_dedup.dedup(_packed(docs), MIN_REPEAT, whole_characters=True)
    return _unpacked(out, docs, F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the words that stand in a window of the benchmark."""
    out = decontamination.cleaned(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(out.where(~F.col("contaminated")), docs, F.col("clean"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits each) and the SHA-256 of what they decode to."""
    decoded = bpe.decode(bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("suffixes", suffix_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier, byte-level spans and merges have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None
