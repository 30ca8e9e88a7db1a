"""The queries of this subpackage: thin digests over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, chroma, decontamination, jaccard_join, lm_scoring, quality, suffix_dedup, token_files, warc
from textloom.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chat.PLANTED)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.formatted(rows))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


PASSAGE = 200  # bytes: 51 words of three letters and their blanks are longer


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_repeated: bytes inside repeats of PASSAGE bytes, which are told but not removed."""
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


RENDERED = chroma.Settings(rate=4000, frame=512, step=128, low=200.0, high=1900.0, min_overlap=32)  # four frames a word: turns of six words or more have integers


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each turn of `conversations` is played as a melody (chroma.spoken, a chord for each word, as long as a frame) and is one recording."""
    media = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("media"), (F.col("conv_id") % 50 == 0).alias("is_query"))
    return chroma.search(media, ["conv_id", "turn"], chroma.spoken, RENDERED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_warc, op3_chat, op4_quality, op5_suffix_dedup, op6_decontamination, op7_token_files, op8_lm_scoring, op9_byte_bpe, op10_chroma)}


def oracle_sql() -> dict[str, str]:
    return {}
