"""Shared inputs of the queries: tables, and the same derived tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chain, sentences
from textloom.operators import mentions

TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is scanned; text tables, on which regular expressions run, are dealt if `textloom.text.partitions` is set (see README)."""
    df, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get("textloom.text.partitions", None)
    return df.repartition(int(n)) if n and name in TEXTS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def found_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(documents(spark, sf_dir))


def found_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, start, end, surface_form, entity_type, wiki_id: capitalised tokens, typed by length."""
    out = mentions.capitalised(found_sentences(spark, sf_dir), "doc_id", "pos")
    types = F.array(*map(F.lit, mentions.ENTITY_TYPES))
    return out.withColumn("entity_type", F.element_at(types, (F.length("surface_form") % 16 + 1).cast("int"))).withColumn("wiki_id", F.when(F.length("surface_form") > 3, F.regexp_replace(F.lower("surface_form"), "[^a-z]", "")).otherwise(""))


SENTENCES = sentences.SQL
TYPES = "[" + ", ".join(chain.literal(t) for t in mentions.ENTITY_TYPES) + "]"
MENTIONS = f"""{SENTENCES},
toks AS (SELECT doc_id, pos, unnest(string_split(sentence, ' ')) AS tok, generate_subscripts(string_split(sentence, ' '), 1) AS i FROM sents),
offs AS (SELECT *, (sum(length(tok) + 1) OVER (PARTITION BY doc_id, pos ORDER BY i) - length(tok) - 1)::BIGINT AS start FROM toks),
ments AS (SELECT doc_id, pos, start, start + length(tok) AS "end", tok AS surface_form, {TYPES}[(length(tok) % 16 + 1)::INT] AS entity_type,
  CASE WHEN length(tok) > 3 THEN regexp_replace(lower(tok), '[^a-z]', '', 'g') ELSE '' END AS wiki_id FROM offs WHERE regexp_matches(tok, '^[A-Z]'))"""
