"""Page dumps: bzip2 XML read in parallel splits, to one row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import wikitext

SCHEMA = "title string, ns int, id string, revision struct<id: string, text: struct<_VALUE: string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of every <page>; Spark decompresses .bz2 and splits it by blocks."""
    pages = spark.read.format("xml").option("rowTag", "page").option("attributePrefix", "_").option("valueTag", "_VALUE").schema(SCHEMA).load(path)
    return pages.select("id", "title", F.col("revision.text._VALUE").alias("text"))


def accepted(pages: DataFrame) -> DataFrame:
    """Without rejected titles, redirects, disambiguations and one-line pages. The rules use raw columns, so they run before any cleaning."""
    lines = F.split(F.trim("text"), "\n")
    return pages.where(~wikitext.rejected(F.col("title"))).where(~wikitext.rejected_text(F.get(lines, F.lit(0)), F.size(lines)))


def without_last_line(text: Column) -> Column:
    """The text as a reader that drops the line of the closing tag gives it."""
    return F.regexp_replace(text, r"\n[^\n]*$", "")


def articles(pages: DataFrame, prefix: str, language: str, keep_last_line: bool = True) -> DataFrame:
    """url, id, title, text (clean), language, cats and annotations."""
    raw = F.col("text") if keep_last_line else without_last_line(F.col("text"))
    body = pages.select("id", wikitext.run(F.col("title"), wikitext.TITLE).alias("title"), raw.alias("_raw")).withColumn("cats", wikitext.categories(F.col("_raw"))).withColumn("_body", wikitext.run(F.col("_raw"), wikitext.BODY))
    out = body.withColumn("annotations", wikitext.annotations(F.col("_body"))).withColumn("text", wikitext.run(wikitext.run(F.col("_body"), wikitext.LABELS), wikitext.DEEP))
    return out.select(wikitext.url(F.col("title"), prefix).alias("url"), "id", "title", "text", F.lit(language).alias("language"), "cats", "annotations")


def link_edges(found: DataFrame, prefix: str) -> DataFrame:
    """(url_source, source, target, target_surface_form), a row for each link."""
    return found.select(F.col("url").alias("url_source"), F.col("title").alias("source"), F.explode("annotations").alias("a")).select("url_source", "source", wikitext.url(F.col("a.uri"), prefix, quote=True).alias("target"), F.col("a.surface_form").alias("target_surface_form"))
