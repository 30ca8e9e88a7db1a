"""Entity mentions: a provider's annotations, normalised, filtered, merged and shaped."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ENTITY_TYPES = ("", "association", "commune", "date", "departement", "epci", "institution", "lieu", "ong", "organisation", "partipolitique", "pays", "personne", "region", "societe", "syndicat")
PUNCTUATION = r"[.,;:?!()\[\]{}«»'\"—/’&|\\-]"
NOT_IN_NAMES = (";", ",", '"', ":", "--", "...", ".", "+", "!", "?", "/")
MIN_SCORE = 0.6
ANNOTATIONS = "struct<annotations: array<struct<start: int, end: int, entiteForme: string, wikiId: string, scoreWiki: double, entiteType: string>>>"


CAPITALISED = "[A-Z](?<![^ ][A-Z])[^ ]*"  # fixed value: a token that starts with a capital, for Java


def capitalised(sentences: DataFrame, *keys: str) -> DataFrame:
    """A provider for tests and fixtures: blank-separated tokens that start with a capital; (keys, start, end, surface_form). One fold over those found and what stands before each keeps the offset, so nothing is shuffled."""
    rows = sentences.where(F.col("sentence").rlike(CAPITALISED)).select(*keys, F.regexp_extract_all("sentence", F.lit(CAPITALISED), F.lit(0)).alias("_found"), F.split("sentence", CAPITALISED, -1).alias("_before"))
    found = F.expr("""aggregate(zip_with(_found, slice(_before, 1, size(_found)), (t, b) -> struct(t, length(b) AS before, length(t) AS n)),
        named_struct('at', 0L, 'found', cast(array() AS array<struct<start: bigint, `end`: bigint, surface_form: string>>)),
        (s, x) -> named_struct('at', s.at + x.before + x.n, 'found', concat(s.found, array(named_struct('start', s.at + x.before, 'end', s.at + x.before + x.n, 'surface_form', x.t)))),
        s -> s.found)""")
    return rows.select(*keys, F.explode(found).alias("m")).select(*keys, "m.start", "m.end", "m.surface_form")


def from_reply(replies: DataFrame, reply: str, *keys: str) -> DataFrame:
    """Mentions of a provider's JSON reply; a knowledge-base id of low score is empty."""
    a = F.explode(F.from_json(reply, ANNOTATIONS)["annotations"]).alias("a")
    return replies.select(*keys, a).select(
        *keys, F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.entiteForme").alias("surface_form"),
        F.when(F.col("a.scoreWiki") > MIN_SCORE, F.coalesce("a.wikiId", F.lit(""))).otherwise("").alias("wiki_id"), F.coalesce("a.entiteType", F.lit("")).alias("entity_type"),
    )


def provided(sentences: DataFrame, find: Callable[[str], Iterable[tuple]], *keys: str) -> DataFrame:
    """Mentions from a Python extractor, as a table function over each sentence: find(text) gives (start, end, surface_form, wiki_id, entity_type). For extractors that no expression can state; null sentences have none."""

    class Mentions:
        def eval(self, text: str):
            if text is not None:
                yield from find(text)

    table = F.udtf(Mentions, returnType="start bigint, end bigint, surface_form string, wiki_id string, entity_type string")
    found = sentences.lateralJoin(table(F.col("sentence").outer()))
    return found.select(*keys, "start", "end", "surface_form", "wiki_id", "entity_type")


def normalised(surface: Column, end: Column) -> tuple[Column, Column]:
    """Surface and end without a closing sign; acronyms and decimals keep theirs."""
    closing = surface.rlike(PUNCTUATION + "$") & ~surface.rlike(r"([A-Z]\.)([A-Z]\.)+") & ~surface.rlike(r"([0-9]+\.)[0-9]+")
    cut = F.regexp_replace(F.substring(surface, F.lit(1), F.length(surface) - 1), r"\.+$", "")
    return F.when(closing, cut).otherwise(surface), F.when(closing, end - 1).otherwise(end)


def tokens(surface: Column) -> Column:
    return F.split(surface, r"['\- /.]")


def real_name(surface: Column) -> Column:
    """Longer than a character, and no forbidden sign followed by a blank."""
    bad = F.lit(False)
    for sign in NOT_IN_NAMES:
        bad = bad | surface.contains(sign + " ")
    return (F.length(surface) > 1) & ~bad


def merged(mentions: DataFrame, text: str, *keys: str) -> DataFrame:
    """Merge a mention with the next one where an apostrophe or hyphen has split them; the one merged is used up. The second's label is kept. One fold over a sentence's mentions in order."""
    packed = mentions.groupBy(*keys).agg(F.first(text).alias(text), F.array_sort(F.collect_list(F.struct("start", "end", "entity_type"))).alias("m"))
    expr = f"""
      aggregate(m, cast(array() AS array<struct<start: bigint, `end`: bigint, entity_type: string, open: boolean>>), (done, x) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).open
                  AND (substring({text}, cast(element_at(done, -1).`end` AS int), 1) = "'" OR substring({text}, cast(x.start AS int), 1) IN ("'", '-'))
             THEN concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start AS start, cast(x.`end` AS bigint) AS `end`, x.entity_type AS entity_type, false AS open)))
             ELSE concat(done, array(struct(cast(x.start AS bigint) AS start, cast(x.`end` AS bigint) AS `end`, x.entity_type AS entity_type, true AS open))) END)"""
    out = packed.select(*keys, text, F.explode(F.expr(expr)).alias("m"))
    return out.select(*keys, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.expr(f"substring({text}, cast(m.start AS int) + 1, cast(m.`end` - m.start AS int))").alias("surface_form"), F.col("m.entity_type").alias("entity_type"))


def shaped(mentions: DataFrame, *keys: str) -> DataFrame:
    """One row a sentence: the surface forms in order, and the printed form."""
    line = F.format_string("%s---%s --- %d \\ %d", "surface_form", F.array_join(tokens(F.col("surface_form")), "/"), "start", "end")
    rows = mentions.withColumn("_line", line)
    order = F.array_sort(F.collect_list(F.struct("start", "end", "surface_form", "_line")))
    return rows.groupBy(*keys).agg(order.alias("o")).select(*keys, F.array_join("o.surface_form", "__").alias("forms"), F.array_join("o._line", "\n").alias("printed"), F.size("o").cast("long").alias("n"))
