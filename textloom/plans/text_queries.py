"""Queries over pages and texts. Each entry: name, Spark form, DuckDB form (None where SQL has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chain, sentences, wikitext
from textloom.operators import graph, mentions, sampling, words
from textloom.plans.base import MENTIONS, SENTENCES, documents, found_mentions, found_sentences, table

PREFIX = "http://example.org/wiki/"
# wikitext around whole document texts: what stands before and after the text
WIKI = (
    "{{Infobox Ville\n| nom = [[Page]]\n}}\n'''Titre''' {{s-|XX}} {{unité|5|km}} {{lang|en|foo}} {{Album}} {{date|1|mai|1900}} {{s2-|XX|e|XXI}} {{gras|mot}} {{seul}}\n# [[Un]] suite\n[[Fichier:a.jpg|thumb|[[Lien]] texte]] [[Page|label]] <ref>note</ref><b>gras</b><br /> &lt;i&gt;x&lt;/i&gt; <!-- caché -->\n{| class=x\n| a\n|}\n\\frac{a} * [http://a b] y\n",
    "\n== Histoire ==\nfin\n== Voir aussi ==\nreste",
)


def _chain(steps: list[chain.Step], source: str = "wiki", key: str = "doc_id"):
    """A query that runs a chain over a column, or over wikitext made of whole document texts; Spark form and SQL."""
    name = "pages" if key == "page_id" else "documents"

    def query(spark: SparkSession, d: str) -> DataFrame:
        column = F.concat(F.lit(WIKI[0]), "text", F.lit(WIKI[1])) if source == "wiki" else F.col(source)
        return table(spark, d, name).select(key, chain.run(column, steps).alias("cleaned"))

    raw = f"{chain.literal(WIKI[0])} || text || {chain.literal(WIKI[1])}" if source == "wiki" else source
    return query, f"SELECT {key}, {chain.sql(raw, steps)} AS cleaned FROM {name}"


TITLE = r"(?is)<title>(.*?)</title>"


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", TITLE, 1)
    return table(spark, d, "pages").select("page_id", title.alias("title"), wikitext.url(title, PREFIX).alias("address"))


def page_reject(spark: SparkSession, d: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    lines = F.size(F.split("text", "\n"))
    df = documents(spark, d).select("doc_id", first.alias("title"), lines.cast("long").alias("n_lines"))
    return df.withColumn("rejected", wikitext.rejected(F.col("title"))).withColumn("rejected_text", wikitext.rejected_text(F.col("title"), F.col("n_lines"))).where("NOT rejected")


def page_url_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", wikitext.url(F.regexp_extract("html", TITLE, 1), PREFIX, quote=True).alias("address"))


def page_categories(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("\n[[Catégorie:"), "lang", F.lit("]]\n[[Catégorie:"), "source", F.lit("]]"))
    return documents(spark, d).select("doc_id", F.posexplode(wikitext.categories(text)).alias("at", "category")).select("doc_id", F.col("at").cast("long").alias("at"), "category")


ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def page_links(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("target"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("form"))
    return table(spark, d, "pages").select("page_id", "url", F.posexplode(both).alias("at", "link")).select("page_id", "url", F.col("at").cast("long").alias("at"), F.col("link.target").alias("target"), F.col("link.form").alias("surface_form"))


def article_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(documents(spark, d), "doc_id", 200).select("doc_id", "lang")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return found_sentences(spark, d).select("doc_id", "pos", "sentence")


def sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    return sentences.numbered(found_sentences(spark, d)).select("sent_id", "doc_id", "pos", "start", "end", "preceding_sent")


def mention_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = found_mentions(spark, d)
    return rows.where(mentions.real_name(F.col("surface_form")))


def mention_normalise(spark: SparkSession, d: str) -> DataFrame:
    surface, end = mentions.normalised(F.col("surface_form"), F.col("end"))
    return found_mentions(spark, d).select("doc_id", "pos", "start", end.alias("end"), surface.alias("surface_form"), F.array_join(mentions.tokens(surface), "+").alias("tokens"), F.nullif("wiki_id", F.lit("")).alias("wiki_id"))


def mention_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = found_mentions(spark, d).join(found_sentences(spark, d).select("doc_id", "pos", "sentence"), ["doc_id", "pos"])
    return mentions.merged(rows, "sentence", "doc_id", "pos")


def mention_shapes(spark: SparkSession, d: str) -> DataFrame:
    return mentions.shaped(found_mentions(spark, d), "doc_id", "pos")


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = words.content_words(F.split(F.lower("text"), "[ \n]+"))
    return documents(spark, d).select("doc_id", F.array_join(kept, " ").alias("kept"), F.size(kept).cast("long").alias("n"))


def token_clean_split(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(graph.spaced(F.col("sentence")), " +")
    return found_sentences(spark, d).select("doc_id", "pos", F.array_join(parts, "|").alias("tokens"), F.size(parts).cast("long").alias("n"))


def kb_json_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def _rejected_sql() -> str:
    parts = [f"regexp_matches(title, {chain.literal('^(' + '|'.join(wikitext.PAGE_PREFIXES) + ')')})", "contains(lower(title), 'abréviation en')", "contains(lower(title), 'abréviation de')", "(contains(lower(title), 'abréviation') AND contains(lower(title), 'liste'))", "contains(lower(title), 'chronologie')", "regexp_matches(lower(title), '^[0-9]{3}')"]
    return " OR ".join(parts)


def _quoted(encoded: str) -> str:
    for code, sign in (("%2F", "/"), ("%28", "("), ("%29", ")"), ("%3A", ":"), ("%22", '"'), ("%27", "'")):
        encoded = f"replace({encoded}, '{code}', {chain.literal(sign)})"
    return encoded


_NAMES = " OR ".join(f"contains(surface_form, {chain.literal(s + ' ')})" for s in mentions.NOT_IN_NAMES)
_CLOSING = f"(regexp_matches(surface_form, {chain.literal(mentions.PUNCTUATION + '$')}) AND NOT regexp_matches(surface_form, '([A-Z]\\.)([A-Z]\\.)+') AND NOT regexp_matches(surface_form, '([0-9]+\\.)[0-9]+'))"
_STOP = "[" + ", ".join(chain.literal(w) for w in dict.fromkeys(words.STOPWORDS)) + "]"
_SPACED = r"regexp_replace(regexp_replace(sentence, '\.+$', '', 'g'), " + chain.literal(r"([,;:?!()\[\]{}«»'\"/’&])") + r", ' \1 ', 'g')"

QUERIES = {
    "page_titles": (page_titles, f"SELECT page_id, title, CASE WHEN length(title) > 0 THEN '{PREFIX}' || upper(substr(replace(title, ' ', '_'), 1, 1)) || substr(replace(title, ' ', '_'), 2) END AS address FROM (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages)"),
    "page_reject": (page_reject, f"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents)
      SELECT doc_id, title, n_lines, ({_rejected_sql()}) AS rejected, (contains(lower(title), 'homonymie') OR contains(lower(title), '#redirect') OR n_lines <= 1) AS rejected_text FROM t WHERE NOT ({_rejected_sql()})"""),
    "page_url_encode": (page_url_encode, f"""WITH t AS (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages),
      n AS (SELECT page_id, title, {_quoted("url_encode(replace(title, ' ', '_'))")} AS name FROM t)
      SELECT page_id, CASE WHEN length(title) > 0 THEN '{PREFIX}' || upper(substr(name, 1, 1)) || substr(name, 2) END AS address FROM n"""),
    "page_categories": (page_categories, """WITH t AS (SELECT doc_id, regexp_extract_all(text || chr(10) || '[[Catégorie:' || lang || ']]' || chr(10) || '[[Catégorie:' || source || ']]', '\\[\\[Catégorie:([^\\n]*)\\]\\]', 1) AS c FROM documents)
      SELECT doc_id, generate_subscripts(c, 1) - 1 AS at, unnest(c) AS category FROM t"""),
    "page_links": (page_links, f"""WITH t AS (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS a, regexp_extract_all(html, '{ANCHOR}', 2) AS b FROM pages)
      SELECT page_id, url, generate_subscripts(a, 1) - 1 AS at, unnest(a) AS target, unnest(b) AS surface_form FROM t"""),
    "article_sample": (article_sample, "SELECT doc_id, lang FROM documents ORDER BY (doc_id * 2654435761 + 17) % 1000003, doc_id LIMIT 200"),
    "html_clean": _chain(wikitext.HTML, "html", "page_id"),
    "wikitext_tail": _chain(wikitext.TAIL),
    "wikitext_templates": _chain(wikitext.TEMPLATES),
    "wikitext_tables": _chain(wikitext.INFOBOX + wikitext.FORMULAS + wikitext.TABLES),
    "wikitext_links": _chain(wikitext.BOLD + wikitext.NUMBERED + wikitext.PREFIXED + wikitext.LABELS),
    "wikitext_headings": _chain(wikitext.HEADINGS + wikitext.BULLETS + wikitext.ENDS),
    "wikitext_clean": _chain(wikitext.BODY + wikitext.LABELS),
    "deep_clean": _chain(wikitext.TITLE + wikitext.HEADER + wikitext.DEEP),
    "sentence_split": (sentence_split, f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sents"),
    "sentence_offsets": (sentence_offsets, f"""WITH {SENTENCES}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS sent_id, CASE WHEN sentence = '' THEN 0 WHEN strpos(text, sentence) > 0 THEN strpos(text, sentence) - 1 END AS start FROM sents)
      SELECT sent_id, doc_id, pos, start, start + length(sentence) AS "end", lag(sent_id) OVER (ORDER BY sent_id) AS preceding_sent FROM n"""),
    "mention_extract": (mention_extract, f"WITH {MENTIONS} SELECT * FROM ments WHERE length(surface_form) > 1 AND NOT ({_NAMES})"),
    "mention_normalise": (mention_normalise, f"""WITH {MENTIONS}, n AS (SELECT *, {_CLOSING} AS closing FROM ments), s AS (SELECT *, CASE WHEN closing THEN regexp_replace(substr(surface_form, 1, length(surface_form) - 1), '\\.+$', '') ELSE surface_form END AS sf FROM n)
      SELECT doc_id, pos, start, CASE WHEN closing THEN "end" - 1 ELSE "end" END AS "end", sf AS surface_form, array_to_string(string_split_regex(sf, '[''\\- /.]'), '+') AS tokens, nullif(wiki_id, '') AS wiki_id FROM s"""),
    "mention_merge": (mention_merge, f"""WITH {MENTIONS}, m AS (SELECT ments.*, sentence FROM ments JOIN sents USING (doc_id, pos)),
      l AS (SELECT *, row_number() OVER w AS i, coalesce(substr(sentence, lag("end") OVER w, 1) = chr(39) OR substr(sentence, start, 1) IN (chr(39), '-'), false) AND lag(start) OVER w IS NOT NULL AS tied FROM m WINDOW w AS (PARTITION BY doc_id, pos ORDER BY start, "end", entity_type)),
      r AS (SELECT *, sum((NOT tied)::INT) OVER (PARTITION BY doc_id, pos ORDER BY i) AS run FROM l),
      g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, pos, run ORDER BY i) - 1) // 2 AS two FROM r),
      x AS (SELECT doc_id, pos, any_value(sentence) AS sentence, min(start) AS start, max_by("end", i) AS "end", max_by(entity_type, i) AS entity_type FROM g GROUP BY doc_id, pos, run, two)
      SELECT doc_id, pos, start, "end", substr(sentence, start + 1, "end" - start) AS surface_form, entity_type FROM x"""),
    "mention_shapes": (mention_shapes, f"""WITH {MENTIONS}, l AS (SELECT *, surface_form || '---' || array_to_string(string_split_regex(surface_form, '[''\\- /.]'), '/') || ' --- ' || start || ' \\ ' || "end" AS line FROM ments)
      SELECT doc_id, pos, string_agg(surface_form, '__' ORDER BY start, "end") AS forms, string_agg(line, chr(10) ORDER BY start, "end") AS printed, count(*) AS n FROM l GROUP BY ALL"""),
    "stopword_filter": (stopword_filter, f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 1 AND NOT regexp_matches(w, '[0-9]')) AS kept FROM documents)
      SELECT doc_id, array_to_string(kept, ' ') AS kept, len(kept) AS n FROM t"""),
    "token_clean_split": (token_clean_split, f"WITH {SENTENCES}, t AS (SELECT doc_id, pos, string_split_regex({_SPACED}, ' +') AS parts FROM sents) SELECT doc_id, pos, array_to_string(parts, '|') AS tokens, len(parts) AS n FROM t"),
    "kb_json_decode": (kb_json_decode, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events"),
}
