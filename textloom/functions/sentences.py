"""Sentence segmentation.

A text is cut into atoms, each up to and with a sign `.`, `?` or `!`. Every sign ends a sentence, but for a dot that belongs
to what stands around it: a title, a web address, "Ph.D.", initials (two or more letters that each have a dot), a company's
or a name's suffix, or a number. Such a dot ends a sentence only if a blank and a capital follow. Whether a dot is one of these is told
from its atom and the atoms beside it, so a text is read once.

MARK stands between sentences while they are put together; a text's own U+E000 is a cut, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.running import running_total

MARK = ""
ATOM = "[^.?!]*[.?!]|[^.?!]+"
# Words whose dot ends no sentence.
TITLES = ("Mr", "St", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", "Mt")
DOMAINS = ("com", "net", "org", "io", "gov", "me", "edu")
SUFFIXES = ("Inc", "Ltd", "Jr", "Sr", "Co")
TITLE, DOMAIN, SUFFIX = f"(?:{'|'.join(TITLES)})[.]$", f"^(?:{'|'.join(DOMAINS)})", f" (?:{'|'.join(SUFFIXES)})[.]$"
LETTER, LONE, DEGREE, DIGIT, OPENING = "[A-Za-z][.]$", "^[A-Za-z][.]$", "Ph[.]$", "[0-9][.]$", r"^\s[A-Z]"


def _ending() -> str:
    """A sign that ends a sentence, as a pattern for Java; what stands around a dot is looked at in place. Atoms end with signs, so what must begin or end an atom stands beside a sign."""
    titles, domain, letter = f"(?:{'|'.join(TITLES)})", f"(?:{'|'.join(DOMAINS)})", "[A-Za-z]"
    # just before a dot whose letter is one of initials: that of the next dot, or of the dot before, which must be no word's
    ahead = rf"(?<={letter})(?=[.]{letter}[.](?!{domain}))"
    behind = rf"(?<={letter}[.]{letter})(?<!{titles}[.]{letter})(?<!Ph[.]D)(?<!Ph[.]D[.]{letter})"
    word = rf"(?<={titles})|(?=[.]{domain})|(?<=Ph)(?=[.]D[.])|(?<=Ph[.]D)"
    kept = rf"{word}|{ahead}|{behind}|(?<= (?:{'|'.join(SUFFIXES)}))|(?<=[0-9])(?=[.][0-9])"
    return rf"[?!]|[.](?=\s[A-Z])|(?=[.])(?!{kept})[.]"


ENDING = _ending()


def pieces(column: Column) -> Column:
    """All sentences in order, the empty one after a last sign too; null for a null text. One pass over the text puts MARK after each sign that ends one."""
    return F.split(F.regexp_replace(column, F.lit(ENDING), F.lit("$0" + MARK)), MARK)


def _sql() -> str:
    """The same rules for DuckDB, over rows of atoms: tables cut and sents (doc_id, text, sentence, pos)."""
    return rf"""atoms AS (SELECT doc_id, unnest(regexp_extract_all(text, '{ATOM}')) AS a, generate_subscripts(regexp_extract_all(text, '{ATOM}'), 1) AS i FROM documents),
sides AS (SELECT *, lag(a) OVER w AS before, lead(a) OVER w AS after FROM atoms WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
word AS (SELECT *, regexp_matches(a, '{TITLE}') OR (ends_with(a, '.') AND regexp_matches(coalesce(after, ''), '{DOMAIN}')) OR (regexp_matches(a, '{DEGREE}') AND coalesce(after, '') = 'D.') OR (a = 'D.' AND regexp_matches(coalesce(before, ''), '{DEGREE}')) AS word FROM sides),
letters AS (SELECT *, regexp_matches(a, '{LETTER}') AND NOT word AS initial FROM word),
near AS (SELECT *, lag(initial, 1, false) OVER w AS before_initial, lead(initial, 1, false) OVER w AS after_initial FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT doc_id, i, a, (regexp_matches(a, '[.?!]$') AND (regexp_matches(coalesce(after, ''), '{OPENING}') OR NOT (word OR regexp_matches(a, '{SUFFIX}') OR (regexp_matches(a, '{DIGIT}') AND regexp_matches(coalesce(after, ''), '^[0-9]'))
  OR (initial AND ((after_initial AND regexp_matches(coalesce(after, ''), '{LONE}')) OR (before_initial AND regexp_matches(a, '{LONE}')))))))::INT AS ended FROM near),
cut AS (SELECT *, coalesce(sum(ended) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM ends),
parts AS (SELECT doc_id, pos, string_agg(a, '' ORDER BY i) AS sentence FROM cut GROUP BY ALL UNION ALL SELECT doc_id, sum(ended)::BIGINT, '' FROM cut GROUP BY 1 HAVING max_by(ended, i) = 1 UNION ALL SELECT doc_id, 0::BIGINT, '' FROM documents WHERE text = ''),
sents AS (SELECT doc_id, text, sentence, pos FROM parts JOIN documents USING (doc_id))"""


SQL = _sql()


def sentences(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, sentence, start, end): offsets of the first place where a piece stands in its text."""
    out = docs.select(key, F.col(column).alias("_text"), F.posexplode(pieces(F.col(column))).alias("pos", "sentence"))
    out = out.withColumn("start", F.expr("CASE WHEN length(sentence) = 0 THEN 0 ELSE nullif(instr(_text, sentence), 0) - 1 END"))
    return out.select(key, F.col("pos").cast("long").alias("pos"), "sentence", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("sentence")).cast("long").alias("end"))


def numbered(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sent_id, a running number in order of (key, pos), and preceding_sent. The number of a sentence is its document's first and pos; only one row a document is ordered, in ranges."""
    first = running_total(found.groupBy(key).agg(F.count("*").alias("_n")), [key], "_n", "_first", before=True).drop("_n")
    out = found.join(first, key).withColumn("sent_id", (F.col("_first") + F.col("pos") + 1).cast("long"))
    return out.withColumn("preceding_sent", F.when(F.col("sent_id") > 1, F.col("sent_id") - 1)).drop("_first")
