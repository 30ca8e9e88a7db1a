"""Filters of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French stop words.
STOPWORDS = (
    "alors", "au", "aucuns", "aussi", "autre", "avec", "car", "ce", "cet", "cela", "ces", "ceux", "ci", "comme", "comment", "dans", "des", "du",
    "donc", "elle", "elles", "en", "est", "et", "eu", "un", "une", "par", "plus", "moins", "aux", "ici", "il", "ils", "je", "juste", "la", "le",
    "les", "leur", "là", "ma", "mais", "mes", "mine", "moins", "mon", "mot", "ni", "notre", "nous", "ou", "où", "parce", "pas", "peut", "pour",
    "quand", "que", "quel", "quelle", "quelles", "on", "ont", "ne", "qu", "vers", "été", "était", "être", "avant", "après", "jusque", "jusqu",
    "depuis", "avoir", "quels", "qui", "sa", "sans", "ses", "si", "sien", "son", "sont", "sous", "sur", "ta", "tandis", "tellement", "tels", "tes",
    "ton", "tous", "tout", "trop", "très", "tu", "votre", "vous", "vu", "ça", "sa", "son", "ses", "de", "a",
)


def content_words(words: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased words without stop words, words of one character or none, and words with a digit."""
    listed = F.array(*map(F.lit, dict.fromkeys(stop)))
    return F.filter(words, lambda w: ~F.array_contains(listed, w) & (F.length(w) > 1) & ~w.rlike("[0-9]"))
