"""Samples, caps and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTOR, PRIME = 2654435761, 1000003  # fixed values of the portable hash


def portable_hash(key: Column, seed: int) -> Column:
    """The same number in any engine: keys are taken modulo 2 ** 31 - 1, so products fit in 64 bits."""
    return F.pmod(F.pmod(key.cast("long"), F.lit((1 << 31) - 1)) * F.lit(FACTOR) + F.lit(seed), F.lit(PRIME))


def sample(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """n rows without replacement, the least by hash. Only keys, which must tell rows apart, are ordered (a top-k); the rows stay where they are until a semi-join."""
    chosen = df.select(key).orderBy(portable_hash(F.col(key), seed), key).limit(n)
    return df.join(chosen, key, "left_semi")


def capped(df: DataFrame, types: tuple[str, ...], order: list[str], share: float = 0.95) -> DataFrame:
    """Of each ordered pair of types (first before second in `types`) and label, the first rows up to the `share` quantile of the counts of labelled pairs. Needs ent1type, ent2type, relation."""
    counts = df.where("relation IS NOT NULL AND ent1type IS NOT NULL AND ent2type IS NOT NULL").groupBy("ent1type", "ent2type").count()
    limit = counts.agg(F.percentile("count", share).cast("int")).first()[0]  # one number: a literal lets tasks drop rows before they are dealt
    at = F.array(*map(F.lit, types))
    first, second = F.array_position(at, F.col("ent1type")), F.array_position(at, F.col("ent2type"))
    w = Window.partitionBy("ent1type", "ent2type", F.col("relation").isNull()).orderBy(*order)
    return df.where((first > 0) & (second > 0) & (first < second)).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= F.lit(limit or 0)).drop("_nth")


def id_sets(pairs: DataFrame, key: str, relation: str = "relation", linked: tuple[str, str] = ("wikidata_id1", "wikidata_id2")) -> DataFrame:
    """(key, positive) of the pairs with both items: those with a relation, and those without, in one table."""
    both = pairs.where(F.col(linked[0]).isNotNull() & F.col(linked[1]).isNotNull())
    positive, negative = both.where(F.col(relation).isNotNull()), both.where(F.col(relation).isNull())
    return positive.select(key, F.lit(True).alias("positive")).unionByName(negative.select(key, F.lit(False).alias("positive")))


def rare(df: DataFrame, column: str, below: int = 3) -> DataFrame:
    """Values seen fewer than `below` times."""
    return df.groupBy(column).count().where(F.col("count") < below).select(column)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of rows by a fixed list of columns; empty and null are "other", and so are values outside a list that has "other"."""
    of = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "other").otherwise(F.col(c)).alias(c)
    df = df.select(of(rows), of(columns))
    if "other" in values:
        df = df.withColumn(columns, F.when(F.col(columns).isin(values), F.col(columns)).otherwise("other"))
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)
