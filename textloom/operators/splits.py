"""Train, test and validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.sampling import portable_hash

BUCKET = 1000  # hashes a bucket


def stratified_half(df: DataFrame, key: str, label: str, same: list[str], seed: int = 7) -> DataFrame:
    """Adds `part`: half of each label (rounded down) by hash is train; the rest is test, without rows that share `same` with a train row of their label, which go."""
    hashed = df.select(label, key).withColumn("_hash", portable_hash(F.col(key), seed)).withColumn("_bucket", (F.col("_hash") / BUCKET).cast("int"))
    # rows are counted a bucket of hashes; only those of the bucket where a label's half ends are ranked, to find its last row
    of_label = Window.partitionBy("_label")
    sizes = hashed.groupBy(F.col(label).alias("_label"), F.col("_bucket").alias("_at")).agg(F.count("*").alias("_rows"))
    sizes = sizes.withColumn("_half", F.floor(F.sum("_rows").over(of_label) / 2)).withColumn("_before", F.sum("_rows").over(of_label.orderBy("_at")) - F.col("_rows"))
    cut = sizes.where("_before < _half AND _before + _rows >= _half")
    inside = hashed.join(cut, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_at")))
    nth = F.row_number().over(of_label.orderBy("_hash", key))
    last = inside.withColumn("_nth", nth).where("_nth = _half - _before").select("_label", F.struct(F.col("_hash").alias("h"), F.col(key).alias("k")).alias("_last"))
    mine = F.struct(portable_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    halves = df.join(last, F.col(label).eqNullSafe(F.col("_label")), "left").withColumn("_train", F.coalesce(mine <= F.col("_last"), F.lit(False)))
    train, test = (halves.where(c).select(*df.columns) for c in ("_train", "NOT _train"))
    test = test.join(train.select(label, *same).distinct(), [label, *same], "left_anti")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def held_out(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumn("part", F.when(F.col(column).isin(*values), "test").otherwise("train"))


def validation(df: DataFrame, key: str, folds: int = 4, seed: int = 7) -> DataFrame:
    return df.withColumn("is_validation", (portable_hash(F.col(key), seed) % folds) == 0)
