"""Stages that go on where they stopped: by an anti join on what is done, or as a file stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from textloom.operators.pairs import unseen
from textloom.sources.files import append


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stage(rows: DataFrame, path: str, key: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transform the rows whose key has not been seen yet, append what comes of them to the table at `path`, return the whole table.

    Keys of which nothing comes are noted beside it, so that they are not asked for again.
    """
    new = rows
    for done in (existing(rows.sparkSession, path), existing(rows.sparkSession, f"{path}.done")):
        new = new if done is None else unseen(new, done, key)
    keys = new.select(key).distinct()
    append(transform(new), path)
    append(keys, f"{path}.done")
    return rows.sparkSession.read.parquet(path)


def stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """All files that have come since the last run, once each: a checkpointed file stream that ends when it has caught up."""
    found = spark.readStream.schema(schema).parquet(source)
    transform(found).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
