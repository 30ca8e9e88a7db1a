"""Feature tables, id lists, word vectors and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FEATURES_OURS = "id1 long, id2 long, entity1 string, entity2 string, ent1type string, ent2type string, shortest_dependency_path_p string, shortest_dependency_path_w string, shortest_dependency_path_t string, original_sentence string, id_entities_pair long, relation string"
FEATURES_XU = "id1 long, id2 long, entity1 string, entity2 string, word_path1 string, word_path2 string, dep_path1 string, dep_path2 string, pos_path1 string, pos_path2 string, original_sentence string, relation string, are_related int, id_entities_pair long"


def read_features(spark: SparkSession, path: str, schema: str = FEATURES_OURS) -> DataFrame:
    """A CSV table with a fixed schema; missing texts are empty."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').na.fill("")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_ids(spark: SparkSession, path: str, name: str = "id_entities_pair") -> DataFrame:
    """A JSON array of numbers as a table to join with."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<long>")).alias(name))


def write_ids(ids: DataFrame, path: str) -> None:
    """One JSON array. It is one value by its format; for long lists write a table."""
    ids.agg(F.to_json(F.array_sort(F.collect_list(ids.columns[0]))).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a text file of word vectors: a word and its numbers, by blanks."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) > 2).select(F.element_at(parts, 1).alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"))


def widened(df: DataFrame, schema: str) -> DataFrame:
    """The rows in a later schema: columns that they lack are null, others are cast; columns that it does not name come last."""
    wanted = StructType.fromDDL(schema)
    have = set(df.columns)
    known = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*known, *(c for c in df.columns if c not in wanted.names))


def append(df: DataFrame, path: str) -> None:
    """The sink of every stage: files are committed as a whole, so nothing is buffered or lost at the end."""
    df.write.mode("append").parquet(path)
