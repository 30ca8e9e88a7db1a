"""SQLite tables as a Spark data source, read in parallel by ranges of rowid and written by appending."""

from __future__ import annotations

import pickle
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

TYPES = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


SQL_TYPES = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path (a file that every executor sees), table, partitions. The first column is rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            columns = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(["rowid long", *(f"`{c[1]}` {TYPES.get(c[2].upper(), 'string')}" for c in columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, [f.name for f in schema])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("SQLite tables are only appended to")
        return SqliteWriter(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.table, self.n, self.columns = options["path"], options["table"], int(options.get("partitions", "8")), columns

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        with self._connect() as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (part.low, part.high))


class Written(WriterCommitMessage):
    def __init__(self, part: str):
        self.part = part


class SqliteWriter(DataSourceWriter):
    """Tasks leave their rows in files beside the database; all of them are inserted in one transaction at the end, so a task that runs twice adds nothing."""

    def __init__(self, options, schema: StructType):
        self.path, self.table, self.batch = options["path"], options["table"], int(options.get("batch", "200"))
        self.columns = [(f.name, SQL_TYPES.get(f.dataType.typeName(), "TEXT")) for f in schema]

    def write(self, rows: Iterator[Row]) -> Written:
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            while chunk := [tuple(r) for r in islice(rows, self.batch)]:
                pickle.dump(chunk, f)
        return Written(part)

    def commit(self, messages: list[Written | None]) -> None:
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        with closing(sqlite3.connect(self.path, timeout=60)) as con, con:
            con.execute(f'CREATE TABLE IF NOT EXISTS "{self.table}" ({", ".join(f'"{c}" {t}' for c, t in self.columns)})')
            for message in filter(None, messages):
                with open(message.part, "rb") as f:
                    while f.peek(1):
                        con.executemany(f'INSERT INTO "{self.table}" ({names}) VALUES ({", ".join("?" for _ in self.columns)})', pickle.load(f))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        for message in filter(None, messages):
            Path(message.part).unlink(missing_ok=True)


def append_table(df: DataFrame, path: str, table: str, batch: int = 200) -> None:
    """Append to a table of a database that driver and executors see; the table is made if it is not there."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode("append").option("path", path).option("table", table).option("batch", str(batch)).save()


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()
