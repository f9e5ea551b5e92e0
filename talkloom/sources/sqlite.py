"""SQLite tables as a partitioned Spark source (``format("sqlite_table")``).

The file must be on storage every executor mounts. Each task reads its own
range of an integer column, the row id unless ``partitionColumn`` names another.
"""

from __future__ import annotations

import sqlite3
import sys
from contextlib import closing

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _connect(path: str):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteRange(InputPartition):
    def __init__(self, low: int, high: int, first: bool):
        super().__init__((low, high))
        self.low, self.high, self.first = low, high, first


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.path, self.table = options["path"], options["table"]
        self.column = options.get("partitioncolumn", "rowid")
        self.parts = int(options.get("numpartitions", "8"))

    def partitions(self):
        column, table = _quoted(self.column), _quoted(self.table)
        with closing(_connect(self.path)) as con:
            low, high = con.execute(f"SELECT min({column}), max({column}) FROM {table}").fetchone()
        if low is None:
            return [SqliteRange(0, 0, True)]
        step = -(-(high - low + 1) // self.parts)
        return [SqliteRange(at, min(at + step, high + 1), at == low) for at in range(low, high + 1, step)]

    def read(self, partition):
        columns = ", ".join(_quoted(name) for name in self.names)
        column, table = _quoted(self.column), _quoted(self.table)
        with closing(_connect(self.path)) as con:
            query = f"SELECT {columns} FROM {table} WHERE {column} >= ? AND {column} < ?"
            if partition.first:
                query += f" OR {column} IS NULL"
            yield from con.execute(query, (partition.low, partition.high))


class SqliteTable(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        kinds = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double",
                 "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
        with closing(_connect(self.options["path"])) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")

        def kind(declared: str) -> str:
            return next((spark for part, spark in kinds.items() if part in declared.upper()), "string")

        return ", ".join(f"`{name}` {kind(declared)}" for _, name, declared, *_ in columns)

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, **options).load()
