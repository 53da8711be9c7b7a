"""A small builder of SQL statements, for ``spark.sql`` or another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def json_value(column: str, key: str, alias: str) -> str:
    return f"JSON_VALUE( {column} , '$.{key}' ) AS {alias}"


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...] = ()
    table: str = ""
    condition: str = ""

    def queries(self, *columns: str) -> Select:
        return replace(self, columns=self.columns + columns)

    def query_all(self) -> Select:
        return self.queries("*")

    def from_(self, table: str) -> Select:
        return replace(self, table=table)

    def where(self, condition: str) -> Select:
        return replace(self, condition=condition)

    def __str__(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.table}" + (f" WHERE {self.condition}" if self.condition else "")


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[str, ...] = ()
    condition: str = ""

    def set(self, *changes: str) -> Update:
        return replace(self, changes=self.changes + changes)

    def where(self, condition: str) -> Update:
        return replace(self, condition=condition)

    def __str__(self) -> str:
        return f"UPDATE {self.table} SET {', '.join(self.changes)}" + (f" WHERE {self.condition}" if self.condition else "")


def insert_into(table: str, columns: list[str]) -> str:
    """With numbered parameters in the order of the columns."""
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join(f'${k + 1}' for k in range(len(columns)))})"


def run(spark: SparkSession, statement: Select | Update | str, **bound: Any) -> DataFrame:
    """The rows of a statement; ``:name`` in it stands for the bound value ``name``."""
    return spark.sql(str(statement), args=bound)


def fold(rows: DataFrame, start: Any, insert: Callable[[Any, Any], Any]) -> Any:
    """``insert`` applied to what has been gathered and every row in turn, a partition at a time."""
    for row in rows.toLocalIterator():
        start = insert(start, row)
    return start
