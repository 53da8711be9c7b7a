"""Indexers, collections and documents as tables: scans, lookups, keys, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import FIRST_PORT

INDEXER = "id string, name string, exec string, args array<string>, port int"
COLLECTION = "id string, path string, indexer_id string, recursive boolean, source_type string, respect_last_modified boolean, normalizer int"
DOCUMENT = "path string, type string, collection_id string, raw_text string, words map<string,bigint>, last_indexed timestamp"


def row_amount(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; none if it is missing. Where the key is a stored column, the filter reaches the scan."""
    return table.where(F.col(key) == value).limit(1)


def exists(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` whose key is in ``table``."""
    return wanted.join(table.select(key), key, "left_semi")


def missing(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return wanted.join(table.select(key), key, "left_anti")


def newest(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Of the rows of each key the last by ``order``; a partial aggregate, so a key that half of the rows have is no burden."""
    one = F.struct(*columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(one, F.struct(order)).alias("_last")).select("_last.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str | Column) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those that have their key; of several incoming rows with
    one key the last by ``order`` wins. Both have the columns of ``current``; ``incoming`` may have more."""
    fresh = newest(incoming, key, F.col(order) if isinstance(order, str) else order, current.columns)
    return current.join(fresh.select(key), key, "left_anti").select(*current.columns).unionByName(fresh)


def next_port(indexers: DataFrame) -> DataFrame:
    """(port): the lowest free port after a used one; the first of the range if none is used."""
    ports = indexers.select("port")
    taken = ports.where(F.col("port") > FIRST_PORT).select((F.col("port") - 1).alias("port"))
    free = ports.join(taken, "port", "left_anti").orderBy("port").limit(1)
    return free.agg(F.coalesce((F.min("port") + 1).cast("int"), F.lit(FIRST_PORT)).alias("port"))


def with_indexer(collections: DataFrame, indexers: DataFrame) -> DataFrame:
    """Every collection with its indexer."""
    own = indexers.select(F.col("id").alias("indexer_id"), F.col("name").alias("indexer_name"), "port")
    return collections.join(own, "indexer_id")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows that refer to nothing; a null reference is none."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def new_id() -> Column:
    """Seconds since 1970 and four random hexadecimal digits."""
    return F.concat(F.unix_timestamp().cast("string"), F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, 4))
