"""JSON messages between readers and the engine: a status, and data with a message and documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "status string, data struct<message: string, documents: array<struct<Path: string, Source: int, Words: map<string, bigint>, Collection: string, RawText: string>>>"
SUCCESS, FAIL = "success", "fail"


def success(message: str = "", documents: list[dict] | None = None) -> str:
    return json.dumps({"status": SUCCESS, "data": {"message": message, "documents": documents}}, ensure_ascii=False)


def fail(message: str = "") -> str:
    return json.dumps({"status": FAIL, "data": {"message": message, "documents": None}}, ensure_ascii=False)


def pong() -> str:
    return success("pong")


def exiting() -> str:
    return success("exiting")


def parsed(messages: DataFrame, column: str = "value") -> DataFrame:
    return messages.select(F.from_json(F.col(column), SCHEMA).alias("m")).select("m.*")


def _numbered(messages: DataFrame, column: str, number: Column | None) -> DataFrame:
    return messages.select((F.lit(0) if number is None else number).alias("n"), F.from_json(F.col(column), SCHEMA).alias("m"))


def documents(messages: DataFrame, column: str = "value", number: Column | None = None) -> DataFrame:
    """(path, source, words, collection_id, raw_text, arrival) of all documents in successful messages. A message that cannot
    be read, failed or holds none adds nothing, nor does a document without a path: ``outcomes`` tells. ``arrival`` is the order in which they came: by
    ``number``, an expression over the messages that grows with them, then by place in the message."""
    good = _numbered(messages, column, number).where(F.col("m.status") == SUCCESS).select("n", F.posexplode("m.data.documents").alias("at", "d")).where("d.Path IS NOT NULL")
    field = lambda name, alias: F.col(f"d.{name}").alias(alias)
    return good.select(field("Path", "path"), field("Source", "source"), field("Words", "words"), field("Collection", "collection_id"), field("RawText", "raw_text"), F.struct("n", "at").alias("arrival"))


def outcomes(messages: DataFrame, column: str = "value", number: Column | None = None) -> DataFrame:
    """(message, status, error, documents): a row for each message, by its number as text. It is "accepted" with the documents that it brings, or
    "refused"; the error says why, or how many of an accepted message's documents have no path."""
    read = _numbered(messages, column, number)
    named = F.col("n") if number is None or dict(read.dtypes)["n"] in ("int", "bigint", "string") else F.to_json("n")
    every = F.coalesce(F.greatest(F.size("m.data.documents"), F.lit(0)), F.lit(0)).cast("long")
    with_path = F.coalesce(F.size(F.filter("m.data.documents", lambda d: d["Path"].isNotNull())), F.lit(0)).cast("long")
    counted = read.select(named.cast("string").alias("message"), "m", every.alias("every"), F.when(F.col("m.status") == SUCCESS, F.greatest(with_path, F.lit(0).cast("long"))).otherwise(0).alias("documents"))
    error = (
        F.when(F.col("m.status").isNull(), "not a message")
        .when(F.col("m.status") != SUCCESS, F.concat(F.lit("the reader failed: "), F.coalesce("m.data.message", F.lit(""))))
        .when(F.col("every") == 0, "no documents")
        .when(F.col("documents") < F.col("every"), F.concat((F.col("every") - F.col("documents")).cast("string"), F.lit(" documents without a path")))
    )
    return counted.select("message", F.when(F.coalesce(F.col("documents"), F.lit(0)) > 0, "accepted").otherwise("refused").alias("status"), error.alias("error"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def word_rows(docs: DataFrame) -> DataFrame:
    """(path, word, freq) of documents that came with their words counted."""
    return docs.select("path", F.explode("words").alias("word", "freq"))


def json_value(column: Column, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
