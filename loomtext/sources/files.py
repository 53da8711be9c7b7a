"""Text files as documents (path, source, raw_text, modified)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import DIRECTORY, FILE, LOCAL, extension

# What is indexed and what is passed over.
TEXT_EXTENSIONS = (".txt", ".md", ".json", ".xml", ".html", ".htm", ".xhtml", ".csv")
ALWAYS_FORBIDDEN = (".", "..")
FORBIDDEN = (".git", ".svn", ".hg", ".idea", ".vscode")



#: Local paths are shown without their scheme.
_LOCAL = "^file:(//)?"


@dataclass(frozen=True)
class Walk:
    """Which files of a folder are read; no extensions means all."""

    forbidden: tuple[str, ...] = FORBIDDEN
    extensions: tuple[str, ...] = TEXT_EXTENSIONS
    recursive: bool = True

    def keeps(self, path, root: str):
        """Condition on a column of full paths under ``root``."""
        inside = F.substring(path, F.lit(len(root) + 1), F.length(path))
        folders = F.slice(F.split(inside, "/"), F.lit(1), F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0)))
        good = ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in (*ALWAYS_FORBIDDEN, *self.forbidden)]))
        return good & extension(path).isin(*self.extensions) if self.extensions else good


@dataclass(frozen=True)
class Settings:
    """One request to read: a file or a folder for a collection."""

    path: str
    type: int | None = None
    collection_id: str | None = None
    recursive: bool = True
    walk: Walk = field(default_factory=Walk)


def source_type(path: str) -> int:
    """File or folder, by looking at a local path."""
    if os.path.isdir(path):
        return DIRECTORY
    if os.path.isfile(path):
        return FILE
    raise FileNotFoundError(path)


def _documents(files: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.col("path"), _LOCAL, "")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select(path.alias("path"), F.lit(LOCAL).alias("source"), text.alias("raw_text"), F.col("modificationTime").alias("modified"))


def read_text(spark: SparkSession, settings: Settings) -> DataFrame:
    """Documents of a file or folder. Contents are split over tasks by file; wrong UTF-8 is replaced. As
    everywhere in Spark, names that start with a dot or an underscore are hidden and passed over."""
    kind = settings.type if settings.type is not None else source_type(settings.path)
    if kind == FILE:
        return _documents(spark.read.format("binaryFile").load(settings.path))
    if kind != DIRECTORY:
        raise NotImplementedError("only files and folders can be read")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(settings.recursive and settings.walk.recursive).lower()).load(settings.path)
    docs = _documents(found)
    return docs.where(settings.walk.keeps(F.col("path"), re.sub(_LOCAL, "", settings.path).rstrip("/") + "/"))


def read_pages_by_ocr(spark: SparkSession, settings: Settings, recognize: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Documents of scanned files, one a file, pages joined by line breaks. ``recognize`` turns the bytes of a file into
    the texts of its pages; none is built in."""
    if recognize is None:
        raise NotImplementedError("give a function that reads the pages of a file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(settings.path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = ["\n".join(recognize(c.as_py())) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([LOCAL] * b.num_rows, pa.int32()), pa.array(texts, pa.string())], names=["path", "source", "raw_text"])

    return files.select("path", "content").mapInArrow(run, "path string, source int, raw_text string")


@dataclass(frozen=True)
class Reader:
    """A named source of documents, the counterpart of an indexer process. ``start`` makes ready what a first attempt to read
    found missing."""

    name: str
    read: Callable[[SparkSession, Settings], DataFrame]
    start: Callable[[], None] | None = None


TEXT_READER = Reader("Local text", read_text)


def download(docs: DataFrame, path: str) -> DataFrame:
    """(path, type, content) of a stored document; only paths that are in ``docs`` can be asked for. ``content`` is the stored
    text; ``file_bytes`` has the file itself."""
    clean = os.path.normpath(path)
    kind = F.col("type") if "type" in docs.columns else F.lit(None).cast("string")
    return docs.where(F.col("path") == clean).limit(1).select("path", kind.alias("type"), F.col("raw_text").cast("binary").alias("content"))


def file_bytes(spark: SparkSession, path: str) -> bytes | None:
    """What a file holds, in any file system that Spark reads; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
