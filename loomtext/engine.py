"""The engine: catalogue, ingestion and search over one folder of tables."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.display import DIRECTORY, FILE, FIRST_PORT, LAST_PORT
from .functions.normalize import LOWER
from .functions.urls import parse_query
from .operators import catalogue
from .operators.postings import row_postings
from .operators.search import EXCLUDE, either, phrase_terms, response, search, search_batch, search_index
from .plans.query import parse
from .sources.files import TEXT_READER, Reader, Settings, download, file_bytes
from .sources.messages import as_json, documents, outcomes
from .store import DocumentStore, VersionedTable

LOG = logging.getLogger("loomtext")
#: Stands for the number of results of the configuration.
CONFIGURED = -1


@dataclass
class Config:
    """Settings of an engine, kept as JSON."""

    normalizer: int = LOWER
    minus: str = EXCLUDE
    raw_phrases: bool = False
    results: int = 10

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(**json.loads(Path(path).read_text()))

    @classmethod
    def load_or_create(cls, path: str) -> Config:
        """The stored settings; if they cannot be read, the default, which is stored."""
        try:
            return cls.load(path)
        except (OSError, ValueError, TypeError):
            (new := cls()).save(path)
            return new

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


@dataclass
class DispatchErrors:
    """What went wrong when a collection was to be indexed; None is nothing."""

    indexer_was_running: bool = True
    startup_attempt: Exception | None = None
    dispatch_attempt: Exception | None = None

    @property
    def failed(self) -> bool:
        return self.dispatch_attempt is not None


class Engine:
    """``readers`` are those, besides the built-in one, that registered indexers refer to by name: a restarted engine
    must be given them again."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, readers: Iterable[Reader] = ()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.store = DocumentStore(spark, f"{self.root}/documents")
        self._indexers = VersionedTable(spark, f"{self.root}/indexers", catalogue.INDEXER)
        self._collections = VersionedTable(spark, f"{self.root}/collections", catalogue.COLLECTION)
        self.readers: dict[str, Reader] = {r.name: r for r in (TEXT_READER, *readers)}
        self.seconds: dict[str, float] = {}

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            LOG.info("%s: %.2f s", name, took)

    def log(self, message: str) -> None:
        """Takes a line for the log from outside."""
        LOG.info("%s", message)

    def documents(self) -> DataFrame:
        return self.store.documents()

    def indexers(self) -> DataFrame:
        return self._indexers.read()

    def collections(self) -> DataFrame:
        return self._collections.read()

    def _new_id(self) -> str:
        return self.spark.range(1).select(catalogue.new_id()).first()[0]

    def register_indexer(self, reader: Reader = TEXT_READER, command: str = "") -> str:
        """Stores a reader with the next free port and returns its id."""
        port = catalogue.next_port(self.indexers()).first()[0]
        if not FIRST_PORT <= port <= LAST_PORT:
            raise RuntimeError("no port is free")
        name, *args = command.split(" ")
        row = self.spark.createDataFrame([(self._new_id(), reader.name, name, args, port)], catalogue.INDEXER)
        if self.readers.get(reader.name, reader) != reader:
            raise ValueError(f"another reader is named {reader.name}")
        self._indexers.write(self.indexers().unionByName(row))
        self.readers[reader.name] = reader
        return row.first()["id"]

    def unregister_indexer(self, indexer_id: str) -> None:
        self._indexers.write(self.indexers().where(F.col("id") != indexer_id))

    def register_collection(self, path: str, indexer_id: str, recursive: bool = True, source_type: str = "dir", respect_last_modified: bool = False, normalizer: int = LOWER) -> str:
        if catalogue.lookup(self.indexers(), "id", indexer_id).isEmpty():
            raise ValueError(f"no such indexer: {indexer_id}")
        if source_type not in ("file", "dir", "url"):
            raise ValueError(f"no such source type: {source_type}")
        row = (self._new_id(), path, indexer_id, recursive, source_type, respect_last_modified, normalizer)
        self._collections.write(self.collections().unionByName(self.spark.createDataFrame([row], catalogue.COLLECTION)))
        return row[0]

    def _collection(self, collection_id: str):
        """A collection with its reader."""
        found = catalogue.with_indexer(catalogue.lookup(self.collections(), "id", collection_id), self.indexers()).first()
        if found is None:
            raise ValueError(f"no such collection, or its indexer is gone: {collection_id}")
        reader = self.readers.get(found["indexer_name"])
        if reader is None:
            raise LookupError(f"no reader is named {found['indexer_name']}: give it to the engine")
        return found, reader

    def index(self, collection_id: str, modify: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Reads a collection by its indexer's reader and puts its documents, changed by ``modify`` if given. A collection that
        respects modification times leaves out files that were indexed after their last change."""
        found, reader = self._collection(collection_id)
        kind = {"file": FILE, "dir": DIRECTORY}.get(found["source_type"])
        if kind is None:
            raise NotImplementedError("web sources cannot be read")
        docs = reader.read(self.spark, Settings(found["path"], kind, collection_id, found["recursive"]))
        if modify is not None:
            docs = docs.transform(modify)
        if found["respect_last_modified"] and "modified" in docs.columns:
            docs = docs.withColumnRenamed("modified", "at").join(self.store.read().select("path", "last_indexed"), "path", "left")
            docs = docs.where("last_indexed IS NULL OR at IS NULL OR at >= last_indexed").drop("last_indexed", "at")
        with self.timed("index"):
            self.store.upsert(docs.withColumn("collection_id", F.lit(collection_id)))

    def dispatch(self, collection_id: str, modify: Callable[[DataFrame], DataFrame] | None = None) -> DispatchErrors:
        """Indexes a collection. If the first attempt fails, its reader is started and asked once more; what fails then is
        returned and logged, not raised. A collection or reader that is not there is raised."""
        errors = DispatchErrors()
        _, reader = self._collection(collection_id)
        try:
            self.index(collection_id, modify)
            return errors
        except Exception as first:  # noqa: BLE001
            LOG.warning("reader %s failed: %s", reader.name, first)
            errors.indexer_was_running = False
        try:
            if reader.start is not None:
                reader.start()
        except Exception as e:  # noqa: BLE001
            errors.startup_attempt, errors.dispatch_attempt = e, RuntimeError("failed startup prevents dispatch attempt")
            LOG.error("reader %s does not start: %s", reader.name, e)
            return errors
        try:
            self.index(collection_id, modify)
        except Exception as e:  # noqa: BLE001
            errors.dispatch_attempt = e
            LOG.error("reader %s failed again: %s", reader.name, e)
        return errors

    def push_documents(self, messages: list[str] | DataFrame) -> int:
        """Puts the documents of JSON messages, with the words they bring; returns how many there were. Of one path the last
        wins, by message, then by place in it. Messages are a list, or a table (number, value) in which numbers grow.

        What becomes of each message is stored by the same commit (``outcomes``), and refused ones are logged: those that cannot be read, that say that a reader failed
        or that bring no documents. If all are refused, that is stored, and an error is raised."""
        rows = messages if isinstance(messages, DataFrame) else self.spark.createDataFrame(list(enumerate(messages)), "number long, value string")
        number = F.col("number")
        with self.timed("push"):
            version = self.store.upsert(documents(rows, number=number), outcomes=outcomes(rows, number=number))
        own = self.outcomes().where(F.col("version") == version)
        told = own.agg(F.sum("documents").alias("n"), F.count_if(F.col("status") == "refused").alias("refused")).first()
        if told["refused"]:
            LOG.warning("%s messages of version %s are refused", told["refused"], version)
            for r in own.where("status = 'refused'").limit(5).collect():
                LOG.warning("message %s %s: %s", r["message"], r["status"], r["error"])
        n = told["n"]
        if not n:
            raise ValueError("no documents")
        return n

    def outcomes(self) -> DataFrame:
        """(version, message, status, error, documents) of all messages pushed: the version of the documents that came of a push, and a message's number in it."""
        return self.store.outcomes()

    @property
    def indexed(self) -> bool:
        """Whether the stored documents have an index of the configured normal form. It follows them: what is put later brings its own part."""
        return self.store.indexed(self.config.normalizer)

    def build_index(self) -> None:
        """Indexes the documents that are stored, and from then on those that are put, also by other engines over the same folder."""
        with self.timed("build index"):
            self.store.build_index(self.config.normalizer)

    def search(self, query: str, k: int | None = CONFIGURED) -> DataFrame:
        """(path, source, score) of the best ``k`` documents, all if None: by the index if there is one, else by a scan."""
        c = self.config
        options = {"k": c.results if k == CONFIGURED else k, "normalizer": c.normalizer, "minus": c.minus, "raw_phrases": c.raw_phrases}
        if self.indexed:
            parsed = parse(query, c.normalizer)
            own = F.col("term").isin(sorted({*parsed.terms(c.normalizer), *parsed.plus, *parsed.minus}))
            posted, n = self.store.postings(c.normalizer, either([own, *phrase_terms(parsed.quotes, c.normalizer, c.raw_phrases)]))
            return search_index(self.documents(), posted, None, query, **options, n_docs=n)
        return search(self.documents(), query, **options)

    def handle_search(self, query_string: str) -> dict:
        """The answer to a request's query string: all its ``q`` values are one query."""
        keys = parse_query(query_string).get("q")
        if not keys:
            raise ValueError("no keys given")
        query = " ".join(keys)
        with self.timed("search"):
            found = response(self.search(query), query).first()
        return {"Query": query, "Results": [r.asDict() for r in found["results"]]}

    def all_documents(self) -> DataFrame:
        """Stored documents as JSON lines."""
        return as_json(self.store.read())

    def download(self, path: str) -> bytes:
        """The file of a stored document, byte for byte; of one that is not a file, or is gone, the stored text."""
        found = download(self.documents(), path).first()
        if found is None:
            raise FileNotFoundError(path)
        own = file_bytes(self.spark, found["path"]) if found["type"] == "file" else None
        return bytes(found["content"] or b"") if own is None else own

    def search_many(self, queries: list[str] | DataFrame, k: int = CONFIGURED) -> DataFrame:
        """(query, path, source, score) of several queries at once, by the index or else the documents' words. Equal queries are one."""
        c = self.config
        asked = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame([(q,) for q in queries], "query string")
        asked = asked.select(F.col("query").alias("query_id"), "query").distinct()
        docs = self.documents()
        posted, n = self.store.segments(c.normalizer) if self.indexed else (row_postings(docs, c.normalizer), self.store.n_documents())
        phrases = docs if not isinstance(queries, list) or any('"' in q for q in queries) else None
        found = search_batch(posted, asked, n, c.results if k == CONFIGURED else k, c.normalizer, c.minus, c.raw_phrases, phrases)
        return found.withColumnRenamed("query_id", "query")
