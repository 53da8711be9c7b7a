"""Stored tables: each change writes a new version beside the old one. Documents are stored in levelled sets with an index that follows them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import reduce
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normalize import LOWER
from .operators import postings as P
from .operators.catalogue import DOCUMENT, newest

#: Rows that a set of documents replaces in older ones.
KILLS = "set string, path string"
OUTCOMES = "version long, message string, status string, error string, documents long"
POSTING = "path string, source int, n_terms long, term string, freq long"
#: Rows of a Parquet page of documents, which are sorted by path in their buckets: a reader of some paths skips the pages between them.
PAGE_ROWS = 100
#: Bytes of text that a task is to sort the words of.
TASK_TEXT = 64 << 20


def parts_for(docs: DataFrame) -> int:
    """How many parts of about ``TASK_TEXT`` the texts of ``docs`` make, by a job that reads them."""
    return -(-(docs.agg(F.sum(F.octet_length("raw_text"))).first()[0] or 1) // TASK_TEXT)


class Folder:
    """A folder of data sets in any file system that Spark reads; a data set counts once Spark has finished it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def complete(self, pattern: str) -> list[re.Match]:
        """Names of finished data sets that match."""
        if not self._fs.exists(self._path("")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return [m for n in names if (m := re.fullmatch(pattern, n)) and self._fs.exists(self._path(f"{n}/_SUCCESS"))]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def read_text(self, name: str) -> str:
        """A small file."""
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Makes a small file with all that it has to hold; False if there is one of that name. It is written aside and then gets its name, which
        one writer only can give: by a link in a local file system, by a rename that replaces nothing in others."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self._fs.mkdirs(self._path(name).getParent())
        out = self._fs.create(self._path(aside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(*(str(self._fs.makeQualified(self._path(n)).toUri().getPath()) for n in (aside, name)))
            else:
                kind = jvm.org.apache.hadoop.fs.Options.Rename
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(aside), self._path(name), self.spark._sc._gateway.new_array(kind, 0))
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self._fs.delete(self._path(aside), False)
        return True


class VersionedTable(Folder):
    """A Parquet table under ``root`` that is written as a whole. The newest complete version counts, so
    readers keep theirs and a failed write leaves nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 2):
        super().__init__(spark, root)
        self.schema, self.keep = schema, keep

    def versions(self) -> list[int]:
        return [int(m[1]) for m in self.complete(r"v(\d{8})")]

    def read(self) -> DataFrame:
        found = self.versions()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.root}/v{found[-1]:08d}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        found = self.versions()
        df.write.mode("overwrite").parquet(f"{self.root}/v{(found[-1] if found else 0) + 1:08d}")
        for v in found[: -self.keep + 1] if self.keep > 1 else found:
            self.delete(f"v{v:08d}")


def merge_from(levels: list[int], fan: int) -> int | None:
    """Where the newest sets begin that are to be made one, by the levels of all, oldest first; None if there are no such.

    A set counts for the largest level from it on, so these never rise; ``fan`` sets of one level are made one, with all that is newer. So
    there are less than ``fan`` sets of a level, and a row is written again about once for each level that it rises.
    """
    at_least = list(accumulate(reversed(levels), max))[::-1]
    return next((at_least.index(x) for x in sorted(set(at_least)) if at_least.count(x) >= fan), None)


class DocumentStore(Folder):
    """The table of documents, with upsert by path.

    An upsert writes a set: its own documents, bucketed and in a bucket sorted by path; what they replace in older sets (``kills``: a set's name and a path); if the
    store is indexed, their postings; and perhaps a table of outcomes. Sets of like size are made one (``merge_from``), postings without reading
    texts again; the number of sets grows with the logarithm of the rows, and so does how often a row is written. A reader takes
    every set without its kills. Both sides of that join are in the same buckets, so no text is shuffled or sorted.

    A version is a manifest, a small file that names its sets. Writers are free to work at once: a manifest is put under the next number only if none
    is there, else what was prepared is fitted to the newer one and put again, so none is lost and the last one wins.
    Batches that carry a number are put once. The last ``keep`` versions can be read.
    """

    #: Manifests that stay after their versions are gone, so that a slow writer finds its number taken.
    MANIFESTS = 1000

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, fan: int = 4, buckets: int | None = None):
        super().__init__(spark, root)
        self.keep, self.fan = keep, fan
        self._own_buckets = buckets

    # manifests

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.names("log") if (m := re.fullmatch(r"(\d{10})\.json", n)))

    def _manifest(self, number: int) -> dict:
        return json.loads(self.read_text(f"log/{number:010d}.json"))

    def _newest(self) -> dict:
        found = self._numbers()
        if found:
            return self._manifest(found[-1]) | {"number": found[-1]}
        return {"number": 0, "version": 0, "buckets": self._own_buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "sets": [], "batches": {}}

    def _of_version(self, version: int) -> dict:
        for n in reversed(self._numbers()) if version in self.versions() else ():
            if (m := self._manifest(n))["version"] == version:
                return m | {"number": n}
        if not version:
            return self._newest() | {"sets": []}
        raise FileNotFoundError(f"{self.root} has no version {version} any more")

    def _commit(self, manifest: dict) -> bool:
        """Puts the manifest that follows the one it was made from, unless another writer did."""
        body = {k: v for k, v in manifest.items() if k != "number"}
        return self.create_once(f"log/{manifest['number'] + 1:010d}.json", json.dumps(body))

    def version(self) -> int:
        """The newest version; 0 if nothing was stored."""
        return self._newest()["version"]

    def versions(self) -> list[int]:
        newest = self.version()
        return list(range(max(1, newest - self.keep + 1), newest + 1))

    # sets

    def _table_name(self, name: str) -> str:
        return "loomtext_" + hashlib.md5(f"{self.root}/sets/{name}".encode()).hexdigest()

    def _table(self, name: str, schema: str, buckets: int) -> DataFrame:
        """A data set under ``sets`` that was written in buckets of paths. Only a catalogue's tables have buckets, so it is made one of the session's."""
        where = f"{self.root}/sets/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table_name(name)} ({schema}) USING parquet CLUSTERED BY (path) INTO {buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(self._table_name(name))

    def _put(self, df: DataFrame, name: str, buckets: int, *order: str) -> None:
        out = df.write.format("parquet").mode("overwrite").bucketBy(buckets, "path").option("path", f"{self.root}/sets/{name}")
        if name.endswith("/docs"):
            out = out.option("parquet.page.row.count.limit", PAGE_ROWS)
        (out.sortBy(*order) if order else out).saveAsTable(self._table_name(name))

    def _drop(self, name: str) -> None:
        """Deletes a set, or a part of one."""
        for n in (name,) if "/" in name else [f"{name}/{part}" for part in self.names(f"sets/{name}")]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(n)}")
        self.delete(f"sets/{name}")

    def _alive(self, m: dict, i: int, rows: DataFrame, bucketed: bool = True) -> DataFrame:
        """``rows`` (with a path) of the i-th set of a manifest that no newer set replaces. Those that are ``bucketed`` as the kills are
        stay where they are."""
        names = [m["sets"][i]["name"], *m["sets"][i]["of"]]
        for newer in m["sets"][i + 1 :]:
            if any(newer["killed"].get(n) for n in names):
                kills = self._table(f"{newer['name']}/kills", KILLS, m["buckets"]).where(F.col("set").isin(names)).select("path")
                rows = rows.join(kills.hint("shuffle_hash") if bucketed else kills, "path", "left_anti")
        return rows

    def _docs(self, m: dict, i: int) -> DataFrame:
        return self._alive(m, i, self._table(f"{m['sets'][i]['name']}/docs", DOCUMENT, m["buckets"]))

    @staticmethod
    def _rows(m: dict, i: int) -> int:
        """How many rows of the i-th set are alive."""
        names = [m["sets"][i]["name"], *m["sets"][i]["of"]]
        return m["sets"][i]["rows"] - sum(s["killed"].get(n, 0) for s in m["sets"][i + 1 :] for n in names)

    def _level(self, rows: int) -> int:
        level = 0
        while rows >= self.fan ** (level + 1):
            level += 1
        return level

    def read(self, version: int | None = None) -> DataFrame:
        m = self._newest() if version is None else self._of_version(version)
        return self._all([self._docs(m, i) for i in range(len(m["sets"]))], DOCUMENT)

    def _all(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def documents(self, version: int | None = None) -> DataFrame:
        """(path, source, raw_text, words, ...) as search reads them."""
        return self.read(version).withColumn("source", F.when(F.col("type") == "web", 1).otherwise(0))

    def n_documents(self) -> int:
        m = self._newest()
        return sum(self._rows(m, i) for i in range(len(m["sets"])))

    def outcomes(self) -> DataFrame:
        """(version, message, status, error, documents) of all that was put with outcomes."""
        return self._outcomes(self._newest()["sets"])

    def _outcomes(self, sets: list[dict]) -> DataFrame:
        """A set that was put does not know its version when its outcomes are written, its manifest does."""
        read = lambda s: self.spark.read.schema(OUTCOMES).parquet(f"{self.root}/sets/{s['name']}/outcomes")
        return self._all([read(s).withColumn("version", F.coalesce("version", F.lit(s["version"]))) for s in sets if s["outcomes"]], OUTCOMES)

    # writing

    def upsert(self, docs: DataFrame, order: Column | None = None, outcomes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Puts documents (path, source, raw_text, perhaps collection_id and words); of several rows of one path the last by
        ``order`` (else by the column ``arrival``, if there is one, else the larger text) wins. ``outcomes`` (message, status, error, documents) are stored
        by the same commit. Returns the version that came of it. ``batch``: whose it is and its number; one that is not above the last of the
        same name is left alone, and 0 is returned. A null path is an error."""
        m = self._newest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        has = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
        order = order if order is not None else F.col("arrival") if "arrival" in docs.columns else F.col("raw_text")
        kind = F.when(F.col("source") == 1, "web").otherwise("file").alias("type")
        path = F.coalesce("path", F.raise_error(F.lit("a document without a path"))).alias("path")
        ready = docs.select(path, kind, has("collection_id", "string").alias("collection_id"), "raw_text", has("words", "map<string,bigint>").alias("words"), F.current_timestamp().alias("last_indexed"), F.struct(order).alias("_order"))
        own_columns = ready.columns[:-1]
        once, more = P.split_repeated(ready)  # most documents are put once, so their texts are shuffled once and not compared
        ready = once.select(*own_columns)
        if more is not None:
            ready = ready.unionByName(newest(more, "path", F.col("_order"), own_columns))
        name, buckets = uuid.uuid4().hex, m["buckets"]
        if not m["sets"] and not self._own_buckets:
            buckets = max(buckets, parts_for(once))
        self._put(ready.repartition(buckets, "path"), f"{name}/docs", buckets, "path")
        own = self._table(f"{name}/docs", DOCUMENT, buckets)
        rows = own.count()
        if outcomes is not None:
            self._put_outcomes(outcomes, name)
        indexed: list[int] = []
        while True:
            m = self._newest()
            if batch and m["batches"].get(batch[0], -1) >= batch[1]:
                self._drop(name)
                return 0
            if m["sets"] and m["buckets"] != buckets:  # another writer put the first set meanwhile, in its buckets
                self._drop(name)
                name, buckets, indexed = uuid.uuid4().hex, m["buckets"], []
                self._put(ready.repartition(buckets, "path"), f"{name}/docs", buckets, "path")
                own = self._table(f"{name}/docs", DOCUMENT, buckets)
                if outcomes is not None:
                    self._put_outcomes(outcomes, name)
            for k in self._normalizers(m):
                if k not in indexed:
                    self._index_set(name, own, k, buckets)
                    indexed.append(k)
            killed = self._kill(m, name, own) if rows else {}
            entry = {"name": name, "rows": rows, "killed": killed, "of": [], "index": indexed, "outcomes": outcomes is not None, "version": m["version"] + 1}
            new = m | {"version": m["version"] + 1, "buckets": buckets, "sets": [*m["sets"], entry]}
            if batch:
                new["batches"] = m["batches"] | {batch[0]: batch[1]}
            if self._newest()["number"] == m["number"] and self._commit(new):
                break
            self._drop(f"{name}/kills")
        self._merge()
        self._clean()
        return new["version"]

    def _put_outcomes(self, outcomes: DataFrame, name: str) -> None:
        outcomes.select(F.lit(None).cast("long").alias("version"), "message", "status", "error", "documents").write.parquet(f"{self.root}/sets/{name}/outcomes")

    def _kill(self, m: dict, name: str, own: DataFrame) -> dict[str, int]:
        """Writes which rows of the sets of a manifest the documents ``own`` replace; only paths are read, bucket by bucket."""
        paths = own.select("path").hint("shuffle_hash")
        found = [self._docs(m, i).select("path").join(paths, "path", "left_semi").select(F.lit(s["name"]).alias("set"), "path") for i, s in enumerate(m["sets"]) if s["rows"]]
        if not found:
            return {}
        self._put(self._all(found, KILLS), f"{name}/kills", m["buckets"])
        return {r["set"]: r["count"] for r in self._table(f"{name}/kills", KILLS, m["buckets"]).groupBy("set").count().collect()}

    def _merge(self) -> None:
        """Makes sets of like size one. What other writers put meanwhile follows the set that comes of it."""
        while True:
            m = self._newest()
            start = merge_from([self._level(self._rows(m, i)) for i in range(len(m["sets"]))], self.fan)
            if start is None:
                return
            self.merge(m, start)

    def compact(self) -> None:
        """Makes all sets one."""
        m = self._newest()
        if len(m["sets"]) > 1:
            self.merge(m, 0)
            self._clean()

    def merge(self, m: dict, start: int) -> bool:
        """Makes the sets of a manifest from ``start`` on one: their living documents, postings and outcomes, and what they replace in older sets. False
        if another writer made some of them one before."""
        name, buckets, group = uuid.uuid4().hex, m["buckets"], range(start, len(m["sets"]))
        sets = [m["sets"][i] for i in group]
        old = {n for s in m["sets"][:start] for n in (s["name"], *s["of"])}
        self._put(self._all([self._docs(m, i) for i in group], DOCUMENT), f"{name}/docs", buckets, "path")
        rows = sum(self._rows(m, i) for i in group)
        killed: dict[str, int] = {}
        for s in sets:
            for n, k in s["killed"].items():
                if n in old:
                    killed[n] = killed.get(n, 0) + k
        if killed:
            kills = [self._table(f"{s['name']}/kills", KILLS, buckets).where(F.col("set").isin(sorted(killed))) for s in sets if killed.keys() & s["killed"].keys()]
            self._put(self._all(kills, KILLS), f"{name}/kills", buckets)
        indexed = [k for k in sets[0]["index"] if all(k in s["index"] for s in sets)]
        for k in indexed:
            self._put(self._all([self._segment(m, i, k) for i in group], POSTING), f"{name}/index-{k}", buckets, "term")
        if told := any(s["outcomes"] for s in sets):
            self._outcomes(sets).write.parquet(f"{self.root}/sets/{name}/outcomes")
        names = [s["name"] for s in sets]
        while True:
            now = self._newest()
            at = [s["name"] for s in now["sets"]]
            if at[start : start + len(names)] != names:
                self._drop(name)
                return False
            newer = now["sets"][start + len(names) :]
            named = {n for s in newer for n in s["killed"]}  # by what newer sets call the merged ones
            entry = {"name": name, "rows": rows, "killed": killed, "of": [n for s in sets for n in (s["name"], *s["of"]) if n in named], "index": indexed, "outcomes": told, "version": 0}
            if self._commit(now | {"sets": [*now["sets"][:start], entry, *newer]}):
                return True

    # index

    @staticmethod
    def _normalizers(m: dict) -> list[int]:
        """Normal forms that every set has postings of."""
        return [k for k in m["sets"][0]["index"] if all(k in s["index"] for s in m["sets"])] if m["sets"] else []

    def indexed(self, normalizer: int = LOWER) -> bool:
        return normalizer in self._normalizers(self._newest())

    def _index_set(self, name: str, docs: DataFrame, normalizer: int, buckets: int) -> None:
        """Postings are in the buckets of their documents, so no frequent term is a burden; in a bucket they are sorted by term."""
        docs = docs.withColumn("source", F.when(F.col("type") == "web", 1).otherwise(0))
        self._put(P.row_postings(docs, normalizer), f"{name}/index-{normalizer}", buckets, "term")

    def build_index(self, normalizer: int = LOWER) -> None:
        """Gives every set its postings (path, source, n_terms, term, freq). From then on each upsert brings its own."""
        made: list[str] = []
        while True:
            m = self._newest()
            for s in m["sets"]:
                if normalizer not in s["index"] and s["name"] not in made:
                    self._index_set(s["name"], self._table(f"{s['name']}/docs", DOCUMENT, m["buckets"]), normalizer, m["buckets"])
                    made.append(s["name"])
            sets = [s | {"index": sorted({*s["index"], normalizer})} for s in m["sets"]]
            if sets == m["sets"] or self._commit(m | {"sets": sets}):
                return

    def _segment(self, m: dict, i: int, normalizer: int, wanted: Column | None = None) -> DataFrame:
        """A set's living postings. The few that a search has ``wanted`` are not worth the buckets."""
        rows = self._table(f"{m['sets'][i]['name']}/index-{normalizer}", POSTING, m["buckets"])
        return self._alive(m, i, rows if wanted is None else rows.where(wanted), bucketed=wanted is None)

    def postings(self, normalizer: int = LOWER, terms: list[str] | Column | None = None) -> tuple[DataFrame, int]:
        """The postings of all living documents, of the ``terms`` that are listed or meet a condition or of all there are, and the number of these documents. A search reads the row groups
        with its terms in each bucket; what is found there is held against the kills, and no text is read."""
        m = self._newest()
        if m["sets"] and normalizer not in self._normalizers(m):
            raise LookupError(f"no index of normal form {normalizer}")
        wanted = F.col("term").isin(terms) if isinstance(terms, list) else terms
        return self._all([self._segment(m, i, normalizer, wanted) for i in range(len(m["sets"]))], POSTING), sum(self._rows(m, i) for i in range(len(m["sets"])))

    def segments(self, normalizer: int = LOWER) -> tuple[list[DataFrame], int]:
        """The living postings set by set, each in its buckets, and the number of documents."""
        m = self._newest()
        if m["sets"] and normalizer not in self._normalizers(m):
            raise LookupError(f"no index of normal form {normalizer}")
        return [self._segment(m, i, normalizer) for i in range(len(m["sets"]))], sum(self._rows(m, i) for i in range(len(m["sets"])))

    # cleaning

    def _clean(self) -> None:
        """Deletes what no kept version needs. Sets that no manifest names yet are another writer's and stay."""
        numbers = self._numbers()
        found = {n: self._manifest(n) for n in numbers[-64:]}  # older ones were cleaned before
        newest_version = found[numbers[-1]]["version"]
        kept = {s["name"] for m in found.values() if m["version"] > newest_version - self.keep for s in m["sets"]}
        for gone in {s["name"] for m in found.values() for s in m["sets"]} - kept:
            if self._fs.exists(self._path(f"sets/{gone}")):
                self._drop(gone)
        for n in numbers[: -self.MANIFESTS]:
            self.delete(f"log/{n:010d}.json")


def write_index(docs: DataFrame, root: str, normalizer: int = LOWER, files: int | None = None) -> None:
    """Postings (path, source, n_terms, term, freq), in every file sorted by term, so that a search reads the few pages
    with its terms and nothing else; document lengths; and, last, the number of documents. A file has the words of some documents, so no posting is
    shuffled; documents are dealt to more tasks if they have too much text for those they are in. ``files``: into how many, whatever they have."""
    n = files or parts_for(docs)
    if files or docs.rdd.getNumPartitions() < n:
        docs = docs.repartition(n)
    P.full_postings(docs, normalizer).sortWithinPartitions("term", "path").write.mode("overwrite").parquet(f"{root}/postings")
    P.document_lengths(docs).write.mode("overwrite").parquet(f"{root}/lengths")
    docs.agg(F.count("*").alias("n_docs")).select("n_docs", F.lit(normalizer).alias("normalizer")).write.mode("overwrite").parquet(f"{root}/facts")


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/lengths")


def index_documents(spark: SparkSession, root: str) -> int:
    """The number of documents that an index is of."""
    return spark.read.parquet(f"{root}/facts").first()["n_docs"]
