"""Token files: Arrow IPC files of fixed-size-list batches with equal-length sequences and their masks.

A file holds the ids of its documents, one after another, cut into sequences of ``length`` ids; the last is
filled up, and its mask is false there. All batches but the last have ``rows`` sequences, so sequence k is
row k % rows of batch k // rows: random access without a scan, on memory-mapped buffers where the file is
local. A second file lists the documents with their place in it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunks import Remembered
from .common import NULL_KEY, Runs, batch, cut, map_batches, order_runs, shared_dir, shuffle_parts, tie_of
from .library import library_encoder

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def ids_schema(length: int, width: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("attention_mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Appends documents; the files appear under their names only when closed, so a task that is lost or
    repeated leaves nothing half-written."""

    def __init__(self, where: str, name: str, length: int, rows: int, width: int):
        self.fs, root = fs.FileSystem.from_uri(where)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.temp = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.length, self.rows, self.dtype = length, rows, np.uint16 if width == 2 else np.uint32
        self.schema = ids_schema(length, width)
        self.out = self.fs.open_output_stream(self.temp + ".ids")
        self.ids = ipc.new_file(self.out, self.schema)
        self.out_docs = self.fs.open_output_stream(self.temp + ".docs")
        self.docs = ipc.new_file(self.out_docs, DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.listed: list[tuple] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.listed.append((key, self.total, len(ids)))
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.rows * self.length:
            self._flush(False)
        if len(self.listed) >= 8192:
            self._list()

    def _list(self) -> None:
        self.docs.write_batch(batch(DOCS, list(zip(*self.listed, strict=True)) if self.listed else [[], [], []]))
        self.listed = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = self.rows * self.length
        at = 0
        while len(flat) - at >= step or last and at < len(flat):
            own = flat[at : at + step]
            n = -(-len(own) // self.length)
            filled = np.zeros(n * self.length, self.dtype)
            filled[: len(own)] = own
            mask = np.zeros(n * self.length, bool)
            mask[: len(own)] = True
            self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(filled), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            at += len(own)
        self.held, self.n_held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(True)
        self._list()
        for writer, out in ((self.ids, self.out), (self.docs, self.out_docs)):
            writer.close()
            out.close()
        for end in (".ids", ".docs"):
            common.rename(self.fs, self.temp + end, self.final + end)


class Reader:
    """Random access to a token file."""

    def __init__(self, where: str, name: str):
        self.fs, root = fs.FileSystem.from_uri(where)
        self.file = self._open(f"{root}/{name}.ids")
        self.docs_file = self._open(f"{root}/{name}.docs")
        self.n = self.file.num_record_batches
        self.length = self.file.schema.field("input_ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.n else 1
        self.at, self.last = -1, np.empty(0, np.uint32)

    def _open(self, path: str) -> ipc.RecordBatchFileReader:
        local = isinstance(self.fs, fs.LocalFileSystem)
        return ipc.open_file(pa.memory_map(path) if local else self.fs.open_input_file(path))

    def _ids(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.last = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.last

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``k``, as views of the file's buffers."""
        b, row = divmod(k, self.rows)
        own = slice(row * self.length, (row + 1) * self.length)
        return self._ids(b)[own], self.file.get_batch(b).column(1).flatten()[own]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        step, parts = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, step)
            own = self._ids(b)[at : at + n]
            parts.append(own)
            start, n = start + len(own), n - len(own)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint32)])

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.docs_file.num_record_batches):
            yield self.docs_file.get_batch(k)


def write(df: DataFrame, path: str, end_id: int, where: str, length: int = 2048, rows: int = 32, width: int = 2, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False) -> DataFrame:
    """Writes the ids of all rows in ascending id order and returns (bucket, name, total) of the files.

    The order is cut into runs at quantiles of the ids (only those reach the driver), an id of very many rows at quantiles
    of their texts' hashes; each run is one file, and texts cross the network once, compressed. Null texts hold the end id alone; null ids come first; rows with
    equal ids follow each other in the order of their texts' hashes, repeated rows in any order, for they are equal. A
    long text is one document, written batch by batch; an empty table makes no file; other columns are not read. ``width`` is
    the bytes of an id; a vocabulary that does not fit in them is an error.
    """
    spark = df.sparkSession
    if (top := max(library_encoder(path, spaced).top, end_id)) >> 8 * width:
        raise ValueError(f"ids up to {top} do not fit in {width} bytes")
    parts = shuffle_parts(spark)
    runs = Runs(order_runs(df, id_col, text_col, 4 * parts))
    sent = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), ("blob", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).cast(pa.int64())
            at = runs.of(keys.fill_null(NULL_KEY).to_numpy(zero_copy_only=False), b.column(2).to_numpy())
            yield batch(sent, [pa.array(at.astype(np.int32)), keys, b.column(2), [common.pack(t.as_py()) for t in b.column(1)]])

    done = pa.schema([("bucket", pa.int32()), ("name", pa.string()), ("total", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("tokenfile")
        encode, tail = library_encoder(path, spaced), np.array([end_id], "<u4")
        current, out = None, None
        for b in batches:
            for bucket, key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != current:
                    if out:
                        out.close()
                        yield batch(done, [[current], [f"run-{current:07d}"], [out.total]])
                    current, out = bucket, Writer(where, f"run-{bucket:07d}", length, rows, width)
                out.add(key, np.concatenate([np.frombuffer(encode(common.unpack(blob.as_py())), "<u4"), tail]))
        if out:
            out.close()
            yield batch(done, [[current], [f"run-{current:07d}"], [out.total]])

    ordered = map_batches(df.select(id_col, text_col, tie_of(text_col)), send, "bucket int, key long, tie long, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "tie")
    return cut(map_batches(ordered.select("bucket", "key", "blob"), save, "bucket int, name string, total long"))


def read(files: DataFrame, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files. ``start`` counts the ids of all
    documents before, over all files; the driver sums one number a file for it."""
    spark = files.sparkSession
    listed = sorted((r["bucket"], r["name"], r["total"]) for r in files.collect())
    base, at = {}, 0
    for _, name, total in listed:
        base[name], at = at, at + total
    schema = pa.schema([*DOCS, ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                reader = Reader(where, name)
                for docs in reader.documents():
                    crc = [zlib.crc32(reader.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)]
                    yield batch(schema, [docs.column(0), pa.array(docs.column(1).to_numpy() + base[name]), docs.column(2), crc])

    names = files.select("name").repartition(shuffle_parts(spark))
    return map_batches(names, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, end_id: int, length: int = 2048, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files of ``df`` under the shared folder and reads them back."""
    where = f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(df, path, end_id, where, length, width=width, id_col=id_col, text_col=text_col), where).withColumnRenamed("doc_id", id_col)
