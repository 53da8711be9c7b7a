"""Compression of vectors to codes: a small codebook for each of a few parts of the vector.

Components are made integers first. Vectors that have a part in common share its work: equal parts at a position become one row with a
weight, and the rounds of Lloyd's algorithm run over these rows. Codes and errors are joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, join_weighted, map_batches

#: Integers of components are held within this, so that no sum or squared distance leaves 64 bits.
LARGEST = 1 << 27


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, vec_id, label, ints) of the vectors without null or non-finite components: floor(scale * x) as little-endian 32-bit integers, one
    after another. Rows have numbers of their own, kept by a checkpoint."""
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("ints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            at = v.offsets.to_numpy() - v.offsets[0].as_py()
            whole = np.clip(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST).astype("<i4").tobytes()
            yield batch(schema, [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), [whole[4 * i : 4 * k] for i, k in zip(at[:-1], at[1:], strict=True)]])

    found = map_batches(rows, run, "vec_id long, label string, ints binary")
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "ints"))


def as_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Every vector's parts: (row, vec_id, label, position, part). Vectors are filled up with zeros to ``parts * width`` components."""
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("position")
    zeros = bytes(4 * parts * width)
    filled = vectors.select("row", "vec_id", "label", F.substring(F.concat("ints", F.lit(zeros)), 1, len(zeros)).alias("ints"), at)
    return filled.select("row", "vec_id", "label", "position", F.expr(f"substring(ints, position * {4 * width} + 1, {4 * width})").alias("part"))


def _read(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").astype(np.int64).reshape(-1, width)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and its squared distance, the lower index among equals."""
    best, least = np.zeros(len(points), np.int64), None
    for k, e in enumerate(entries):
        off = points - e
        far = np.einsum("ij,ij->i", off, off)
        if least is None:
            least = far
        else:
            closer = far < least
            best[closer], least = k, np.minimum(least, far)
    return best, least


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(position, entry, component, total, n): weighted sums of the parts that are nearest to each entry. A task gives one set of sums."""
    parts, entries, width = books.shape
    schema = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("component", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            (at, points), weight = _read(b, width), b.column(2).to_numpy()
            for p in np.unique(at):
                own = at == p
                best, _ = nearest(points[own], books[p])
                np.add.at(totals[p], best, points[own] * weight[own, None])
                np.add.at(n[p], best, weight[own])
        p, e, c = (x.ravel() for x in np.indices(totals.shape, np.int32))
        used = n[p, e] > 0
        yield batch(schema, [p[used], e[used], c[used], totals.ravel()[used], n[p, e][used]])

    found = map_batches(distinct.select("position", "part", "n"), run, "position int, entry int, component int, total long, n long")
    return found.groupBy("position", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after ``rounds``. A round brings one integer a component of the codebooks to the driver,
    whatever the number of vectors. An entry that no part is nearest to stays."""
    for _ in range(rounds):
        books = books.copy()
        for r in _sums(distinct, books).collect():
            books[r["position"], r["entry"], r["component"]] = r["total"] // r["n"]
    return books


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(position, part, n, entry, error) of every distinct part."""
    width = books.shape[2]
    schema = pa.schema([("position", pa.int32()), ("part", pa.binary()), ("n", pa.int64()), ("entry", pa.int64()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, points = _read(b, width)
            best, error = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for p in np.unique(at):
                own = at == p
                best[own], error[own] = nearest(points[own], books[p])
            yield batch(schema, [b.column(0), b.column(1).cast(pa.binary()), b.column(2), best, error])

    return map_batches(distinct.select("position", "part", "n"), run, "position int, part binary, n long, entry long, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error), and the codebooks (parts, entries, width) of integers. A code has two hexadecimal digits a part.

    Vectors that are null or hold null or non-finite components are dropped. The codebooks start as the parts of the vectors with the
    smallest ids (nulls last, equal ids by their integers), fewer where there are fewer vectors. Repeated rows are rows each and weigh as many.
    Vectors are as long as the one with the smallest id that is not empty; what has another length has a null code and error
    and no say. A length that ``parts`` does not divide is filled up with zeros. Components of 2^27 / scale or more count as that bound. ``label_error`` sums
    the errors of all rows with one label, nulls together. An empty table gives no rows. Other columns are not read.

    At most 256 parts a position and 256 labels (those with 1/256 of all rows or more) are broadcast, all others are joined by shuffles, so a value that
    a third of the vectors share burdens no task.
    """
    vectors = integers(df, id_col, vector_col, label_col, scale)
    order = [F.col("vec_id").asc_nulls_last(), "ints"]
    first = vectors.where(F.octet_length("ints") > 0).orderBy(*order).limit(1).select("ints").collect()
    length = len(first[0]["ints"]) // 4 if first else 0
    width = -(-length // parts)
    alike = vectors.where((F.octet_length("ints") == 4 * length) & F.lit(length > 0))
    seeds = [np.frombuffer(r["ints"], "<i4").astype(np.int64) for r in alike.orderBy(*order).limit(entries).select("ints").collect()]
    books = np.zeros((parts, len(seeds), width), np.int64)
    for e, s in enumerate(seeds):
        books[:, e] = np.pad(s, (0, parts * width - length)).reshape(parts, width)
    out = vectors.where((F.octet_length("ints") != 4 * length) | F.lit(length == 0)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if seeds:
        cells = as_parts(alike, parts, width)
        distinct = cut(cells.groupBy("position", "part").agg(F.count("*").alias("n")))
        books = lloyd(distinct, books, rounds)
        total = alike.count()
        found = join_weighted(cells, cut(_coded(distinct, books)), ["position", "part"], "n", total)
        digits = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))))), 2, "0") for p in range(parts)])
        out = out.unionByName(found.groupBy("row", "vec_id", "label").agg(digits.alias("code"), F.sum("error").alias("error")).drop("row"))
    name = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    out = cut(out.select("vec_id", "code", "error", name.alias("name")))
    sums = cut(out.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = sums.agg(F.sum("n")).first()[0] or 0
    return join_weighted(out, sums, ["name"], "n", rows).select("vec_id", "code", "error", "label_error"), books
