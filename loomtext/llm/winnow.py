"""Winnowing fingerprints (Schleimer, Wilkerson and Aiken 2003).

Rolling hashes of all k-grams of code points; of every ``window`` successive hashes the smallest is chosen,
the rightmost among equals, and kept with its position. Any passage of ``window + k - 1`` code points that two
texts share contributes at least one common hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import NULL_KEY, Runs, batch, map_batches, mix64, order_runs, shuffle_parts, tie_of

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
                cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """One hash a k-gram, rolled with prefix sums: each block costs a few passes whatever k is."""
    out = []
    for lo in range(0, len(points) - k + 1, _BLOCK):
        own = points[lo : lo + _BLOCK + k - 1].astype(np.uint64) + np.uint64(1)
        up, down = _Powers.of(len(own))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up, dtype=np.uint64)])
            out.append(mix64((sums[k:] - sums[:-k]) * down[: len(own) - k + 1]))
    return np.concatenate(out)


def fingerprint(text: str, k: int = 24, window: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, in text order.

    A text shorter than k has one hash, of all of it; one with fewer than ``window`` k-grams has the smallest
    of them; the empty text has none.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    if len(points) < k:
        return np.array([xxhash.xxh32_intdigest(points.tobytes())], np.uint32), np.zeros(1, np.uint32)
    h = _gram_hashes(points, k)
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # the smallest is the rightmost smallest hash
    window, size = min(window, len(h)), 1
    while 2 * size <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < window:
        m = np.minimum(m[: len(m) - (window - size)], m[window - size :])
    chosen = m[np.concatenate([[True], m[1:] != m[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.uint32)


def as_text(found: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hexadecimal digits a choice: 8 of the hash, 8 of the position."""
    pair = np.empty((len(found[0]), 2), ">u4")
    pair[:, 0], pair[:, 1] = found
    return pair.tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the hash sets: 1 for equal texts, also for two empty ones."""
    x, y = np.unique(a[0]), np.unique(b[0])
    if not len(x) and not len(y):
        return 1.0
    common_n = len(np.intersect1d(x, y, assume_unique=True))
    return common_n / (len(x) + len(y) - common_n)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 24, window: int = 41) -> DataFrame:
    """(id, fingerprint) for every row: binary, as ``as_text`` without the hexadecimal digits. Map-only; a
    null text is the empty text."""
    schema = pa.schema([(id_col, pa.int64()), ("fingerprint", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [b.column(0).cast(pa.int64()), [bytes.fromhex(as_text(fingerprint(t.as_py() or "", k, window))) for t in b.column(1)]])

    return map_batches(df.select(id_col, text_col), run, f"{id_col} long, fingerprint binary")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 24, window: int = 41) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text.

    The next document is the one below in descending id order; the first follows the last. The edited text has
    its last third replaced by the start of the next. Null texts are empty; null ids come last; rows with equal
    ids follow each other in the order of their texts' hashes, repeated rows in any order, for they are equal; a table of
    one row is followed by itself, an empty one gives no rows. A long text is fingerprinted whole, block by block. Of equal
    hashes in a window the rightmost is chosen. Other columns are not read.

    The order is cut into runs at quantiles of the ids, an id of very many rows at quantiles of their texts' hashes.
    Texts cross the network once, compressed, and the first row after each run is sent to that run too, so no task sees
    more than its runs and no window spans all rows.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    top = df.agg(F.max(F.coalesce(F.col(id_col), F.lit(NULL_KEY)))).first()[0]
    ends = order_runs(df, id_col, text_col, 4 * parts) if top is not None else []
    start = Runs([ends.pop() if ends and ends[-1][0] == top else (top or 0, Runs.ALL)])  # ends with the first row of all
    order = Runs(ends)
    sent = pa.schema([("run", pa.int32()), ("after", pa.bool_()), ("key", pa.int64()), ("is_null", pa.bool_()), ("tie", pa.int64()), ("blob", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties = b.column(0).cast(pa.int64()), b.column(2).to_numpy()
            keys, nulls = ids.fill_null(NULL_KEY).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            own = order.of(keys, ties)
            edge = np.flatnonzero(order.ends(own, keys, ties))
            first = np.flatnonzero(start.ends(np.zeros(len(keys), np.int64), keys, ties))
            rows = np.concatenate([np.arange(len(keys)), edge, first])
            runs = np.concatenate([own, own[edge] + 1, np.zeros(len(first), np.int64)]).astype(np.int32)
            after = np.arange(len(rows)) >= len(keys)
            blobs = [common.pack(t.as_py()) for t in b.column(1)]
            yield batch(sent, [runs, after, keys[rows], nulls[rows], ties[rows], [blobs[i] for i in rows.tolist()]])

    out = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is to come
        rows: list[tuple] = []
        for b in batches:
            for run, after, key, null, blob in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if held is not None and held[0] == run:
                    text = common.unpack(blob.as_py())
                    found = fingerprint(text, k, window)
                    _, own_key, own, own_found = held
                    n = len(own) // 3
                    edited = own[: len(own) - n] + text[:n] if n else own
                    other = fingerprint(edited, k, window)
                    rows.append((own_key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_found), as_text(other), likeness(own_found, other), likeness(own_found, found)))
                    held = None if after else (run, None if null else key, text, found)
                elif not after:
                    text = common.unpack(blob.as_py())
                    held = (run, None if null else key, text, fingerprint(text, k, window))
                if len(rows) >= 256:
                    yield batch(out, list(zip(*rows, strict=True)))
                    rows = []
        if rows:
            yield batch(out, list(zip(*rows, strict=True)))

    ordered = (
        map_batches(df.select(id_col, text_col, tie_of(text_col)), send, "run int, after boolean, key long, is_null boolean, tie long, blob binary")
        .repartition(parts, "run")
        .sortWithinPartitions("run", "after", F.desc("key"), F.desc("tie"))
        .select("run", "after", "key", "is_null", "blob")
    )
    return map_batches(ordered, compare, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
