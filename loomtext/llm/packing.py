"""Packing of tokenized documents into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity are matched greedily, at most two in a sequence
(largest first, each with the largest partner that fits); smaller pieces, largest first, go to the tightest
gap that holds them. Lengths are small integers, so the plan is made on the driver from the number of pieces
of each length, a table no longer than the capacity whatever the input; identical sequences are planned
once with a multiplicity. Pieces then find their slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import batch, cut, map_batches
from .library import library_encoder


def tokenized_pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids with ``end_id`` after them.

    A document of more than ``capacity`` ids is cut into pieces of ``capacity``, of which the first may be
    shorter. A null text is the empty text: one piece that holds the end id alone.
    """
    schema = pa.schema([(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("packing")
        encode, tail = library_encoder(path, True), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = capacity if k else (n - 1) % capacity + 1
                    for c, v in zip(out, (key, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True):
                        c.append(v)
                    at, k = at + length, k + 1
            yield batch(schema, out)

    return map_batches(df.select(id_col, text_col), run, f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``counts`` pieces of each length, as (lengths, how many such sequences)."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths are from 1 to the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    open_by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def leave(gap: int, own: tuple[int, ...], many: int) -> None:
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            insort(gaps, gap)
        open_by_gap[gap].append([own, many])

    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
            k -= 1
        if k < 0:
            leave(capacity - a, (a,), left[a])
            left[a] = 0
            continue
        b = large[k]
        m = left[a] // 2 if a == b else min(left[a], left[b])
        left[a] -= m
        left[b] -= m
        leave(capacity - a - b, (a, b), m)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[s]
        while c:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                q = capacity // s
                if c >= q:
                    leave(capacity - q * s, (s,) * q, c // q)
                if c % q:
                    leave(capacity - c % q * s, (s,) * (c % q), 1)
                break
            gap = gaps[k]
            own, many = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
                gaps.pop(k)
            q = gap // s  # the tightest gap stays the tightest until it can hold no more
            full, rest = (many, 0) if c >= q * many else divmod(c, q)
            if full:
                leave(gap - q * s, own + (s,) * q, full)
            if rest:
                leave(gap - rest * s, own + (s,) * rest, 1)
            if many - full - bool(rest):
                leave(gap, own, many - full - bool(rest))
            c -= q * full + rest
    return [(own, many) for gap in gaps for own, many in open_by_gap[gap]]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of slots; ranks count from 0."""
    found: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for own, many in sequences:
        at = 0
        for n in own:
            r = ranks.get(n, 0)
            first, sequence, offset = found.setdefault(n, [[], [], []])
            first.append(r)
            sequence.append(base)
            offset.append(at)
            ranks[n] = r + many
            at += n
        base += many
    return {n: tuple(np.array(x, np.int64) for x in cols) for n, cols in found.items()}


def best_fit(pieces: DataFrame, capacity: int, id_col: str = "doc_id", salts: int = 64, rows_a_salt: int = 250_000) -> DataFrame:
    """``pieces`` (id, piece, start, length, ...) with sequence_id and offset.

    Ranks are taken within a length and salt, so that a length which many pieces share is numbered by many tasks: by
    ``salts``, and by more where a salt would have over ``rows_a_salt`` rows. The driver gets counts by length and salt: at
    most capacity x ``salts`` rows and one for every ``rows_a_salt`` pieces. Rows that are equal
    in all of id, piece and start may swap places. An empty table gives an empty result.
    """
    def salted(own) -> DataFrame:
        return pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "start"), own).cast("int"))

    def counted(df: DataFrame) -> list[tuple[int, int, int]]:
        return sorted((r["length"], r["_salt"], r["count"]) for r in df.groupBy("length", "_salt").count().collect())

    pieces = cut(pieces)
    ready = salted(F.lit(salts))
    found = counted(ready)
    many: dict[int, int] = {}
    for n, _, c in found:
        many[n] = many.get(n, 0) + c
    own = {n: -(-c // rows_a_salt) for n, c in many.items() if c > salts * rows_a_salt}
    if own:
        ready = salted(F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])[F.col("length")], F.lit(salts)))
        found = counted(ready)
    counts: dict[int, int] = {}
    base: dict[int, np.ndarray] = {}
    for n, salt, c in found:
        base.setdefault(n, np.zeros(own.get(n, salts), np.int64))[salt] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + c
    table = slots(plan(counts, capacity))
    names = pieces.columns
    ranked = ready.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start")).cast("long") - 1)
    k = [names.index("length"), len(names), len(names) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in k)
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                r = base[n][salt[rows]] + rank[rows]
                first, start, place = table[n]
                run_of = np.searchsorted(first, r, "right") - 1
                sequence[rows] = start[run_of] + r - first[run_of]
                offset[rows] = place[run_of]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*names, "_salt", "_rank"), run, schema)


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every document of ``df`` in sequences of
    at most ``capacity`` ids. Null ids are packed as well; null and empty texts hold the end id alone; long texts are cut into
    pieces of ``capacity``; repeated rows are packed each; pieces of equal length are told apart by id, piece and start; an
    empty table gives none; other columns are not read."""
    return best_fit(tokenized_pieces(df, path, capacity, end_id, id_col, text_col), capacity, id_col)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences."""
    total = sum(n * c for n, c in counts.items())
    halves = sum(c for n, c in counts.items() if 2 * n > capacity)
    thirds = sum(c for n, c in counts.items() if 3 * n > capacity)
    return max(-(-total // capacity), halves, -(-thirds // 2))
