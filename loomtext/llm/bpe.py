"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: one probe tells whether a whole pre-token is a
vocabulary entry and what its rank is. Tier two merges the bytes of a miss: a heap of candidate merges
(lowest rank first, leftmost among equals) over a linked list of byte spans.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .chunks import Remembered, SpacedEncoder
from .common import batch, map_batches


class PerfectHash:
    """A minimal perfect hash of distinct byte strings (hash and displace): ``get`` probes one slot."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("the keys are not distinct")
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        taken = np.zeros(n, bool)
        self.shift = [0] * self.buckets
        place = [0] * n
        tries = np.arange(4096, dtype=np.uint64)
        lone = []
        for bucket, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                lone.append((bucket, own[0]))
                continue
            h = np.array([hashes[i] >> 20 for i in own], np.uint64)
            base, width = 0, 16
            while True:
                d = tries[:width] + np.uint64(base)
                slots = self._slots(h[None, :], d[:, None])
                ordered = np.sort(slots, axis=1)
                good = ~(taken[slots].any(axis=1) | (ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
                if good.any():
                    k = int(good.argmax())
                    self.shift[bucket] = base + k
                    taken[slots[k]] = True
                    for i, s in zip(own, slots[k].tolist(), strict=True):
                        place[i] = s
                    break
                base, width = base + width, min(4 * width, len(tries))
        for (bucket, i), s in zip(lone, np.flatnonzero(~taken).tolist(), strict=False):
            self.shift[bucket] = -s - 1  # a bucket of one names its slot
            place[i] = s
        self.keys: list[bytes] = [b""] * n
        self.values = [-1] * n
        for i, s in enumerate(place):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slots(self, h, d):
        return ((h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)) % np.uint64(self.n)

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else ((((h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {r: t for t, r in ranks.items()}
        self.known = PerfectHash(list(ranks), list(ranks.values()))
        self.rank = Remembered(self.known.get, most=200_000)
        self.split = regex.compile(pattern).findall
        self.pretoken = Remembered(self._pretoken)
        self.whole = SpacedEncoder(lambda s: b"".join(map(self.pretoken.__getitem__, self.split(s))), self._pretoken, most=500_000)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def _pretoken(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        found = self.known.get(raw)
        return np.array([found] if found is not None else self.merge(raw), "<u4").tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes that are no vocabulary entry as a whole."""
        n, rank = len(raw), self.rank
        end = list(range(1, n + 1))  # of the span that starts here; 0: swallowed by the span on its left
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank[raw[i : i + 2]]) is not None]
        heapify(heap)
        while heap:
            _, i, j, k = heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := rank[raw[i : end[k]]]) is not None:
                    heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := rank[raw[h:k]]) is not None:
                heappush(heap, (r, h, i, k))
        ids, i = [], 0
        while i < n:
            ids.append(rank[raw[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.whole(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.load(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) for every row.

    ``ids`` is binary (little-endian unsigned 32-bit). The pass is map-only. A null text is the empty text: no
    ids, and the digests of nothing. Repeated rows give repeated rows, an empty table none; other columns are not read; of equal
    merges the leftmost is first, as in the library. A long text is encoded whole, part by part; one of a single very long
    pre-token costs n log n.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("bpe")
        bpe = loaded(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield batch(schema, [part.column(0).cast(pa.int64()), [len(x) // 4 for x in ids], ids, [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]])

    return map_batches(df.select(id_col, text_col), run, f"{id_col} long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
