"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 letters, words kept apart by a
space). Every language has several centroids, found by spherical k-means; the language of the centroid with
the largest cosine is predicted. A text is rejected if even that cosine is well below what the language's
own training texts reach; the few n-grams of a short text cannot come near a centroid, so less is asked of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import batch, map_batches, mix64

DIMENSIONS = 4096
#: Texts with fewer different n-grams than this are rejected at smaller cosines only.
FULL = 600
_APART = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 19


def grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text, block by block; None if it has no letter."""
    letters = _APART.sub(" ", text.lower()).strip()
    if next(filter(str.isalpha, letters), None) is None:
        return None
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIMENSIONS, np.int64)
    for lo in range(0, len(points), _BLOCK):
        a = points[lo : lo + _BLOCK + 2].astype(np.uint64)
        n = min(_BLOCK, len(points) - lo)
        h = a.copy()
        for size in (1, 2, 3):
            if size > 1:
                h = h[: len(a) - size + 1] * np.uint64(0x1FFFFF) + a[size - 1 :]
            counts += np.bincount((mix64(h[:n]) & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def reach(counts: np.ndarray) -> float:
    """How near a text of so many different n-grams can come to a dense centroid, as a share."""
    return float(min(1.0, np.sqrt(np.count_nonzero(counts) / FULL)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # of each centroid
    floor: np.ndarray  # of each language: smaller cosines are rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; ("und", 0, True) if it is null or has no letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        found = [(i, c) for i, t in enumerate(texts) if t and (c := grams(t)) is not None]
        if found and self.languages:
            near = self.vectors(np.array([c for _, c in found], np.float32)) @ self.centroids.T
            for (i, c), row in zip(found, near, strict=True):
                k = int(row.argmax())
                own = int(self.owner[k])
                out[i] = (self.languages[own], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.floor[own] * reach(c)))
        return out


def _clusters(x: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from far-apart starts."""
    picked = [int((x @ _unit(x.mean(0))).argmax())]
    while len(picked) < min(most, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.array([_unit(x[at == k].mean(0)) if (at == k).any() else c[k] for k in range(len(c))], np.float32)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    return c[sizes >= max(1, len(x) // 50)] if len(c) > 1 else c


def fit(docs: DataFrame, sample_rows: int = 2000, clusters: int = 4, reject_share: float = 0.6, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns from the rows of ``docs`` with a language, of which at most about ``sample_rows`` are used.

    The sample has about equally many rows of every language, chosen by a hash of the id; at most twice
    ``sample_rows`` come to the driver, as counts of fixed size. A text is rejected below ``reject_share`` of
    the cosine which 99 in 100 training texts of its predicted language reach.
    """
    known = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    # rows are counted without reading their texts
    sizes = {r["l"]: r["count"] for r in docs.select(F.col(lang_col).alias("l")).where("l is not null").groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample_rows).collect()}
    if not sizes:
        return Model([], np.ones(DIMENSIONS, np.float32), np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64), np.empty(0))
    quota = max(1, sample_rows // len(sizes))
    draw = F.pmod(F.xxhash64("k", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.coalesce(F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, quota / n))])[F.col("l")], F.lit(0.0))
    schema = pa.schema([("k", pa.int64()), ("l", pa.string()), ("c", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, l, c.astype(np.float32).tobytes()) for k, l, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if (c := grams(t)) is not None]
            if rows:
                yield batch(schema, list(zip(*rows, strict=True)))

    drawn = map_batches(known.where(draw < chance), run, "k long, l string, c binary").orderBy(F.xxhash64("k", F.lit("draw")), "k").limit(2 * sample_rows)
    rows = sorted((r["l"], r["k"] if r["k"] is not None else -1, bytes(r["c"])) for r in drawn.collect())
    counts = np.array([np.frombuffer(c, np.float32) for *_, c in rows], np.float32).reshape(len(rows), DIMENSIONS)
    langs = np.array([l for l, *_ in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.2)
    model = Model([], idf, np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64), np.empty(0))
    x = model.vectors(counts)
    centroids, owner, floor = [], [], []
    for lang in sorted(set(langs.tolist())):
        own = x[langs == lang]
        c = _clusters(own, clusters)
        owner += [len(model.languages)] * len(c)
        centroids.append(c)
        share = np.array([reach(v) for v in counts[langs == lang]])
        floor.append(reject_share * float(np.quantile((own @ c.T).max(1) / share, 0.01)))
        model.languages.append(lang)
    model.centroids, model.owner, model.floor = np.concatenate(centroids or [model.centroids]), np.array(owner, np.int64), np.array(floor)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row: map-only. Null texts and texts without a letter are
    ``und`` with score 0 and count as rejected; without any learned language all texts are. A long text is counted whole,
    block by block; repeated rows and ids give a row each, a null id a null id; an empty table gives none; other columns are not
    read. Of centroids that are equally near the first counts, by order of language."""
    schema = pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("langid")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield batch(schema, [part.column(0).cast(pa.int64()), *zip(*model.predict(part.column(1).to_pylist()), strict=True)])

    return map_batches(df.select(id_col, text_col), run, f"{id_col} long, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text is not rejected; as ``predict`` for nulls, long, empty and
    repeated ones."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("langid")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield part.filter(pa.array([not r for *_, r in model.predict(part.column(place).to_pylist())]))

    return map_batches(df, run, df.schema)
