"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null key where rows are put in key order: nulls are the smallest.
NULL_KEY = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str, few: int = 32) -> DataFrame:
    """A table. One of a few splits, a few GB at most, is dealt to all cores; larger ones are read as they are split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(few, cores) else df


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_task(df: DataFrame, *keys: str):
    """Rows grouped by ``keys`` for a Python function that takes long for its bytes: in as many tasks as a shuffle has
    partitions, which adaptive execution would join to a few large ones."""
    return df.repartition(shuffle_parts(df.sparkSession), *keys).groupBy(*keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, local sessions (tests) get a
    temporary one; a cluster without it is an error, for its nodes share no local folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            named = tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that a lost executor never replays what made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def pack(text: str | None) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress((text or "").encode("utf-8", "surrogatepass"))


def unpack(blob: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")


def tie_of(text: str) -> Column:
    """Orders rows of equal keys by their texts; a null text is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Runs:
    """Runs that the order of rows by (key, tie) is cut into: run k ends with (keys[k], ties[k]), or with all rows of
    keys[k] where that tie is ``ALL``."""

    ALL = (1 << 63) - 1

    def __init__(self, ends: list[tuple[int, int]]):
        self.keys, self.ties = (np.array([e[i] for e in ends], np.int64) for i in range(2))

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        found, end = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        for i in np.flatnonzero(end > found).tolist():
            found[i] += np.searchsorted(self.ties[found[i] : end[i]], ties[i], "left")
        return found

    def ends(self, k: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Which rows are at the end of their runs ``k``; the last run has no end."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(k, len(self.keys) - 1)
        return (k < len(self.keys)) & (self.keys[at] == keys) & ((self.ties[at] == ties) | (self.ties[at] == self.ALL))


def order_runs(df: DataFrame, key: str, text: str, runs: int) -> list[tuple[int, int]]:
    """Ends of about ``runs`` equal runs of the order by (``key``, ``tie_of(text)``), ascending; each occurs. Only quantiles
    and at most ``runs`` ends reach the driver. A key that holds several runs is cut by quantiles of its ties (not one beyond
    2 ** 53), in two more passes over its rows. Quantiles are double precision, so where keys or ties are
    beyond it the last row of each run is looked up."""
    if runs < 2:
        return []
    keyed, tie = F.coalesce(F.col(key), F.lit(NULL_KEY)), tie_of(text)
    found = df.agg(F.percentile_approx(keyed, [i / runs for i in range(1, runs)], 20 * runs).alias("b")).first()
    held = Counter(found["b"] or [])
    ends = [(k, Runs.ALL) for k in sorted(held)]
    if hot := [k for k, n in held.items() if n > 1]:
        most = max(held.values())
        cuts = F.percentile_approx(tie, [i / most for i in range(1, most)], 20 * most)
        for r in df.where(keyed.isin(hot)).groupBy(keyed.alias("k")).agg(cuts.alias("cuts")).collect():
            ends += {(r["k"], r["cuts"][round(i * most / held[r["k"]]) - 1]) for i in range(1, held[r["k"]])}
        return _last_of_runs(df.select(keyed.alias("key"), tie.alias("tie")), Runs(sorted(ends)))
    if any(abs(k) > 1 << 53 for k in held):
        return [(k, Runs.ALL) for k, _ in _last_of_runs(df.select(keyed.alias("key"), F.lit(0).cast("long").alias("tie")), Runs(ends))]
    return ends


def _last_of_runs(rows: DataFrame, about: Runs) -> list[tuple[int, int]]:
    """The largest (key, tie) that occurs in each run that has rows."""
    schema = pa.schema([("run", pa.int64()), ("key", pa.int64()), ("tie", pa.int64())])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((ties, keys))
            own = about.of(keys, ties)[order]
            last = order[np.flatnonzero(np.append(own[1:] != own[:-1], True))] if len(own) else order
            yield batch(schema, [about.of(keys[last], ties[last]), keys[last], ties[last]])

    found = map_batches(rows, largest, "run long, key long, tie long").groupBy("run").agg(F.max(F.struct("key", "tie")).alias("last")).collect()
    return sorted((r["last"]["key"], r["last"]["tie"]) for r in found)


class Sets:
    """Union-find over 0 .. n - 1; the smallest member stands for a set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, k: int) -> None:
        i, k = self.of(i), self.of(k)
        if i != k:
            self.up[max(i, k)] = min(i, k)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not found:
        return
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    sets = Sets(len(nodes))
    for i, k in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        sets.join(i, k)
    root = nodes[np.fromiter(map(sets.of, range(len(nodes))), np.int64, len(nodes))]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_edges: int = 1_000_000, most_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest id that the undirected edges reach, for every id that has an edge to another.

    Randomised contraction (Boegeholz, Brand and Todor 2020): in a round every node becomes the least of its
    closed neighbourhood in a random order that is new in each round, which leaves at most about three
    quarters of the nodes; components that are one node have no edges left. Once at most ``most_edges``
    edges are left (16 bytes each, whatever the input), one task finishes by union-find. No neighbour list
    is gathered: minima are partial aggregates, and joins are between stored tables, so that adaptive
    execution can split a hub's rows. No edges give no rows.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    e, rounds = cut(edges.select(*pair(F.col(a), F.col(b))).where("u <> v").distinct()), []
    while e.count() > most_edges:
        if len(rounds) == most_rounds:
            raise RuntimeError("components did not settle")
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: E731, B023
        both = e.union(e.select("v", "u"))
        near = both.groupBy("u").agg(F.min(F.struct(order("v").alias("h"), "v")).alias("m"))
        near = cut(near.select(F.col("u").alias("node"), F.when(order("u") < F.col("m.h"), F.col("u")).otherwise(F.col("m.v")).alias("rep")))
        left = e.join(near.select(F.col("node").alias("u"), F.col("rep").alias("ru")), "u").select("ru", "v")
        e = cut(left.join(near.select(F.col("node").alias("v"), F.col("rep").alias("rv")), "v").select(*pair(F.col("ru"), F.col("rv"))).where("u <> v").distinct())
        rounds.append(near)
    found = cut(e.coalesce(1).mapInArrow(_finish, "node long, component long"))
    for near in reversed(rounds):
        found = cut(near.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component")))
    if rounds:  # a random node stands for a component; its smallest is to
        low = cut(found.groupBy("component").agg(F.min("node").alias("low")))
        found = found.join(low, "component").select("node", F.col("low").alias("component"))
    return found


def rename(system: fs.FileSystem, temp: str, final: str) -> None:
    """Gives a finished file its name; a file that an earlier attempt left under it goes."""
    try:
        system.move(temp, final)
    except OSError:
        system.delete_file(final)
        system.move(temp, final)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def join_weighted(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 256) -> DataFrame:
    """Rows of ``left`` with the one row of ``right`` that has their key. ``weight`` says how many of ``total`` rows have a key: keys with a
    ``share``-th of them or more (so at most ``share``) are broadcast, and no task of the join of the others gets more than such a part
    for a key. ``left`` is read twice. Rows whose key is missing or null fall away."""
    heavy = F.col(weight) * share >= total
    few = F.broadcast(right.where(heavy))
    rest = left.join(F.broadcast(right.where(heavy).select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(right.where(~heavy), keys))


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table written in the shared folder."""
    where = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)
