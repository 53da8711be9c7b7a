"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to overlapping regions: the nearest centroids of a bounded sample and, where more regions are needed than that
gives, in each the nearest of a second set of centroids, of what is left when the first is taken away. So regions
grow in number with the rows, and what every task is sent stays small. A region with many rows is cut
into blocks, and every pair of its blocks is one task. In a task the vectors are clustered again with overlap, a
graph is built on each cluster by robust pruning (Subramanya et al. 2019), and the adjacency lists are
united into one flat graph. Every query walks it greedily from the clusters' medoids and, where it
comes into range, expands through all neighbours in range. Cosines are verified in double precision.

Recall is audited twice. In every task some queries are held against brute force; a task that falls short searches
again from more entry points and at last compares all. And some queries are held against all vectors, whatever
their regions; a result that has lost too much is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_task, components, cut, map_batches

_CHUNK = 1 << 15


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Unit centroids; starts are rows drawn by a fixed seed."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the ``most`` nearest centroids of every row, ascending."""
    most = min(most, len(c))
    near = x @ c.T
    return np.sort(np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(c) else np.broadcast_to(np.arange(len(c)), (len(x), len(c))), axis=1)


class Regions:
    """Overlapping regions of one vector length: ``first`` centroids and, if there are, ``second`` ones of the rests."""

    def __init__(self, sample: np.ndarray, wanted: int, overlap: int, most: int):
        most = min(most, max(1, len(sample) // 2))
        self.overlap, self.second = overlap, None
        self.first = kmeans(sample, min(wanted, most))
        if wanted > most:
            rest = sample - self.first[(sample @ self.first.T).argmax(1)]
            self.second = _means(rest, min(most, -(-wanted // len(self.first))))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the regions of every row, ascending."""
        return np.concatenate([self._of(x[lo : lo + 1024]) for lo in range(0, len(x), 1024)])

    def _of(self, x: np.ndarray) -> np.ndarray:
        near = nearest(x, self.first, self.overlap)
        if self.second is None:
            return near
        k = min(self.overlap, len(self.second))
        size = (self.second**2).sum(1)
        out = []
        for column in near.T:
            rest = x - self.first[column]
            far = size - 2 * (rest @ self.second.T)
            own = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(self.second) else np.broadcast_to(np.arange(k), (len(x), k))
            out.append(column[:, None] * len(self.second) + own)
        return np.sort(np.concatenate(out, axis=1), axis=1)


def _means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Centroids by distance."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=len(c))[:, None]
        np.add.at(sums, at, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class FlatGraph:
    """Directed graph over unit vectors; ``entries`` reach every node."""

    def __init__(self, x: np.ndarray, degree: int = 16, cluster: int = 400, alpha: float = 1.2, seed: int = 11):
        self.x, n = x, len(x)
        k = max(1, -(-2 * n // cluster))
        heads: list[np.ndarray] = []
        tails: list[np.ndarray] = []
        medoids: list[int] = []
        c = kmeans(x, k, seed=seed)
        member = nearest(x, c, 2)
        for j in range(len(c)):
            own = np.flatnonzero((member == j).any(axis=1))
            if not len(own):
                continue
            medoids.append(int(own[(x[own] @ c[j]).argmax()]))
            if len(own) > 1:
                a, b = self._pruned(x[own], degree, alpha)
                heads += [own[a], own[b]]  # with the reverse edges
                tails += [own[b], own[a]]
        edge = np.unique(np.concatenate(heads) * n + np.concatenate(tails)) if heads else np.empty(0, np.int64)
        self.head, self.tail = np.divmod(edge, n)
        self.first = np.searchsorted(self.head, np.arange(n + 1))
        self.entries = self._reaching(sorted(set(medoids)))

    @staticmethod
    def _pruned(x: np.ndarray, degree: int, alpha: float, candidates: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Robust pruning of every row's nearest candidates: the nearest stays and rules out those that are
        much closer to it than to the row, and so on."""
        n = len(x)
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        m = min(candidates, n - 1)
        picked = np.argpartition(-near, m - 1, axis=1)[:, :m]
        picked = np.take_along_axis(picked, np.argsort(-np.take_along_axis(near, picked, 1), axis=1, kind="stable"), 1)
        np.fill_diagonal(near, 1.0)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * np.take_along_axis(near, picked, 1)))
        alive = np.ones((n, m), bool)
        rows = np.arange(n)
        heads, tails = [], []
        for _ in range(min(degree, m)):
            k = alive.argmax(axis=1)
            some = alive[rows, k]
            if not some.any():
                break
            p = picked[rows, k]
            heads.append(rows[some])
            tails.append(p[some])
            between = np.sqrt(np.maximum(0.0, 2 - 2 * near[p[:, None], picked]))
            alive &= alpha * between > far
            alive[rows, k] = False
        return np.concatenate(heads), np.concatenate(tails)

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges out of ``nodes``, as (position in ``nodes``, neighbour)."""
        counts = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(np.arange(len(nodes)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, self.tail[self.first[nodes][at] + offset]

    def _reaching(self, entries: list[int]) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        frontier, out = np.array(entries, np.int64), list(entries)
        while True:
            seen[frontier] = True
            while len(frontier):
                frontier = np.unique(self.neighbours(frontier)[1])
                frontier = frontier[~seen[frontier]]
                seen[frontier] = True
            rest = np.flatnonzero(~seen)
            if not len(rest):
                return np.array(out, np.int64)
            out.append(int(rest[0]))
            frontier = rest[:1]

    def _cosines(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for lo in range(0, len(a), _CHUNK):
            own = slice(lo, lo + _CHUNK)
            out[own] = np.einsum("ij,ij->i", q[a[own]], self.x[b[own]])
        return out

    def in_range(self, q: np.ndarray, least: float, starts: int = 4, own: np.ndarray | None = None, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with a cosine of ``least`` or more. ``own``: a node for each
        query from which its search starts as well."""
        n, found_q, found_n = len(self.x), [], []
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            near = part @ self.x[self.entries].T
            s = min(starts, len(self.entries))
            at = self.entries[np.argpartition(-near, s - 1, axis=1)[:, :s]] if s < len(self.entries) else np.broadcast_to(self.entries, (len(part), s))
            if own is not None:
                at = np.concatenate([at, own[lo : lo + 512, None]], axis=1)
            who = np.repeat(np.arange(len(part)), at.shape[1])
            node = at.ravel().copy()
            best = self._cosines(part, who, node)
            moving = np.arange(len(node))
            while len(moving):  # greedy walks, all at once
                k, to = self.neighbours(node[moving])
                if not len(to):
                    break
                cos = self._cosines(part, who[moving][k], to)
                order = np.lexsort((cos, k))
                last = order[np.concatenate([k[order][1:] != k[order][:-1], [True]])]
                better = cos[last] > best[moving[k[last]]]
                walk = moving[k[last]][better]
                node[walk], best[walk] = to[last][better], cos[last][better]
                moving = walk
            seen = np.zeros(len(part) * n, bool)
            key = np.unique(who * n + node)
            seen[key] = True
            while len(key):  # expansion through what is in range
                a, b = np.divmod(key, n)
                cos = self._cosines(part, a, b)
                hit = cos >= least
                found_q.append(a[hit] + lo)
                found_n.append(b[hit])
                wide = cos >= least - slack
                k, to = self.neighbours(b[wide])
                key = np.unique(a[wide][k] * n + to)
                key = key[~seen[key]]
                seen[key] = True
        return np.concatenate(found_q or [np.empty(0, np.int64)]), np.concatenate(found_n or [np.empty(0, np.int64)])


def links(x: np.ndarray, y: np.ndarray | None, least: float, audited: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine ``least`` or more; without ``y`` pairs i < j within x."""
    graph = FlatGraph(x)
    q, own = (x, np.arange(len(x))) if y is None else (y, None)
    sample = np.unique(np.linspace(0, len(q) - 1, min(audited, len(q))).astype(np.int64))
    true = q[sample] @ x.T >= least
    starts = 4
    while True:
        a, b = graph.in_range(q, least, starts, own)
        got = np.zeros(true.shape, bool)
        place = np.full(len(q), -1)
        place[sample] = np.arange(len(sample))
        on = place[a] >= 0
        got[place[a[on]], b[on]] = True
        if not (true & ~got).any():
            break
        if starts >= 4 * len(graph.entries):  # all entry points were not enough
            found = [np.nonzero(q[lo : lo + 512] @ x.T >= least) for lo in range(0, len(q), 512)]
            a, b = np.concatenate([i + 512 * k for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])
            break
        starts *= 4
    if y is None:
        pairs = np.unique(np.minimum(a, b) * len(x) + np.maximum(a, b))
        i, j = np.divmod(pairs, len(x))
        return i[i != j], j[i != j]
    return b, a


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that the pairs connect to each row."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def recall(vectors: DataFrame, counts: DataFrame, number: type, least: float, queries: int) -> float:
    """Share of the links of some vectors (those of ``queries`` ids, chosen by a hash) that were found, by comparing them with
    all ``vectors`` (id, size, vec). 1 if they have none."""
    drawn = vectors.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(queries).join(counts, "id", "left").select("id", "size", "vec", F.coalesce("n", F.lit(0)).alias("n")).collect()
    own = {size: ([r["id"] for r in drawn if r["size"] == size], unit(np.array([np.frombuffer(r["vec"], number) for r in drawn if r["size"] == size], np.float64))) for size in {r["size"] for r in drawn}}
    seen = pa.schema([("n", pa.int64())])

    def run(batches):
        for b in batches:
            ids, sizes, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            n = 0
            for size, (asked, q) in own.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    x = unit(np.frombuffer(b"".join(vec[int(i)].as_py() for i in at), number).reshape(len(at), size).astype(np.float64))
                    n += int(((q @ x.T >= least) & (np.array(asked)[:, None] != ids[at][None, :])).sum())
            yield batch(seen, [[n]])

    true = map_batches(vectors.select("id", "size", "vec"), run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    return sum(r["n"] for r in drawn) / true if true else 1.0


#: Regions whose numbers of blocks may be broadcast; 16 bytes each.
MOST_CUT = 100_000


def near_duplicates(df: DataFrame, least: float = 0.95, overlap: int = 4, block: int = 1500, sample_rows: int = 4096, most_regions: int = 2048, audited: int = 256, least_recall: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths or rows with a null id. Rows with one id are one vector (the smallest, if they differ). A region's rows
    are spread over blocks of about ``block`` rows by a hash of the id, however many they are. A pair that
    shares several regions counts in the first. An empty table gives no rows; a long vector is taken whole; equal cosines
    need no order; columns besides the two are not read.

    The number of regions follows the rows, up to the square of ``most_regions``; their centroids are fitted on
    ``sample_rows`` vectors, which with ``audited`` queries are all that the driver gets. The links of those queries are held
    against all vectors; less than ``least_recall`` of them found is an error.
    """
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64
    v = F.col("v")
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    valid = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(good).groupBy("id").agg(F.min("v").alias("v"))
    total = valid.count()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = valid.orderBy(F.xxhash64("id", F.lit("draw")), "id").limit(sample_rows).collect()
    by_size: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: r["id"]):
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    regions = {}
    for size, own in by_size.items():
        wanted = -(-overlap * total * len(own) // (len(drawn) * block))
        regions[size] = Regions(unit(np.array(own, np.float64)), max(1, wanted), overlap, most_regions)
    placed = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("regions", pa.list_(pa.int64())), ("vec", pa.binary())])

    def place(batches):
        for b in batches:
            out = [[], [], [], []]
            ids, lists = b.column(0).to_numpy(), b.column(1)
            sizes = np.diff(np.array(lists.offsets))
            flat = np.array(lists.flatten(), number)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                near = regions[size].of(unit(x.astype(np.float64))) if size in regions else np.zeros((len(at), 1), int)
                out[0] += ids[at].tolist()
                out[1] += [size] * len(at)
                out[2] += near.tolist()
                out[3] += [r.tobytes() for r in x]
            yield batch(placed, out)

    spread = cut(map_batches(valid, place, "id long, size int, regions array<long>, vec binary"))
    keyed = spread.select("id", "size", F.explode("regions").alias("region"), "regions", "vec")
    sizes = cut(spread.select("size", F.explode("regions").alias("region")).groupBy("size", "region").count().where(F.col("count") > block).select("size", "region", F.ceil(F.col("count") / block).cast("int").alias("cuts")))
    large = sizes.count()
    if large:
        keyed = keyed.join(F.broadcast(sizes) if large <= MOST_CUT else sizes, ["size", "region"], "left")
    keyed = keyed.withColumn("cuts", F.coalesce("cuts", F.lit(1)) if large else F.lit(1)).withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("cuts")).cast("int"))
    # every pair of blocks of a region is a task: a row goes to as many as its region has blocks
    dealt = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("size", "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "regions", "vec")
    linked = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def search(key, group):
        size, region, i, j = (k.as_py() for k in key)
        group = group.sort_by("id")
        ids = group.column("id").to_numpy()
        own = group.column("own").to_numpy()
        vec = group.column("vec").to_pylist()
        x = unit(np.frombuffer(b"".join(vec), number).reshape(len(ids), size).astype(np.float64))
        shared = np.array(group.column("regions").to_pylist(), np.int64)
        if i == j:
            a, b = links(x, None, least)
        else:
            first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(first) or not len(second):
                return linked.empty_table()
            a, b = links(x[first], x[second], least)
            a, b = first[a], second[b]
        n = np.zeros(len(ids), np.int64)
        for lo in range(0, len(a), _CHUNK):
            p, q = a[lo : lo + _CHUNK], b[lo : lo + _CHUNK]
            both = (shared[p][:, :, None] == shared[q][:, None, :]).any(axis=2)
            here = np.where(both, shared[p], np.iinfo(np.int64).max).min(axis=1) == region
            n += np.bincount(p[here], minlength=len(ids)) + np.bincount(q[here], minlength=len(ids))
        touched = np.unique(np.concatenate([a, b]))
        return pa.table([ids[touched], n[touched], ids[_lowest(len(ids), a, b)][touched]], schema=linked)

    found = cut(by_task(dealt, "size", "region", "i", "j").applyInArrow(search, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    if audited and (share := recall(spread, counts, number, least, audited)) < least_recall:
        raise RuntimeError(f"only {share:.3f} of the links of {audited} vectors were found")
    parts = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = rows.select("id").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
