"""Near-duplicate texts by order min hash.

The k-mers are shingles of five words, labelled by occurrence. Each sketch of a text takes the few k-mers that a
random order ranks lowest and keeps them in text order (Marcais et al. 2019), so that texts agree on a
sketch only if they share k-mers in the same sequence. Few k-mers make sketches unsure, so what short texts can
have in common is keyed exactly besides. Texts that share a sketch or such a key and are of similar length
are candidates; a banded alignment of their shingle sequences verifies them.

Equal texts are collapsed first, and only classes of texts are compared. Candidates are gathered by the
components that shared sketches form, so a text is sent to one task. A component too large for a
task is compared with the centres of its sketches first; of what is still apart, those outside the largest class
of a sketch are then compared with all in the sketch, block by block. In a task, texts are compared that
share one of their shingles that are rarest there, which similar texts always do; a passage that many texts
have makes no pairs. Every shared sketch is followed up; comparisons within a class that is already one, and those
that cannot succeed, are all that is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import combinations, product
from math import ceil, comb, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .chunks import Remembered
from .common import Sets, batch, by_task, components, cut, map_batches, mix64

SHINGLE = 5
_WORD = re.compile(r"\w+")
_word = Remembered(xxhash.xxh3_64_intdigest)


def words(text: str) -> list[str]:
    """Lower-cased words; of a text without any, what white space separates."""
    low = text.lower()
    return _WORD.findall(low) or low.split()


def shingles(tokens: list[str]) -> np.ndarray:
    """Hashes of all runs of five words in text order; a shorter text is one run."""
    h = np.fromiter(map(_word.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        x = mix64(x * np.uint64(31) + h[k : k + n])
    return x


def occurrences(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    new = np.concatenate([[True], y[1:] != y[:-1]])
    start = np.flatnonzero(new)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return out


def sketches(x: np.ndarray, many: int = 16, taken: int = 4, ratio: float = 0.8) -> np.ndarray:
    """Keys of the sketches, each for the two length classes that texts of a similar length share one of."""
    n = len(x)
    labelled = mix64(x ^ mix64(occurrences(x).astype(np.uint64)))
    seeds = mix64(np.arange(1, many + 1, dtype=np.uint64))
    t = min(taken, n)
    at = np.empty((many, t), np.int64)
    step = max(1, (1 << 20) // n)
    for lo in range(0, many, step):
        h = mix64(labelled[None, :] ^ seeds[lo : lo + step, None])
        at[lo : lo + step] = np.argpartition(h, t - 1, axis=1)[:, :t]
    picked = x[np.sort(at, axis=1)]
    key = seeds.copy()
    for k in range(t):
        key = mix64(key * np.uint64(31) + picked[:, k])
    f = floor(log(n) / -log(ratio) + 1e-9)
    return np.concatenate([mix64(key + np.uint64(f)), mix64(key + np.uint64(f + 1))]).view(np.int64)


def exact_keys(x: np.ndarray, ratio: float = 0.8, most: int = 8, most_keys: int = 500) -> np.ndarray:
    """Keys of all that can be left of a short text's shingles, in order, when it is aligned with a similar one: two
    texts of similarity ``ratio`` whose common part is at most ``most`` shingles always share one. What has more
    than ``most_keys`` ways to be left (ratios under 0.8) is left to the sketches."""
    n, found = len(x), []
    for left in range(min(n, most), 0, -1):
        if (n - left) * ratio > left * (1 - ratio) + 1e-9:
            break
        if comb(n, left) <= most_keys:
            picked = x[np.array(list(combinations(range(n), left)))]
            key = np.full(len(picked), left, np.uint64)
            for k in range(left):
                key = mix64(key * np.uint64(31) + picked[:, k])
            found.append(mix64(key ^ np.uint64(0x5EED)))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def _mask(places: list[int], low: int, width: int) -> int:
    """Bits of the places in a window that starts at ``low``."""
    first, last = bisect_left(places, low), bisect_left(places, low + width)
    if last - first <= 16:
        m = 0
        for i in places[first:last]:
            m |= 1 << i - low
        return m
    bits = np.zeros(width, np.uint8)
    bits[np.array(places[first:last]) - low] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence along the diagonal, at most ``band`` off it: bit-parallel. Of a row of the
    alignment only the window of the band is kept, a long integer; what leaves it is final and is counted. So
    memory is in proportion to the texts, time to their length times the band / 64."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a.tolist()):
        places.setdefault(v, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, gone = full, 0  # bit i of the row is place j - band + i of ``a``; a zero is a step of the subsequence
    for j, v in enumerate(b.tolist()):
        if j:
            gone += not row & 1
            row = row >> 1 | 1 << width - 1
        if own := places.get(v):
            low = j - band
            m = _mask(own, low, width) if low >= 0 else _mask(own, 0, width + low) << -low
            u = row & m
            row = (row + u | row - u) & full
        if j - band > len(a):
            break
    return head + tail + gone + width - row.bit_count()


class Shingled:
    """A text ready to be compared."""

    __slots__ = ("x", "values", "counts")

    def __init__(self, text: str):
        self.x = shingles(words(text))
        self.values, self.counts = np.unique(self.x, return_counts=True)

    def similar(self, other: Shingled, least: float) -> bool:
        """Whether aligned shingles are ``least`` or more of all shingles of both (an ordered Jaccard similarity)."""
        n = len(self.x) + len(other.x)
        need = ceil(least * n / (1 + least) - 1e-9)
        if min(len(self.x), len(other.x)) < need:
            return False
        _, i, k = np.intersect1d(self.values, other.values, assume_unique=True, return_indices=True)
        if np.minimum(self.counts[i], other.counts[k]).sum() < need:
            return False
        return aligned(self.x, other.x, n - 2 * need + abs(len(self.x) - len(other.x))) >= need


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Compared:
    """The texts of a task: links found between them, as classes."""

    def __init__(self, ids: list[int], blobs: list[bytes], least: float):
        self.ids, self.blobs, self.least = ids, blobs, least
        self.classes = Sets(len(ids))
        self.ready: dict[int, Shingled] = {}
        self.differ: set[tuple[int, int]] = set()
        self.far: np.ndarray | None = None  # pairs that cannot be similar, where they were told at once

    def text(self, i: int) -> Shingled:
        if i not in self.ready:
            self.ready[i] = Shingled(common.unpack(self.blobs[i]))
        return self.ready[i]

    def meet(self, i: int, k: int) -> bool:
        """Whether two texts are of one class now; they are compared if they were not."""
        if self.classes.of(i) == self.classes.of(k):
            return True
        if self.far is not None and self.far[i, k]:
            return False
        pair = (min(i, k), max(i, k))
        if pair in self.differ:
            return False
        if self.text(i).similar(self.text(k), self.least):
            self.classes.join(i, k)
            return True
        self.differ.add(pair)
        return False

    def shared(self) -> list[list[int]]:
        """Lists of texts that share one of their rarest shingles, short lists first: texts that are similar
        share one of the ``n - least * n + 1`` that are rarest in the task, whatever they have in common besides."""
        own = [mix64(t.x ^ mix64(occurrences(t.x).astype(np.uint64))) if len(t.x) else t.x for t in map(self.text, range(len(self.ids)))]
        values, at, many = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        lengths = np.array([len(x) for x in own], np.int64)
        self.far = self._far(at, many, lengths)
        ends = np.cumsum(lengths)
        heads, who = [], []
        for i, end in enumerate(ends.tolist()):
            n = len(own[i])
            place = at[end - n : end]
            taken = n - ceil(self.least * n - 1e-9) + 1
            heads.append(place[np.lexsort((place, many[place]))[:taken]])
            who.append(np.full(len(heads[-1]), i))
        place, text = np.concatenate(heads), np.concatenate(who)
        order = np.lexsort((text, place))
        place, text = place[order], text[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
        lists = {tuple(x.tolist()): 0 for x in np.split(text, starts[1:]) if len(x) > 1}
        return sorted(map(list, lists), key=len)

    def _far(self, at: np.ndarray, many: np.ndarray, lengths: np.ndarray, share: int = 64, cells: int = 1 << 21) -> np.ndarray | None:
        """Which pairs have too few shingles in common to be similar, for all pairs but those within the largest class at once: products of
        0/1 matrices of texts and shingles, ``cells`` at a time. None if a shingle is in fewer than one of ``share`` texts, as few pairs meet then.
        Copies of one text that are edited too much to be similar share nearly all their shingles, so rare ones alone do not tell them apart."""
        t = len(lengths)
        text = np.repeat(np.arange(t), lengths)
        common = many[at] > 1
        text, (used, column) = text[common], np.unique(at[common], return_inverse=True)
        if t < 3 or t * len(used) > share * len(column):
            return None
        order = np.argsort(column, kind="stable")
        text, column = text[order], column[order]
        of = np.array([self.classes.of(i) for i in range(t)])
        rows = np.flatnonzero(of != np.bincount(of).argmax())
        both = np.zeros((len(rows), t), np.float32)  # whole numbers, exact below 2 ** 24
        step = max(1, cells // t)
        for lo in range(0, len(used), step):
            first, last = np.searchsorted(column, [lo, lo + step])
            x = np.zeros((t, min(step, len(used) - lo)), np.float32)
            x[text[first:last], column[first:last] - lo] = 1
            both += x[rows] @ x.T
        need = np.ceil(self.least * (lengths[rows][:, None] + lengths[None, :]) / (1 + self.least) - 1e-9)
        far = np.zeros((t, t), bool)
        far[rows] = both < need
        return far | far.T

    def link(self) -> None:
        """Compares all that share a rare shingle and are not yet of one class."""
        for own in self.shared():
            for i in own[1:]:
                self.meet(own[0], i)
            parts: dict[int, list[int]] = {}
            for i in own:
                parts.setdefault(self.classes.of(i), []).append(i)
            for p, q in combinations(sorted(parts.values(), key=len), 2):
                any(self.meet(i, k) for i, k in product(p, q))

    def edges(self) -> pa.Table:
        """(text, first text of its class) of all that are not first."""
        of = [self.classes.of(i) for i in range(len(self.ids))]
        return pa.table([[self.ids[i] for i, c in enumerate(of) if i != c], [self.ids[c] for i, c in enumerate(of) if i != c]], schema=EDGES)


def signatures(docs: DataFrame, id_col: str, text_col: str, many: int, taken: int, ratio: float) -> DataFrame:
    """(id, same, n, sketches) of every row: ``same`` is equal for texts of equal words, null for a null text or id; too short
    a text has no sketches."""
    schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("n", pa.int32()), ("sketches", pa.list_(pa.int64()))])

    def run(batches):
        Remembered.claim("orderhash")
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = [[], [], []]
                for i, t in zip(part.column(0), part.column(1), strict=True):
                    if not i.is_valid or not t.is_valid:
                        for column, empty in zip(out, (None, 0, []), strict=True):
                            column.append(empty)
                        continue
                    tokens = words(t.as_py())
                    x = shingles(tokens)
                    out[0].append(xxhash.xxh3_128_digest(" ".join(tokens)))
                    out[1].append(len(x))
                    out[2].append(np.concatenate([sketches(x, many, taken, ratio), exact_keys(x, ratio)]) if len(tokens) >= SHINGLE else [])
                yield batch(schema, [part.column(0), *out])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return map_batches(rows, run, "id long, same binary, n int, sketches array<long>")


def near_duplicates(docs: DataFrame, least: float = 0.8, many: int = 16, taken: int = 4, most_texts: int = 500, most_shingles: int = 500_000, block: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) for every row: the smallest id among the documents that links reach, and whether
    it is this one.

    Texts of equal words are linked, and so are texts whose similarity is ``least`` or more. Rows with a null
    text link with nothing; a row with a null id is kept and has no class. Empty texts equal each other; texts of
    fewer than five words are linked only if equal. Rows that repeat an id are one document. An empty table
    gives no rows. Long texts are taken whole: memory of a comparison is in proportion to their words, time to
    words times the band / 64. Ties: the smaller id stands for a class. Columns besides the two are not read.

    Texts are gathered by the components that shared keys make. One of more than ``most_texts`` texts or
    ``most_shingles`` shingles is dealt to tasks by its sketches, in blocks of ``block`` texts.
    """
    signed = cut(signatures(docs, id_col, text_col, many, taken, least))
    texts = cut(signed.where("same is not null").groupBy("same").agg(F.min(F.struct("id", "n", "sketches")).alias("s")).select("same", "s.*"))
    keys = texts.select("id", "n", F.explode(F.array_distinct("sketches")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("id").alias("head")).where("many > 1").select("key", "head")
    # a text has a bounded number of keys, so its list of heads is short
    own = cut(keys.join(shared, "key").groupBy("id", "n").agg(F.collect_set(F.struct("key", "head")).alias("shared")))
    heads = F.array_distinct(F.col("shared.head"))
    label = F.array_min("shared.head")
    # ids that have the same heads are one already: only the heads make the graph
    graph = own.select(F.explode(heads).alias("a"), label.alias("b")).where("a <> b")
    loose = components(graph).withColumnRenamed("node", "label")
    sized = cut(own.withColumn("label", label).join(loose, "label", "left").select("id", "n", "shared", F.coalesce("component", "label").alias("component")))
    big = cut(sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where((F.col("c") > most_texts) | (F.col("w") > most_shingles)).select("component"))
    packed = pa.schema([("id", pa.int64()), ("blob", pa.binary())])

    def pack(batches):
        for b in batches:
            yield batch(packed, [b.column(0), [common.pack(t.as_py()) for t in b.column(1)]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    blobs = map_batches(rows, pack, "id long, blob binary")

    def within(key, group):
        group = group.sort_by("id")
        here = Compared(group.column("id").to_pylist(), group.column("blob").to_pylist(), least)
        here.link()
        return here.edges()

    some = not big.isEmpty()
    if not some:
        edges = cut(by_task(sized.select("id", "component").join(blobs, "id"), "component").applyInArrow(within, "a long, b long"))
    else:  # the texts of candidates are sent several times, so they are taken out of the rest once
        sized = cut(sized.join(big.withColumn("large", F.lit(True)), "component", "left").withColumn("large", F.coalesce("large", F.lit(False))))
        blobs = cut(sized.select("id", "component", "large").join(blobs, "id"))
        edges = cut(by_task(blobs.where("not large"), "component").applyInArrow(within, "a long, b long"))
        blobs = blobs.select("id", "blob")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("first"))
    if some:
        large = _large(sized.where("large").select("id", "shared"), blobs, least, block)
        found = found.union(components(large).toDF("id", "first"))
    classes = texts.select("same", "id").join(found, "id", "left").select("same", F.coalesce("first", "id").alias("class_id"))
    classed = signed.where("id is not null").join(classes, "same", "left").select("id", F.min(F.coalesce("class_id", "id")).over(Window.partitionBy("id")).alias("class_id"))
    classed = classed.union(signed.where("id is null").select("id", F.lit(None).cast("long")))
    return classed.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _large(own: DataFrame, blobs: DataFrame, least: float, block: int) -> DataFrame:
    """Edges within components that are too large for a task."""
    # the centre of each sketch with all its members, in salted groups of about half a block
    star = own.select("id", F.explode(F.array_distinct("shared.head")).alias("head")).where("id <> head")
    salts = cut(star.groupBy("head").agg(F.ceil(2 * F.count("*") / block).cast("int").alias("salts")))
    leaves = star.join(salts, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    centres = salts.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def around(key, group):
        group = group.sort_by("id")
        ids = group.column("id").to_pylist()
        here = Compared(ids, group.column("blob").to_pylist(), least)
        c = ids.index(key[0].as_py())
        for i in range(len(ids)):
            here.meet(c, i)
        return here.edges()

    edges = cut(by_task(leaves.union(centres).join(blobs, "id"), "head", "salt").applyInArrow(around, "a long, b long"))
    # what a sketch still holds apart: members outside its largest class meet all its members
    now = components(edges).toDF("id", "class")
    held = cut(own.join(now, "id", "left").select("id", F.coalesce("class", "id").alias("own"), F.explode("shared.key").alias("key")))
    # keys with the same members, told by two sums of hashes, bring the same comparisons: one stands for them
    sums = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"sum{k}") for k in range(2)]
    most = held.groupBy("key", "own").agg(F.count("*").alias("count"), *sums)
    most = most.groupBy("key").agg(F.max_by("own", F.struct("count", "own")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n"), F.count("*").alias("classes"), *[F.sum(f"sum{k}").alias(f"sum{k}") for k in range(2)]).where("classes > 1")
    most = most.groupBy("n", "sum0", "sum1").agg(F.min(F.struct("key", "main", "n_main")).alias("one")).select("one.*", "n")
    dealt = held.join(cut(most), "key").withColumn("minor", F.col("own") != F.col("main"))
    dealt = dealt.withColumn("sa", F.ceil(F.col("n_main") / block).cast("int")).withColumn("sb", F.ceil((F.col("n") - F.col("n_main")) / block).cast("int"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("sb")).otherwise(F.col("sa"))).cast("int"))
    task = lambda kind, i, k: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), k.cast("int").alias("k"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    tasks = F.when(F.col("minor"), F.concat(each(F.col("sa"), lambda x: task("main", x, F.col("at"))), each(F.col("sb"), lambda x: task("minor", F.least(x, "at"), F.greatest(x, "at"))))).otherwise(each(F.col("sb"), lambda x: task("main", F.col("at"), x)))
    groups = dealt.select("key", "id", "own", F.explode(tasks).alias("task")).select("key", "id", "own", "task.*")

    def apart(key, group):
        group = group.sort_by("id")
        here = Compared(group.column("id").to_pylist(), group.column("blob").to_pylist(), least)
        first: dict[int, int] = {}
        for p, c in enumerate(group.column("own").to_pylist()):
            here.classes.join(first.setdefault(c, p), p)
        here.link()
        return here.edges()

    return edges.union(cut(by_task(groups.join(blobs, "id"), "key", "kind", "i", "k").applyInArrow(apart, "a long, b long")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the smallest of its class. Rows that
    repeat an id all stay if one does; rows with a null id or text stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
