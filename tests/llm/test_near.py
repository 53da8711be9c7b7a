import random

import numpy as np
import pytest
from nasty_rows import NASTY
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import orderhash, vectors
from loomtext.llm.common import components


class Sets:
    def __init__(self):
        self.up = {}

    def of(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self.up[b] = a


@pytest.mark.parametrize("most_edges", [1_000_000, 3])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty", "loops"])
def test_components(spark, shape, most_edges):
    r = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(40)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(120)], "empty": [], "loops": [(1, 1), (2, 3), (3, 2)]}[shape]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), most_edges=most_edges).collect()}
    assert got == {x: s.of(x) for e in edges for x in e if e[0] != e[1] or s.of(x) != x or any(x in f and f[0] != f[1] for f in edges)}


# vectors


def brute_vectors(rows, least=0.95):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    s, n = Sets(), {i: 0 for i in ok}
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(ok[a]) == len(ok[b]):
                x, y = (np.array(v, float) / np.abs(v).max() for v in (ok[a], ok[b]))  # no over- or underflow
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    s.join(a, b)
    return sorted(repr((i, n.get(i, 0), s.of(i) if i in ok else i, i is None or s.of(i) == i)) for i, _ in rows)


def random_vectors(n=260, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).tolist()) for i in range(n)]
    base = rows[0][1]
    rows += [(n + i, (np.array(base) + rng.normal(size=d) * 0.1).tolist()) for i in range(120)]
    rows += [(2000 + i, (np.array(rows[5 + i][1]) + rng.normal(size=d) * 0.22).tolist()) for i in range(60)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 60}, {"block": 40, "most_regions": 6}])
def test_vectors(spark, options):
    rows = random_vectors()
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **options)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_vectors(rows)


def test_vectors_nasty(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [-1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (12, [1e300, 1e290]), (13, [1.0, 0.33])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, kept string")
    assert sorted(repr(tuple(r)) for r in vectors.near_duplicates(df).collect()) == brute_vectors(rows)
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    assert {tuple(r) for r in vectors.near_duplicates(df.where("vec_id IN (3, 5)")).collect()} == {(3, 0, 3, True), (5, 0, 5, True)}


def test_regions_follow_the_rows():
    rng = np.random.default_rng(5)
    x = vectors.unit(rng.normal(size=(6000, 24)))
    y = vectors.unit(x + rng.normal(size=x.shape) * 0.065)  # cosines around 0.953
    near = np.einsum("ij,ij->i", x, y)
    for wanted in (16, 64, 600):
        r = vectors.Regions(x[:500], wanted, 4, 40)
        a, b = r.of(x), r.of(y)
        biggest = np.unique(np.concatenate([np.unique(row) for row in a]), return_counts=True)[1].max()
        assert (r.second is None) == (wanted <= 40) and (wanted < 600 or biggest < 1000)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2))[near >= 0.95].mean() > 0.95


def test_a_search_that_falls_short_compares_all(monkeypatch):
    monkeypatch.setattr(vectors.FlatGraph, "in_range", lambda self, q, *a: (np.empty(0, np.int64),) * 2)
    x = vectors.unit(np.array([v for _, v in random_vectors()]))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert set(zip(*(y.tolist() for y in vectors.links(x, None, 0.95)))) == set(zip(i.tolist(), j.tolist()))
    assert len(vectors.links(x[:100], x[260:], 0.95)[0]) == (x[:100] @ x[260:].T >= 0.95).sum()


def test_a_lossy_result_is_an_error(spark, monkeypatch):
    rows = random_vectors()
    monkeypatch.setattr(vectors, "recall", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="only 0.500"):
        vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_recall_is_measured_against_all(spark):
    x = vectors.unit(np.array([v for _, v in random_vectors()]))
    true = (x @ x.T >= 0.95).sum(1) - 1
    own = spark.createDataFrame([(i, x.shape[1], v.tobytes()) for i, v in enumerate(x)], "id long, size int, vec binary")
    counts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(true)], "id long, n long")
    assert vectors.recall(own, counts, np.float64, 0.95, 1000) == 1.0
    assert vectors.recall(own, counts.withColumn("n", F.floor(F.col("n") / 2)), np.float64, 0.95, 1000) < 0.6
    assert vectors.recall(own.limit(1), counts, np.float64, 0.95, 5) >= 1.0


def test_graph_reaches_all():
    x = vectors.unit(np.array([v for _, v in random_vectors()]))
    g = vectors.FlatGraph(x, cluster=60)
    seen, frontier = set(g.entries.tolist()), g.entries
    while len(frontier):
        frontier = np.array([v for v in np.unique(g.neighbours(frontier)[1]).tolist() if v not in seen], np.int64)
        seen |= set(frontier.tolist())
    assert seen == set(range(len(x)))
    assert len(g.tail) < len(x) ** 2 / 4  # pruned


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    assert sorted(repr(tuple(r)) for r in vectors.near_duplicates(df).collect()) == brute_vectors(rows)


# texts


def test_short_near_copies_share_a_key(spark):
    """Sketches alone miss 2.8 % of texts of 4 shingles with a word appended."""
    rows = []
    for i in range(400):
        text = " ".join(f"w{i}x{k}" for k in range(8))
        rows += [(2 * i, text), (2 * i + 1, f"{text} more")]
    got = orderhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(i, i - i % 2) for i in range(800)]


@given(st.lists(st.integers(0, 2), min_size=1, max_size=10), st.lists(st.integers(0, 2), min_size=1, max_size=10))
@settings(max_examples=500, deadline=None)
def test_exact_keys(a, b):
    common = lcs(a, b)
    if common <= 8 and 10 * common >= 8 * (len(a) + len(b) - common):
        x, y = (orderhash.exact_keys(np.array(v, np.uint64)).tolist() for v in (a, b))
        assert set(x) & set(y)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
@settings(max_examples=300, deadline=None)
def test_alignment(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert orderhash.aligned(x, y, 60) == lcs(a, b)
    assert orderhash.aligned(x, y, 2) <= lcs(a, b)


@given(st.lists(st.integers(0, 30), min_size=5, max_size=40), st.integers(0, 39), st.integers(0, 39))
@settings(max_examples=200, deadline=None)
def test_a_band_loses_no_similar_pair(words, at, other):
    a = [str(w) for w in words]
    b = a[: at % len(a)] + ["new"] + a[at % len(a) + (other % 3) :]
    x, y = orderhash.Shingled(" ".join(a)), orderhash.Shingled(" ".join(b))
    m = lcs(x.x.tolist(), y.x.tolist())
    assert x.similar(y, 0.8) == (m / (len(x.x) + len(y.x) - m) >= 0.8 - 1e-12)


def test_a_long_alignment_takes_little_memory():
    import tracemalloc

    a = np.arange(20_000, dtype=np.uint64)
    b = np.where(np.arange(20_000) % 12 == 0, a + np.uint64(1 << 40), a)
    b[::50] = 7  # a value with many places
    a[::50] = 7
    tracemalloc.start()
    found = orderhash.aligned(a, b, 3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == int((a == b).sum())
    assert peak < 20_000_000


def test_a_common_passage_makes_no_lists():
    """Texts that share nothing but a passage have no rare shingle in common."""
    from loomtext.llm.common import pack

    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"t{i}w{k}" for k in range(40)) + " " + passage for i in range(50)]
    assert orderhash.Compared(list(range(50)), list(map(pack, texts)), 0.8).shared() == []


def test_copies_edited_too_much_are_told_apart_at_once(monkeypatch):
    """Of many copies of one text only those that can be similar are compared one by one, and no link is lost."""
    from loomtext.llm.common import pack

    r = random.Random(4)
    base = family(r, 150)
    texts = []
    for i in range(120):
        words = list(base)
        for at in r.sample(range(150), r.choice([1, 4, 5, 6])):
            words[at] = f"edit{r.randrange(300)}"
        texts.append(" ".join(words))
    ready, want, similar = list(map(orderhash.Shingled, texts)), Sets(), orderhash.Shingled.similar
    for i in range(120):
        for k in range(i):
            if ready[i].similar(ready[k], 0.8):
                want.join(i, k)
    compared = []
    monkeypatch.setattr(orderhash.Shingled, "similar", lambda a, b, least: compared.append(1) or similar(a, b, least))
    here = orderhash.Compared(list(range(120)), list(map(pack, texts)), 0.8)
    here.link()
    classes = [want.of(i) for i in range(120)]
    assert [here.classes.of(i) for i in range(120)] == classes and 10 < len(set(classes)) < 110
    assert len(compared) < 400  # of 7,140 pairs


def test_occurrences_and_order():
    assert orderhash.occurrences(np.array([3, 1, 3, 3, 1], np.uint64)).tolist() == [0, 0, 1, 2, 1]
    words = [f"w{i}" for i in range(200)]
    a, b = (orderhash.sketches(orderhash.shingles(w)) for w in (words, words[100:] + words[:100]))
    assert len(set(a.tolist()) & set(b.tolist())) < len(set(a.tolist())) / 2  # the same words in another order
    assert orderhash.words("Hello, World") == ["hello", "world"] and orderhash.words("!!! ???") == ["!!!", "???"] and orderhash.words("  ") == []


def brute_texts(rows, least=0.8):
    ready = {i: (tuple(orderhash.words(t)), orderhash.Shingled(t)) for i, t in rows if i is not None and t is not None}
    s, ids = Sets(), sorted(ready)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (wa, xa), (wb, xb) = ready[a], ready[b]
            if wa == wb or len(wa) >= 5 and len(wb) >= 5 and xa.similar(xb, least):
                s.join(a, b)
    return sorted(repr((i, s.of(i) if i in ready else i, i is None or i not in ready or s.of(i) == i)) for i, _ in rows)


def family(r, n=80):
    return " ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(n)).split()


def near_rows():
    r = random.Random(2)
    rows, at = [], 0
    passage = family(r, 30)
    for _ in range(6):
        base = family(r, r.randrange(60, 120))
        for _ in range(r.randrange(2, 9)):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = "edit" + str(r.randrange(99))
            rows.append((at, " ".join(words)))
            at += 1
    for _ in range(30):
        rows.append((at, " ".join(passage + family(r, 15))))
        at += 1
    return rows


@pytest.mark.parametrize("options", [{}, {"most_texts": 1}, {"most_texts": 1, "block": 7}])
def test_texts(spark, options):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(repr(tuple(r)) for r in orderhash.near_duplicates(df, **options).collect()) == brute_texts(rows)


def test_texts_nasty(nasty):
    rows = [(i, t) for i, t, _ in NASTY]
    assert sorted(repr(tuple(r)) for r in orderhash.near_duplicates(nasty).collect()) == brute_texts(rows)
    assert orderhash.near_duplicates(nasty.limit(0)).collect() == []
    kept = orderhash.first_of_each(nasty)
    assert kept.columns == nasty.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 5, 3, 7, 1, 2, 8, 4, 10}


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(repr(tuple(r)) for r in orderhash.near_duplicates(df).collect()) == brute_texts(rows)
    assert df.select(F.count("*")).first()[0] == len(rows)
