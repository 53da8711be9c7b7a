import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import codes
from loomtext.llm.common import join_weighted

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Row by row, in whole numbers of Python."""
    kept = [(i, [min(max(math.floor(scale * float(np.float32(x))), -codes.LARGEST), codes.LARGEST) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, i or 0, np.array(v, "<i4").tobytes(), v) for i, v, _ in kept if v)
    n = len(order[0][3]) if order else 0
    width = -(-n // parts)
    cut = lambda v: [tuple((v + [0] * (parts * width - n))[p * width : (p + 1) * width]) for p in range(parts)]
    own = [cut(v) for _, v, _ in kept if n and len(v) == n]
    books = [[cut(v)[p] for *_, v in order if len(v) == n][:entries] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda e: (far(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in own:
                groups.setdefault(near(v[p], books[p]), []).append(v[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*groups[e], strict=True)) if e in groups else old for e, old in enumerate(books[p])]
    found = []
    for i, v, lab in kept:
        if n and len(v) == n:
            e = [near(c, books[p]) for p, c in enumerate(cut(v))]
            found.append((i, "".join(f"{x:02x}" for x in e), sum(far(c, books[p][k]) for p, (c, k) in enumerate(zip(cut(v), e, strict=True))), lab))
        else:
            found.append((i, None, None, lab))
    sums = {}
    for _, _, x, lab in found:
        if x is not None:
            sums[lab] = sums.get(lab, 0) + x
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(repr, ((i, c, x, sums.get(lab)) for i, c, x, lab in found))), digest


def run(spark, rows, **options):
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted(repr(tuple(r)) for r in found.select("vec_id", "code", "error", "label_error").collect()), codes.books_digest(books)


def vectors(n, d=16, seed=1, kinds=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(kinds, d))
    return [(int(i), [float(np.float32(x)) for x in centres[i % kinds] + 0.1 * r.normal(size=d)], [None, 1, 2][i % 3]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"entries": 4, "rounds": 2}, {"parts": 4, "scale": 10}, {"rounds": 0}])
def test_against_brute_force(spark, options):
    rows = vectors(120)
    assert run(spark, rows, **options) == brute(rows, **options)


def test_equal_parts_weigh_as_many(spark):
    """A third of the vectors are equal, others share some parts."""
    rows = vectors(60)
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(60)] + [(2000 + i, hot[:8] + v[8:], None) for i, v, _ in rows[:40]]
    assert run(spark, rows) == brute(rows)


def test_bad_and_odd_rows(spark):
    rows = vectors(40)
    rows += [(50, None, 1), (51, [1.0] * 15 + [None], 1), (52, [1.0] * 15 + [float("nan")], 1), (53, [float("inf")] + [0.0] * 15, None)]
    rows += [(54, [], 4), (55, [1.0] * 3, 1), (None, [0.5] * 16, None), (None, [0.25] * 16, 9), (3, rows[3][1], 2), (3, rows[5][1], 2), (60, [0.0] * 16, 2), (61, [1e30, -1e30] * 8, 2)]
    assert run(spark, rows) == brute(rows)


def test_length_that_parts_do_not_divide(spark):
    rows = vectors(30, d=13)
    assert run(spark, rows) == brute(rows)


def test_few_vectors_and_none(spark):
    assert run(spark, vectors(3)) == brute(vectors(3))
    assert run(spark, []) == brute([])
    assert run(spark, [(1, [], 2), (2, None, 2)]) == brute([(1, [], 2), (2, None, 2)])


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [0.0] * 8, 1) for i in range(20)] + [(30, [1 / 4096] * 8, 1)]
    got, _ = run(spark, rows)
    assert all("'" + "00" * 8 + "'" in r for r in got) and (got, _) == brute(rows)


def test_clashing_columns(spark):
    rows = vectors(30)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "v", "ints", "n", "position", "part", "error", "code", "name")})
    found, _ = codes.compress(df)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)[0]


def test_join_by_weight(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (None, 4)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (4, 1, "c")], "k long, n long, x string")
    for share in (1, 2, 256):
        got = sorted((r["k"], r["i"], r["x"]) for r in join_weighted(left, right, ["k"], "n", 58, share).collect())
        assert got == sorted([(1, i, "a") for i in range(50)] + [(2, i, "b") for i in range(3)])
