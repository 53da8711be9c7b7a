import random
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nasty_rows import NASTY
from pyspark.sql import functions as F

from loomtext.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(t):
    return len(WORD.findall(t or ""))


def levels(sized, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Targets by resharing, round after round: sources in order of code points, null last."""
    names = sorted(x for x in sized if x is not None) + [None] * (None in sized)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sized.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(most * sized[s] for s in full)
        each = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if each[s] > most * sized[s]}
        if not over:
            return {**{s: Fraction(most * sized[s]) for s in full}, **each}
        full |= over
        if len(full) == len(names):
            return {s: Fraction(most * sized[s]) for s in full}


def docs(n, seed=1, sources=("b", "a", None, "ä", "Z", "\U0001f600", "ﬁ")):
    r = random.Random(seed)
    return [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 700]))), r.choice(sources[: 1 + i % len(sources)])) for i in range(n)]


SCHEMA = "doc_id long, text string, source string"


def check(rows, mix, block):
    found = mix.taken().collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((i is None, i or 0, words(t)) for i, t, _ in rows)
    size = {s: sum(words(t) for _, t, x in rows if x == s) for _, _, s in rows}
    aim = levels(size)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault((i, words(t)), set()).add(s)
    got = dict.fromkeys(size, 0)
    for r in found:
        s = min(by_id[r["doc_id"], r["size"]], key=lambda s: abs(float(aim[s]) - r["target"]) + (size[s] != r["source_size"]))
        assert r["source_size"] == size[s] and abs(r["target"] - float(aim[s])) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        got[s] += r["taken"]
    for s in size:
        assert abs(got[s] - aim[s]) < 1


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_targets_are_met(spark, block):
    rows = docs(60)
    mix = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    check(rows, mix, block)


def test_sequence_is_the_slots_in_order(spark):
    """Each slot is one block of one source, whole but for ends; what it holds is in the documents' order and sums to what is taken."""
    rows = docs(50, seed=3)
    mix = mixing.mix(spark.createDataFrame(rows, SCHEMA), block=64)
    slots = mix.slots.orderBy("slot").collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    rank = {}
    for r in slots:  # a source's blocks come one after another, then from the start
        k = rank.setdefault(r["place"], 0)
        blocks = 1 + max(x["block"] for x in slots if x["place"] == r["place"])
        assert r["block"] == k % blocks and r["first"] == 64 * r["block"] and 0 < r["last"] - r["first"] <= 64
        rank[r["place"]] += 1
    pieces = mix.sequence().collect()
    assert sum(p["n_words"] for p in pieces) == sum(r["last"] - r["first"] for r in slots)
    for r in slots:
        own = sorted((p["first"], p["n_words"]) for p in pieces if p["slot"] == r["slot"])
        assert own[0][0] == r["first"] and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == r["last"]
    taken = {}
    for p in pieces:
        taken[p["doc_id"]] = taken.get(p["doc_id"], 0) + p["n_words"]
    assert {r["doc_id"]: r["taken"] for r in mix.taken().collect() if r["taken"]} == taken


def test_the_schedule_is_even(spark):
    """In any beginning of the schedule a source has its share but for a few slots."""
    rows = [(i, "w " * 1000, "abc"[i % 3]) for i in range(300)]
    mix = mixing.mix(spark.createDataFrame(rows, SCHEMA), block=50)
    order = [r["place"] for r in mix.slots.orderBy("slot").collect()]
    every = {p: order.count(p) for p in set(order)}
    for n in range(100, len(order), 97):
        for p, k in every.items():
            assert abs(order[:n].count(p) - k * n / len(order)) <= 14


@given(st.integers(1, 9), st.data())
@settings(max_examples=30, deadline=None)
def test_slots_before(spark, bits, data):
    low = data.draw(st.integers(0, (1 << bits) - 1))
    high = data.draw(st.integers(low + 1, 1 << bits))
    rows = spark.range(low, high).select(F.col("id").alias("point"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    got = rows.withColumn("slot", mixing.reversed_bits("point", bits)).withColumn("rank", mixing.slot_rank(bits)).collect()
    assert [r["slot"] for r in got] == [int(f"{v:0{bits}b}"[::-1], 2) for v in range(low, high)]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["slot"])] == list(range(high - low))


@pytest.mark.parametrize("bucket_rows, at_once", [(1, 14), (1, 2), (4, 1), (10_000, 14)])
def test_offsets_of_buckets(spark, bucket_rows, at_once):
    r = random.Random(2)
    rows = [(f"{r.getrandbits(128):032x}", k % 2, r.randrange(9)) for k in range(40)]
    got = mixing.laid_out(spark.createDataFrame(rows, "key string, place int, size long"), len(rows), bucket_rows, at_once)
    for x in got.collect():
        assert x["start"] == sum(n for k, p, n in rows if p == x["place"] and k < x["key"])


def test_reruns_agree(spark):
    rows = docs(40, seed=8)
    runs = [sorted(map(repr, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(n), block=16).taken().collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_nulls_repeats_and_clashing_columns(spark, nasty):
    rows = [(i, t, {1: "x", 2: None}.get((i or 0) % 3, "y")) for i, t, _ in NASTY]
    source = F.when(F.col("doc_id") % 3 == 1, "x").when(F.col("doc_id") % 3 == 2, None).otherwise("y")
    more = nasty.withColumns({"source": source} | {c: F.lit(7) for c in ("size", "place", "block", "name", "target", "slot", "first", "bucket")})
    check(rows, mixing.mix(more, block=100), 100)


def test_no_words_at_all(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).taken().collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " \t", None)], SCHEMA))
    assert sorted(map(tuple, got.taken().collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert got.sequence().collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    found = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Cartesian|NestedLoop", plan)
