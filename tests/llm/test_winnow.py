import hashlib
from collections import Counter

import numpy as np
import pytest
from nasty_rows import NASTY
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import winnow
from loomtext.llm.common import Runs, order_runs, tie_of

K, W = 4, 5


def brute(text, k, w):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) < k:
        return None
    h = [int(x) >> 32 for x in winnow._gram_hashes(points, k)]
    w = min(w, len(h))
    chosen = []
    for i in range(len(h) - w + 1):
        low = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not chosen or chosen[-1] != (low, at):
            chosen.append((low, at))
    return chosen


@given(st.text(alphabet="abc é😀", max_size=80))
@settings(max_examples=200, deadline=None)
def test_choice_is_the_rightmost_minimum(text):
    expected = brute(text, K, W)
    got = winnow.fingerprint(text, K, W)
    if expected is not None:
        assert list(zip(got[0].tolist(), got[1].tolist())) == expected
    else:
        assert len(got[0]) == (1 if text else 0)


@given(st.text(alphabet="abcdefgh", min_size=W + K - 1, max_size=30), st.text(alphabet="xyz", max_size=20), st.text(alphabet="uvw", max_size=20))
@settings(max_examples=200, deadline=None)
def test_shared_passages_are_found(passage, before, after):
    a, b = winnow.fingerprint(passage, K, W), winnow.fingerprint(before + passage + after, K, W)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_hashes_roll_over_blocks(monkeypatch):
    text = "".join(chr(97 + (i * i) % 23) for i in range(500))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = winnow._gram_hashes(points, 7)
    assert len(set(whole.tolist())) == len({text[i : i + 7] for i in range(494)})
    monkeypatch.setattr(winnow, "_BLOCK", 64)
    assert (winnow._gram_hashes(points, 7) == whole).all()


def test_likeness():
    a, b = winnow.fingerprint("hello world " * 20), winnow.fingerprint("something else " * 20)
    empty = winnow.fingerprint("")
    assert winnow.likeness(a, a) == 1.0 == winnow.likeness(empty, empty) and winnow.likeness(a, b) == 0.0 == winnow.likeness(a, empty)
    assert winnow.as_text(a) == winnow.as_text(winnow.fingerprint("hello world " * 20)) and len(winnow.as_text(a)) == 16 * len(a[0])


def expected_edits(rows):
    """(id, n_chars, sha) by the definition, for rows whose order has no ties between different texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (winnow.fingerprint(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.as_text(a), winnow.as_text(b), winnow.likeness(a, b), winnow.likeness(a, c)))
    return sorted(map(repr, out))


def test_nasty(nasty):
    got = winnow.edited_likeness(nasty).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected_edits([(r[0], r[1]) for r in NASTY])


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = winnow.edited_likeness(documents.repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(repr(tuple(r)) for r in got) == expected_edits(rows)


@pytest.mark.parametrize("hot", [None, 0, 50, 99])
def test_an_id_of_many_rows(spark, hot):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(100) if i != hot] + [(hot, f"copy {i % 50} " * (i % 5 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: -(1 << 63) if r["doc_id"] is None else r["doc_id"]
    ends = order_runs(df, "doc_id", "text", 16)
    order, tied = Runs(ends), df.withColumn("tie", tie_of("text")).collect()
    sizes = Counter(order.of(np.array([key(r) for r in tied]), np.array([r["tie"] for r in tied])).tolist())
    assert max(sizes.values()) <= 60 and len(ends) >= 10 and set(sizes) >= set(range(len(ends)))
    own = [(r["doc_id"], r["text"]) for r in sorted(tied, key=lambda r: (key(r), r["tie"]), reverse=True)]
    assert sorted(repr(tuple(r)) for r in winnow.edited_likeness(df).collect()) == expected_edits(own)


@pytest.mark.parametrize("low, step", [(1 << 62, 3), (-(1 << 62), 10**15 + 7)])
def test_ids_beyond_double_precision(spark, low, step):
    rows = [(low + step * i, f"text {i} " * (i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(repr(tuple(r)) for r in winnow.edited_likeness(df).collect()) == expected_edits(rows)


def test_small_tables(spark, nasty):
    assert winnow.edited_likeness(nasty.limit(0)).collect() == []
    one = winnow.edited_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert winnow.fingerprints(nasty).count() == len(NASTY)
