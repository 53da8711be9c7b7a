from itertools import permutations

import pytest
from nasty_rows import NASTY
from pyspark.sql import functions as F

from loomtext.llm import audit

LABELS = "doc_id long, quality int, toxic int"
WHITE = "\t\n\x0b\x0c\r "


def fails(rows):
    """The letters that each row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t, own = t or "", ""
        words = "".join(" " if c in WHITE else c for c in t).split(" ")
        words = [w for w in words if w]
        own += "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        own += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append(own + "E" * (i is not None and i > least[t]))
    return out


def brute(rows, labels):
    """Every order is run through, row by row."""
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in range(2))
    failed, out = fails(rows), []
    for part in sorted({r[2] or "" for r in rows}):
        own = [(r, f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        runs = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r, f in left if c in f]
                left = [(r, f) for r, f in left if c not in f]
                runs[order, step] = (len(left), gone)
        value = {c: sum(len(gone) for (o, k), (_, gone) in runs.items() if o[k - 1] == c) for c in "ABCDE"}
        for (order, step), (kept, gone) in runs.items():
            c = order[step - 1]
            out.append((part, order, step, kept, len(gone), sum(c in f for _, f in own) - len(gone), sum(f == c for _, f in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), value[c]))
    return sorted(out)


def run(spark, rows, labels, schema="doc_id long, text string, lang string"):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()))


LONG = " ".join(f"word{i}" for i in range(150))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, None), (None, LONG, "en"),
    (4, LONG + " #", "en"), (5, "A B", "en"), (6, "same " * 200, "de"), (7, "SAME " * 200 + "|", "de"), (8, "SAME " * 200 + "|", ""), (9, LONG.upper(), "en"),
]


def test_against_brute_force(spark):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (5, 1, None), (7, 0, 1), (9, 1, 1), (77, 1, 1), (None, 1, 1)]
    assert run(spark, ROWS, labels) == brute(ROWS, labels)


def test_nulls_long_texts_ties_and_repeats(spark):
    rows = [r for r in NASTY] + [(11, "  a b", "en"), (12, "\x0b\x0c", None), (13, "", ""), (14, None, None)]
    labels = [(9, 1, 1), (9, 1, 1), (3, 0, 1), (6, 1, 0)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_clashing_columns(spark, nasty):
    found = audit.audit(nasty.withColumns({c: F.lit(1) for c in ("A", "E", "part", "same", "good", "id", "step")}), spark.createDataFrame([(9, 1, 1)], LABELS))
    assert sorted(map(tuple, found.collect())) == brute(NASTY, [(9, 1, 1)])


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, ROWS, []) == brute(ROWS, [])


def test_other_filters(spark):
    """Any conditions over the text, as many as there are: here one besides the copies."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    found = audit.audit(docs, spark.createDataFrame([], LABELS), {"X": F.col("text").contains("#")}, copies="Y")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in found.where("part = 'en'").collect()}
    assert got == {("XY", 1): (5, 1), ("XY", 2): (4, 1), ("YX", 1): (5, 1), ("YX", 2): (4, 1)}


@pytest.mark.parametrize("n", [2, 4])
def test_shapley_values_share_all_that_is_removed(spark, n):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    found = audit.audit(docs, spark.createDataFrame([], LABELS), dict(list(audit.text_filters().items())[: n - 1]), copies="E")
    for part in ("en", "de"):
        rows = found.where(F.col("part") == part).collect()
        orders = {r["filter_order"] for r in rows}
        shares = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows}
        removed = sum(r["removed"] for r in rows if r["filter_order"] == min(orders))
        assert sum(shares.values()) == removed * len(orders)
