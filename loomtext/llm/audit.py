"""How filters overlap: what each removes, alone and after others, in every order.

A row fails a set of filters jointly if the product of their flags is one. The sums of these products over all 2^n sets are all that
is gathered from the documents; everything else follows from them by inclusion and exclusion:

* survivors of a set T (its Moebius inversion): the sum of (-1)^|S| joint(S) over the subsets S of T;
* what a filter removes after others: the difference of two survivors;
* its unique failures: survivors of all other filters, less those of all;
* its Shapley value: "removed by T" is a game whose Harsanyi dividend of S is (-1)^(|S|+1) joint(S), and each member of S has an
  equal part of it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are what white space parts: the characters that SQL engines and Python agree on, all ASCII.
WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: str = "text") -> dict[str, Column]:
    """Conditions under which a text fails: A few words, B repeated words, C capitals, D signs."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORDS), 0)
    n = F.size(words)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * n, "C": 100 * capitals > 10 * F.length(t), "D": t.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str = "E", part: str = "lang") -> DataFrame:
    """(part, filters..., good, toxic, n, n_copies): how many rows fail the filters in the same way, and how many of these fail ``copies``
    too, that is have the text of a smaller id. The conditions may depend on nothing but the text.

    Texts are read once and only their hashes (128 bits of SHA-256) leave their task. No group is gathered: rows that agree in all that is asked
    are counted before they are dealt, so of the copies of one text there are as many rows as parts and labels. What joins
    the labels is one row an id and text; an id with very many texts (null) is a join that adaptive execution can split.
    """
    names = list(filters)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("same"), *[c.cast("int").alias(k) for k, c in filters.items()])
    rows = own.groupBy("id", "part", "same", *names).agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    mark = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    marked = rows.join(marks, "id", "left").select("id", "part", "same", *names, mark("good"), mark("toxic"), "n")
    # an id and text are one row here, but for those that stand in several parts or have no id
    groups = marked.groupBy("same", "part", *names, "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("first").over(Window.partitionBy("same"))
    kept = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_null")
    each = groups.withColumn("least", least).select("part", *names, "good", "toxic", "n", (F.col("n") - kept).alias("n_copies"))
    return each.groupBy("part", *names, "good", "toxic").agg(F.sum("n").alias("n"), F.sum("n_copies").alias("n_copies"))


def joint_failures(flags: DataFrame, names: list[str], copies: str) -> DataFrame:
    """(part, every, good, toxic): arrays of the numbers of rows that fail all filters of a set, at the place whose bits are the set's."""

    def joint(s: int, mark: str | None) -> Column:
        out = F.col("n_copies") if s >> len(names) & 1 else F.col("n")
        for i, k in enumerate(names):
            if s >> i & 1:
                out = out * F.col(k)
        return F.sum(out if mark is None else out * F.col(mark))

    sets = range(1 << (len(names) + 1))
    return flags.groupBy("part").agg(*[F.array(*[joint(s, m) for s in sets]).alias(m or "every") for m in (None, "good", "toxic")])


def _sum(terms: list[tuple[int, Column]]) -> Column:
    out = F.lit(0).cast("long")
    for k, c in terms:
        out = out + k * c
    return out


def _inverted(joint: str, n: int) -> Column:
    """The array of survivors of every set of filters."""
    one = lambda t: _sum([((-1) ** s.bit_count(), F.col(joint)[s]) for s in range(1 << n) if s & t == s])
    return F.array(*map(one, range(1 << n)))


def _shapley(n: int) -> Column:
    """For each filter the sum over all orders of what it removes: n! times its Shapley value."""
    one = lambda f: _sum([((-1) ** (s.bit_count() + 1) * factorial(n) // s.bit_count(), F.col("every")[s]) for s in range(1 << n) if s >> f & 1])
    return F.array(*map(one, range(n)))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each value of ``part``, order of
    the filters (their names are one letter each) and step of it; counts are of rows.

    Null texts are empty texts (copies of one another), null parts are the empty part. Rows with one id are rows each; a copy is a row whose text
    stands under a smaller id anywhere, so rows that repeat an id are no copies of one another, and a row without an id
    neither is a copy nor makes one. An id is good or toxic if any of its labels says so; labels without a document, or with a null id, count
    for nothing. Texts are read whole whatever their length. An empty table has no parts, so no rows. Columns that are not named here
    are not read.
    """
    filters = text_filters() if filters is None else filters
    names = [*filters, copies]
    n = len(names)
    counts = joint_failures(flagged(docs, labels, filters, copies, part), names[:-1], copies)
    known = counts.select("part", "every", *[_inverted(m, n).alias(f"left_{m}") for m in ("every", "good", "toxic")], _shapley(n).alias("values"))
    orders = F.lit(["".join(p) for p in permutations(names)])
    steps = known.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = [F.locate(k, F.col("filter_order")) for k in names]
    own = sum((F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    ready = steps.select("*", own.alias("own"), before.alias("before"), F.element_at(F.lit([1 << i for i in range(n)]), own + 1).alias("bit"))
    lost = lambda m: F.col(f"left_{m}")[F.col("before")] - F.col(f"left_{m}")[F.col("before") + F.col("bit")]
    every = (1 << n) - 1
    return ready.select(
        "part", "filter_order", "step",
        F.col("left_every")[F.col("before") + F.col("bit")].alias("kept"),
        lost("every").alias("removed"),
        (F.col("every")[F.col("bit")] - lost("every")).alias("redundant"),
        (F.col("left_every")[every - F.col("bit")] - F.col("left_every")[every]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.col("values")[F.col("own")].alias("shapley"),
    )
