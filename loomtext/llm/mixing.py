"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, shuffled, are one long run of words, cut into blocks of equally many. A schedule of T slots says from
which source the next block comes. Slot t has the van der Corput point of t, its m bits in reverse order as a fraction v / 2^m;
the point is mapped through the cumulated numbers of blocks that the sources are to give, and slots whose point is beyond them stay
empty. Since each v below T occurs once, every source gets its number exactly, and any stretch of the schedule is near to the
weights. A source's k-th slot takes its block k, from the start again when all are used up.

All of it is column expressions, joins and windows over bounded groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_weighted, shuffle_parts, stored

#: Words are what white space parts: the characters that SQL engines and Python agree on, all ASCII.
WORDS = r"[^\x20\x09-\x0D]+"
#: Slots that one row of a source is unfolded to at a time.
CHUNK = 1 << 14


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key): the number of words, and what the documents are shuffled by: a hash of id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), key.alias("key"))


def _named(source: str = "source") -> Column:
    """A source as a key of joins, also null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, place, target): the words that each source is to give. Sources in the order of their code points, null
    last, weigh ``weights`` over and over; together they give ``share`` of all words, none more than ``most`` of its own, and what one cannot
    give the others do by weight.

    Every source gives the smaller of its limit and a level times its weight. With the sources in the order of limit over weight, the
    level is the largest of (all words less the limits before a source) / (weights from it on): these quotients rise as
    long as sources reach their limit and fall from then on. The sources, one row each, are ordered in one task.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by.withColumn("place", place).withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    every = Window.partitionBy()
    before = Window.orderBy(limit / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    words = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = words / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = ranked.withColumn("level", level)
    return found.select("source", "source_size", "n_docs", "place", F.least(limit, F.max("level").over(every) * F.col("weight")).alias("target"))


def quotas(aims: DataFrame, block: int) -> DataFrame:
    """``targets`` with ``words`` (whole words to take), ``blocks`` (that a source has) and its interval of points from ``low`` to ``high``: one for each
    block to take."""
    words = F.floor("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    has = aims.select("*", words.alias("words"), blocks.alias("blocks")).where("source_size > 0")
    n = F.expr("words div source_size") * F.col("blocks") + F.ceil(F.expr("words % source_size") / block).cast("long")
    high = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return has.withColumn("n", n).withColumn("high", high).select("place", "source_size", "words", "blocks", (F.col("high") - F.col("n")).alias("low"), "high")


def reversed_bits(v: str, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), bits, "0")), 2, 10).cast("long")


def slot_rank(bits: int, t: str = "slot", v: str = "point", low: str = "low", high: str = "high") -> Column:
    """How many slots before ``t`` have their points from ``low`` to ``high`` too. Those before t share the bits of t above some bit j
    that t has set and they have not, and are free below; their points are all that leave one remainder modulo 2^(bits - j)."""
    total = F.lit(0).cast("long")
    for j in range(bits):
        rest = F.col(v).bitwiseAND(F.lit((1 << (bits - 1 - j)) - 1).cast("long"))
        below = lambda x: F.shiftright(F.col(x) - rest - 1, bits - j)  # noqa: B023, E731
        total = total + F.when(F.col(t).bitwiseAND(F.lit(1 << j).cast("long")) != 0, below(high) - below(low)).otherwise(0)
    return total


def schedule(plan: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, place, block, first, last): for every slot of the ``slots`` points that ``plan`` (quotas) has, the block that it takes and the words of
    the source from ``first`` up to ``last`` in it. A source's last slot ends where its words are reached. Slots are
    unfolded from the sources' intervals in chunks, for reversing bits leads from points to slots as well."""
    bits = max(1, (slots - 1).bit_length())
    chunks = plan.where("high > low").select("*", F.explode(F.sequence(F.shiftright("low", CHUNK.bit_length() - 1), F.shiftright(F.col("high") - 1, CHUNK.bit_length() - 1))).alias("chunk"))
    dealt = chunks.repartition(shuffle_parts(plan.sparkSession), "place", "chunk")  # a given number stays, however few the rows before unfolding
    points = dealt.select("*", F.explode(F.sequence(F.greatest("low", F.col("chunk") * CHUNK), F.least("high", (F.col("chunk") + 1) * CHUNK) - 1)).alias("point"))
    ranked = points.withColumn("slot", reversed_bits("point", bits)).withColumn("rank", slot_rank(bits))
    placed = ranked.select("slot", "place", "source_size", "words", F.expr("rank div blocks").alias("round"), (F.col("rank") % F.col("blocks")).alias("block"))
    first = F.col("block") * block
    return placed.select("slot", "place", "block", first.alias("first"), F.least(first + block, F.col("source_size"), F.col("words") - F.col("round") * F.col("source_size")).alias("last"))


def _offsets(sums: DataFrame, bits: int, at_once: int) -> DataFrame:
    """(place, bucket, offset): the words in a place's buckets before each, from (place, bucket, n) with ``bits`` of bucket; by groups of
    2^at_once buckets, and the same over the groups, so that no window is longer."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n").over(before.partitionBy("place", "group")), F.lit(0))
    grouped = sums.withColumn("group", F.shiftright("bucket", at_once))
    if bits <= at_once:
        return grouped.select("place", "bucket", inner.alias("offset"))
    upper = _offsets(grouped.groupBy("place", F.col("group").alias("bucket")).agg(F.sum("n").alias("n")), bits - at_once, at_once)
    upper = upper.select("place", F.col("bucket").alias("group"), F.col("offset").alias("base"))
    return grouped.withColumn("inner", inner).join(upper, ["place", "group"]).select("place", "bucket", (F.col("base") + F.col("inner")).alias("offset"))


def laid_out(sized: DataFrame, rows: int, bucket_rows: int = 1_000, at_once: int = 14) -> DataFrame:
    """``sized`` with ``start``, the words before a document in its source's shuffled run. Keys are hashes, so their first bits cut a source into
    buckets of even size, whatever its share of the rows; offsets come from the buckets' sums, one row each. Rows that
    are equal in id and text have one key and are not cut."""
    bits = max(0, (rows // bucket_rows).bit_length())
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")
    cut_up = sized.withColumn("bucket", bucket)
    offsets = _offsets(cut_up.groupBy("place", "bucket").agg(F.sum("size").alias("n")), bits, at_once)
    within = Window.partitionBy("place", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    running = cut_up.withColumn("end", F.sum("size").over(within))
    return running.join(offsets, ["place", "bucket"]).select(*sized.columns, (F.col("offset") + F.col("end") - F.col("size")).alias("start"))


@dataclass
class Mix:
    """``documents``: (doc_id, place, size, source_size, target, start), those without words left out; ``empty``: those, without start;
    ``slots``: see ``schedule``; ``block``: words of one."""

    documents: DataFrame
    empty: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """Every document's words by block: (..., block, first, last) as words of the source."""
        end = F.col("start") + F.col("size")
        spans = self.documents.select("*", F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))).alias("block"))
        return spans.select("*", F.greatest("start", F.col("block") * self.block).alias("first"), F.least(end, (F.col("block") + 1) * self.block).alias("last"))

    def _taken(self, kind: str) -> DataFrame:
        slots = self.slots.select("slot", "place", "block", F.col("last").alias("until"))
        return self.pieces().join(slots, ["place", "block"], kind)

    def sequence(self) -> DataFrame:
        """The mix: (slot, place, first, doc_id, first_word, n_words), to be read by slot, then by ``first``; ``first_word`` counts in the document."""
        n = F.least("last", "until") - F.col("first")
        return self._taken("inner").where(n > 0).select("slot", "place", "first", "doc_id", (F.col("first") - F.col("start")).alias("first_word"), n.alias("n_words"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document."""
        n = F.coalesce(F.greatest(F.lit(0).cast("long"), F.least("last", "until") - F.col("first")), F.lit(0).cast("long"))
        n = F.when(F.col("until").isNull(), 0).otherwise(n)
        # where a document with words starts is its alone in a source
        own = self._taken("left").groupBy("place", "start", "doc_id", "size", "source_size", "target").agg(F.sum(n).alias("taken"))
        columns = ["doc_id", "size", "source_size", "target"]
        return own.select(*columns, "taken").unionByName(self.empty.select(*columns, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of all documents. Null and empty texts have no words and are never taken; null sources are a source of their own; a null id is
    hashed as the empty id; repeated rows are documents each, which follow one another. A long text spans as many blocks as it has. Empty tables
    and tables without words give an empty schedule. Other columns are not read. No document is taken more than ``most`` times, rounded up, and
    a source's words differ from its target by less than one. Reruns agree: all order comes from hashes.

    Texts are read once; what follows moves (id, size, hash) rows. A source that has a third of all rows is cut by hash, and
    met by broadcast rows of the at most 256 largest sources, so no task takes a source.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col).withColumn("name", _named()))
    aims = stored(targets(sized, weights, share, most).withColumn("name", _named()))
    plan = stored(quotas(aims, block))
    facts = aims.agg(F.sum("n_docs").alias("n")).first()
    slots = plan.agg(F.max("high")).first()[0] or 0
    rows = facts["n"] or 0
    joined = join_weighted(sized.select("doc_id", "name", "size", "key"), aims.select("name", "place", "source_size", "target", "n_docs"), ["name"], "n_docs", rows).select("doc_id", "place", "size", "source_size", "target", "key")
    laid = laid_out(joined.where("size > 0"), rows).drop("key")
    # written, so that its size is known where it is joined: it grows with the input
    return Mix(laid, joined.where("size = 0").drop("key"), stored(schedule(plan, slots, block)), block)
