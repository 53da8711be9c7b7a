"""From documents (path, raw_text, ...) to postings (path, term, freq) and document lengths.

A document that came with its words counted (a map in the column ``words``) has those words; one without, or with an
empty map, has the words of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import LOWER, STEM, lower_column, normalize_column
from ..functions.stemming import stem_column, stems_column
from ..functions.tokens import WORD, words_column


#: Repeated paths that may be broadcast; with more of them, their rows are told by a shuffled join.
FEW_PATHS = 10_000
#: Bytes of text of repeated paths whose counts a task is to add up.
ADDED_TEXT = 16 << 20
#: Tasks that the counts of one path may go to.
PATH_PARTS = 8


def brings_words(docs: DataFrame) -> bool:
    return "words" in docs.columns


def given() -> Column:
    """Whether a document came with its words."""
    return F.coalesce(F.size("words") > 0, F.lit(False))


def length_column(docs: DataFrame) -> Column:
    """Number of words of a document."""
    text = F.regexp_count("raw_text", F.lit(WORD)).cast("long")
    if not brings_words(docs):
        return text
    return F.when(given(), F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(0)))).otherwise(text)


def _counts(docs: DataFrame, key: list[str], lowered: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """(key..., word, freq), aggregated; only ``wanted`` words if they are given. Lowering changes no word's bounds, so
    a text is lowered as a whole."""
    text = words_column(lower_column(F.col("raw_text")) if lowered else F.col("raw_text"))
    if wanted is not None:
        text = F.filter(text, lambda w: w.isin(wanted))
    if not brings_words(docs):
        return docs.select(*key, F.explode(text).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("freq"))
    own = F.map_entries("words")
    if wanted is not None:
        own = F.filter(own, lambda e: e["key"].isin(wanted))
    one = lambda w, n: F.struct(w.alias("word"), n.cast("long").alias("freq"))
    pairs = F.when(given(), F.transform(own, lambda e: one(lower_column(e["key"]) if lowered else e["key"], e["value"]))).otherwise(F.transform(text, lambda w: one(w, F.lit(1))))
    return docs.select(*key, F.inline(pairs)).groupBy(*key, "word").agg(F.sum("freq").alias("freq"))


def split_repeated(docs: DataFrame, nulls: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose path no other row has, and the others (None if there are none). Only paths are read to tell them, by a job of its own. ``nulls``: whether
    a null path is one like others; if not, its rows are each alone."""
    paths = docs.select("path") if nulls else docs.select("path").where("path IS NOT NULL")
    twice = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("_path"))
    n = twice.count()
    if not n:
        return docs, None
    twice = F.broadcast(twice) if n <= FEW_PATHS else twice
    same = F.col("path").eqNullSafe(F.col("_path"))
    return docs.join(twice, same, "left_anti"), docs.join(twice, same, "left_semi")


def word_counts(docs: DataFrame, normalizer: int | None = None) -> DataFrame:
    """(path, word, freq), case kept; with a ``normalizer`` (path, term, freq), where counts of words that fall together are added."""
    found = _by_path(docs, normalizer)
    return found if normalizer is not None else found.withColumnRenamed("term", "word")


def _by_path(docs: DataFrame, normalizer: int | None) -> DataFrame:
    """(path, term, freq), a term being the word itself without a ``normalizer``. Texts are counted inside their rows, so that no task holds the words of all of its rows; only
    what documents bring is aggregated, and the counts of paths that several rows have are added up."""
    once, more = split_repeated(docs)
    found = _row_counts(once, normalizer)
    if more is None:
        return found
    sizes = more.select("path", F.octet_length("raw_text").alias("size")).groupBy("path").agg(F.sum("size").alias("size"))
    long = sizes.where(F.col("size") > ADDED_TEXT)
    total, n_long, size_long = sizes.agg(F.sum("size"), F.count_if(F.col("size") > ADDED_TEXT), F.sum(F.when(F.col("size") > ADDED_TEXT, F.col("size")))).first()
    if not n_long:
        return found.unionByName(_gathered(more, normalizer, total or 0))
    long = long.select(F.col("path").alias("_path"))
    long = F.broadcast(long) if n_long <= FEW_PATHS else long
    same = F.col("path").eqNullSafe(F.col("_path"))
    found = found.unionByName(_gathered(more.join(long, same, "left_anti"), normalizer, total - size_long))
    return found.unionByName(_added(_row_counts(more.join(long, same, "left_semi"), normalizer), size_long))


def _row_counts(docs: DataFrame, normalizer: int | None) -> DataFrame:
    """(path, term, freq) of each row by itself; what rows of one path bring is added."""
    text = docs.where(~given()) if brings_words(docs) else docs
    found = _in_rows(text, ["path"], normalizer).select("path", "term", "freq")
    if not brings_words(docs):
        return found
    own = _counts(docs.where(given()), ["path"], lowered=normalizer == LOWER)
    return found.unionByName(own.withColumnRenamed("word", "term") if normalizer in (None, LOWER) else renormalized(own, normalizer))


def _gathered(docs: DataFrame, normalizer: int | None, size: int) -> DataFrame:
    """(path, term, freq) of paths with at most ``ADDED_TEXT`` of text each, ``size`` bytes in all: the rows of a path are brought to one task before their words are counted, since
    their counts are several times as long as their texts. What is counted there is added without another shuffle."""
    tasks = max(-(-size // ADDED_TEXT), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _row_counts(docs.repartition(tasks, "path"), normalizer).groupBy("path", "term").agg(F.sum("freq").alias("freq"))


def _added(counts: DataFrame, size: int) -> DataFrame:
    """(path, term, freq) of rows' counts. They are dealt to as many tasks as their text, of ``size`` bytes, has ``ADDED_TEXT``, so that a task adds as much whatever the input; those
    of a path go to a few tasks, where they stand together and compress well."""
    tasks = -(-size // ADDED_TEXT)
    if tasks <= int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return counts.groupBy("path", "term").agg(F.sum("freq").alias("freq"))
    dealt = counts.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(PATH_PARTS))).repartition(tasks, "path", "_part")
    return dealt.groupBy("path", "_part", "term").agg(F.sum("freq").alias("freq")).drop("_part")


def vocabulary(docs: DataFrame) -> DataFrame:
    words = words_column("raw_text")
    if brings_words(docs):
        words = F.when(given(), F.map_keys("words")).otherwise(words)
    return docs.select(F.explode(words).alias("word")).distinct()


def renormalized(counts: DataFrame, normalizer: int = LOWER) -> DataFrame:
    """(path, ..., term, freq): counts of words that fall together are added. The stemmer sees the distinct words of a
    batch and remembers them, so nothing is joined and a frequent word is no hot key."""
    key = [c for c in counts.columns if c not in ("word", "freq")]
    termed = counts.withColumn("term", stem_column(F.col("word")) if normalizer == STEM else normalize_column(F.col("word"), normalizer))
    return termed.groupBy(*key, "term").agg(F.sum("freq").alias("freq"))


def postings(docs: DataFrame, normalizer: int = LOWER) -> DataFrame:
    """(path, term, freq)."""
    return _by_path(docs, normalizer)


def full_postings(docs: DataFrame, normalizer: int = LOWER) -> DataFrame:
    """(path, source, n_terms, term, freq): all that a score needs. Rows of one path each have the words of all."""
    once, more = split_repeated(docs, nulls=False)
    found = row_postings(once, normalizer)
    return found if more is None else found.unionByName(_together(more, _by_path(more, normalizer)))


def _together(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(path, source, n_terms, term, freq) of documents that share paths: each row has what its path has in ``posted`` (path, term, freq)."""
    lengths = docs.select("path", length_column(docs).alias("n")).groupBy("path").agg(F.sum("n").alias("n_terms"))
    return docs.select("path", "source").join(posted, "path").join(lengths, "path").select("path", "source", "n_terms", "term", "freq")


#: A word and its repetitions in a text of sorted words between spaces; possessive, so that many need no deep recursion.
_RUN = r"([^ ]+)(?: \1(?![^ ]))*+"


def _in_rows(docs: DataFrame, key: list[str], normalizer: int | None) -> DataFrame:
    """(key..., n_terms, term, freq) of texts, counted inside each row: a text's words are sorted, and equal ones are a run, of which the length tells how many they are. Stems
    are made of a row's whole list; an empty one is a sign that no word has until it is counted."""
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  made by a generator, so that it is not made anew for each use
    own = words_column(lower_column(F.col("raw_text")) if normalizer == LOWER else F.col("raw_text"))
    if normalizer == STEM:
        rows = docs.select(*key, stems_column(own, "!").alias("stems")).select(*key, once(F.sort_array("stems"), "w")).where("size(w) > 0")
    else:
        rows = docs.select(*key, once(F.sort_array(own), "w")).where("size(w) > 0")
    rows = rows.select(*key, F.size("w").cast("long").alias("n_terms"), once(F.regexp_extract_all(F.array_join("w", " "), F.lit(_RUN), 0), "runs"))
    rows = rows.select(*key, "n_terms", F.explode("runs").alias("run")).select(*key, "n_terms", F.substring_index("run", " ", 1).alias("word"), "run")
    term = F.when(F.col("word") != "!", F.col("word")).otherwise("") if normalizer == STEM else F.col("word")
    return rows.select(*key, "n_terms", term.alias("term"), F.expr("(length(run) + 1) div (length(word) + 1)").alias("freq"))


def row_postings(docs: DataFrame, normalizer: int = LOWER) -> DataFrame:
    """``full_postings`` of documents of different paths. Nothing is aggregated over rows but what a document brings itself."""
    key = ["path", "source"]
    found = _in_rows(docs.where(~given()) if brings_words(docs) else docs, key, normalizer)
    if not brings_words(docs):
        return found
    own = docs.where(given()).select(*key, length_column(docs).alias("n_terms"), "raw_text", "words")
    counts = _counts(own, [*key, "n_terms"], lowered=normalizer == LOWER)
    return found.unionByName(counts.withColumnRenamed("word", "term") if normalizer == LOWER else renormalized(counts, normalizer))


def matching_postings(docs: DataFrame, forms: dict[str, str]) -> DataFrame:
    """The rows of ``full_postings`` whose words are in ``forms`` (word: term)."""

    def matching(rows: DataFrame, key: list[str]) -> DataFrame:
        found = _counts(rows, key, wanted=sorted(forms)) if forms else _counts(rows.limit(0), key)
        terms = F.create_map(*[F.lit(x) for pair in sorted(forms.items()) for x in pair])[F.col("word")] if forms else F.col("word")
        return found.withColumn("term", terms).groupBy(*key, "term").agg(F.sum("freq").alias("freq"))

    once, more = split_repeated(docs, nulls=False)
    ready = once.select("path", "source", length_column(docs).alias("n_terms"), *(c for c in ("raw_text", "words") if c in docs.columns))
    found = matching(ready, ["path", "source", "n_terms"])
    return found if more is None else found.unionByName(_together(more, matching(more, ["path"])))


def document_lengths(docs: DataFrame) -> DataFrame:
    """(path, n_terms): no shuffle, for every word counts whatever its normal form. Documents without words have none."""
    return docs.select("path", length_column(docs).alias("n_terms")).where("n_terms > 0")


def sorted_words(posted: DataFrame) -> DataFrame:
    """Corpus frequency of every term, most frequent first."""
    return posted.groupBy("term").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "term")


def reverse_map(posted: DataFrame) -> DataFrame:
    """(term, paths): the inverted index, paths ascending. A list per term is the feature here, so a frequent term's row is
    as long as the corpus; what scales is the stored index, which search reads."""
    return posted.groupBy("term").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def has_all(posted: DataFrame, terms: list[str]) -> DataFrame:
    """Paths of the documents that have all ``terms``."""
    need = sorted(set(terms))
    return posted.where(F.col("term").isin(need)).groupBy("path").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(need)).select("path")


def assembled(parts: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """(path, raw_text): the parts of each document joined in order. A document is one row, so its parts must fit in one."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.groupBy(F.col(key).cast("string").alias("path")).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), separator).alias("raw_text"))
