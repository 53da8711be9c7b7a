"""Registered queries over the driver's tables, each with its DuckDB counterpart.

The corpus is ``documents`` (path: the id as text, source: local); ``pages`` (path: the url, source: web, text: the html
with its tags) and ``conversations`` (turns joined) serve as further corpora.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import display, urls
from .functions.normalize import LOWER, STEM
from .functions.stemming import kinds_sql, measure_column, stem_column, stem_sql
from .functions.tokens import WORD, is_ascii, is_ascii_alphanumeric, is_ascii_digits, is_ascii_letters, utf8_length
from .operators import catalogue, postings as P
from .operators.search import AS_CODED, EXCLUDE, by_source, frequency_map, raw_frequency_search, response, search, search_batch, search_index
from .plans.query import ParsedQuery, parse_column, quoted_words_column
from .plans.statements import Select, run as run_statement
from .sources import messages
from .sources.files import Settings, Walk, download, read_text
from .store import DocumentStore, index_documents, read_index, write_index
from .streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

D = "(SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS source, text AS raw_text FROM documents)"
W = "(SELECT url AS path, 1 AS source, html AS raw_text FROM pages)"
TOKENS = f"regexp_extract_all(raw_text, '{WORD}')"
COUNTS = f"SELECT path, word, count(*) AS freq FROM (SELECT path, unnest({TOKENS}) AS word FROM {D}) GROUP BY ALL"
POSTINGS = f"SELECT path, term, count(*) AS freq FROM (SELECT path, lower(unnest({TOKENS})) AS term FROM {D}) GROUP BY ALL"
VOCABULARY = f"(SELECT DISTINCT unnest({TOKENS}) AS word FROM {D})"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is small; its rows are dealt to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("path"), F.lit(display.LOCAL).alias("source"), F.col("text").alias("raw_text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")).select(F.col("url").alias("path"), F.lit(display.WEB).alias("source"), F.col("html").alias("raw_text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assembled(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def search_sql(scored: str, plus: str = "", minus_words: str = "", like: str = "", normalizer: int = LOWER, minus: str = EXCLUDE, corpus: str = D, k: int | None = 10, post: str = "") -> str:
    """Written from the terms that a query is to have: those scored by position, the required and the excluded, all between
    spaces, and the LIKE pattern of its phrases. ``post``: SQL of (path, term, freq) if it is not from the texts."""
    rows = ", ".join(f"({i}, {literal(t)})" for i, t in enumerate(scored.split()))
    has = lambda w: f"EXISTS (SELECT 1 FROM post p WHERE p.path = d.path AND p.term = {literal(w)})"
    tests = [has(w) for w in plus.split()] + [has(w) if minus == AS_CODED else f"NOT {has(w)}" for w in minus_words.split()]
    if like:
        tests.append(f"raw_text LIKE {literal(like)} ESCAPE '\\'")
    stems = stem_sql(f"(SELECT DISTINCT unnest({TOKENS}) AS word FROM {corpus})") + ", " if normalizer == STEM else ""
    tokens = f"SELECT path, unnest({TOKENS}) AS word FROM {corpus}"
    tok = f"SELECT path, lower(word) AS term FROM ({tokens})" if normalizer == LOWER else f"SELECT path, stem AS term FROM ({tokens}) JOIN stems USING (word)"
    post = post or "SELECT path, term, count(*) AS freq FROM tok GROUP BY ALL"
    return f"""
        WITH {stems}tok AS ({tok}), post AS ({post}),
        ln AS (SELECT path, sum(freq) AS n FROM post GROUP BY 1), terms AS (SELECT * FROM (VALUES {rows}) t(pos, term)),
        ok AS (SELECT path, source FROM {corpus} d{' WHERE ' + ' AND '.join(tests) if tests else ''}),
        hit AS (SELECT pos, post.path, source, freq FROM terms JOIN post USING (term) JOIN ok ON ok.path = post.path),
        df AS (SELECT pos, count(*) AS df FROM hit GROUP BY 1)
        SELECT path, source, round(sum(CAST(freq AS DOUBLE) / n * log2((SELECT count(*) FROM {corpus}) * 1.0 / (df + 1))), 9) AS score
        FROM hit JOIN df USING (pos) JOIN ln USING (path) GROUP BY ALL ORDER BY score DESC, path{'' if k is None else f' LIMIT {k}'}"""


def searching(name: str, text: str, scored: str, plus: str = "", minus_words: str = "", like: str = "", corpus: Callable[[SparkSession, str], DataFrame] = documents, sql: str = D, indexed: bool = False, **options) -> None:
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(corpus(spark, sf_dir), text, **options)

    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, docs = scratch(spark), corpus(spark, sf_dir)
        write_index(docs, root, options.get("normalizer", LOWER))
        return search_index(docs, *read_index(spark, root), text, **options, n_docs=index_documents(spark, root))

    QUERIES[name] = stored if indexed else scan
    kept = {k: v for k, v in options.items() if k != "raw_phrases"}
    ORACLE_SQL[name] = search_sql(scored, plus, minus_words, like, corpus=sql, **kept)


def scratch(spark: SparkSession) -> str:
    """A new folder that all nodes share: under spark.checkpoint.dir; local sessions without it get a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        named = tempfile.mkdtemp(prefix="loomtext-")
    return f"{named}/scratch-{uuid.uuid4().hex}"


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# scans, lookups, counts


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def row_amount(spark, sf_dir):
    one = lambda t: catalogue.row_amount(spark.read.parquet(f"{sf_dir}/{t}.parquet")).select(F.lit(t).alias("name"), "n")
    return one("documents").union(one("pages")).union(one("conversations"))


@query(f"SELECT path, source, raw_text FROM {D}")
def scan_documents(spark, sf_dir):
    return documents(spark, sf_dir)


@query(f"SELECT path, source, raw_text FROM {D} WHERE path = '17'")
def lookup_document(spark, sf_dir):
    return catalogue.lookup(documents(spark, sf_dir), "path", "17")


@query("SELECT path FROM (VALUES ('3'), ('17'), ('no such path'), ('-1')) t(path) WHERE EXISTS (SELECT 1 FROM documents WHERE CAST(doc_id AS VARCHAR) = path)")
def document_exists(spark, sf_dir):
    wanted = fixture(spark, [("3",), ("17",), ("no such path",), ("-1",)], "path string")
    return catalogue.exists(documents(spark, sf_dir), "path", wanted)


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def select_statement(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/labels.parquet").createOrReplaceTempView("labels_view")
    return spark.sql(str(Select().queries("doc_id").from_("labels_view").where("toxic = 1")))


# words


@query(f"SELECT path, CAST(count(*) AS BIGINT) AS n_terms FROM (SELECT path, unnest({TOKENS}) AS w FROM {D}) GROUP BY 1")
def document_length(spark, sf_dir):
    return P.document_lengths(documents(spark, sf_dir))


@query(f"{COUNTS}")
def word_frequency(spark, sf_dir):
    return P.word_counts(documents(spark, sf_dir))


@query(COUNTS.replace(D, W))
def word_frequency_pages(spark, sf_dir):
    return P.word_counts(pages(spark, sf_dir))


@query(f"SELECT word, strlen(word) = len(word) AS ascii, regexp_full_match(word, '[A-Za-z]+') AS letters, regexp_full_match(word, '[0-9]+') AS digits, regexp_full_match(word, '[A-Za-z0-9]+') AS alphanumeric, CAST(strlen(word) AS INTEGER) AS bytes FROM {VOCABULARY}")
def word_classes(spark, sf_dir):
    w = F.col("word")
    return P.vocabulary(documents(spark, sf_dir)).select("word", is_ascii(w).alias("ascii"), is_ascii_letters(w).alias("letters"), is_ascii_digits(w).alias("digits"), is_ascii_alphanumeric(w).alias("alphanumeric"), utf8_length(w).alias("bytes"))


@query(POSTINGS)
def postings_lower(spark, sf_dir):
    return P.postings(documents(spark, sf_dir))


@query(f"SELECT path, lower(word) AS term, CAST(sum(freq) AS BIGINT) AS freq FROM ({COUNTS}) GROUP BY ALL")
def normalize_counts(spark, sf_dir):
    return P.word_counts(documents(spark, sf_dir), LOWER)


@query(f"WITH {stem_sql(VOCABULARY)} SELECT path, stem AS term, CAST(sum(freq) AS BIGINT) AS freq FROM ({COUNTS}) JOIN stems USING (word) GROUP BY ALL")
def postings_stemmed(spark, sf_dir):
    return P.postings(documents(spark, sf_dir), STEM)


@query(f"WITH {stem_sql(VOCABULARY)} SELECT word, stem FROM stems")
def stem_vocabulary(spark, sf_dir):
    return P.vocabulary(documents(spark, sf_dir)).select("word", stem_column(F.col("word")).alias("stem"))


@query(f"SELECT word, CAST(len(regexp_extract_all({kinds_sql('word')}, 'V+C+')) AS BIGINT) AS m FROM (SELECT DISTINCT lower(word) AS word FROM {VOCABULARY} WHERE regexp_full_match(word, '[A-Za-z]+'))")
def measure_vocabulary(spark, sf_dir):
    plain = P.vocabulary(documents(spark, sf_dir)).where(is_ascii_letters(F.col("word"))).select(F.lower("word").alias("word")).distinct()
    return plain.select("word", measure_column(F.col("word")).alias("m"))


@query(f"SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM ({POSTINGS}) GROUP BY 1 ORDER BY freq DESC, term")
def sorted_words(spark, sf_dir):
    return P.sorted_words(P.postings(documents(spark, sf_dir)))


@query(f"SELECT term, list(DISTINCT path ORDER BY path) AS paths FROM ({POSTINGS}) GROUP BY 1")
def reverse_map(spark, sf_dir):
    return P.reverse_map(P.postings(documents(spark, sf_dir)))


@query(f"SELECT path FROM ({POSTINGS}) WHERE term IN ('the', 'of', 'is') GROUP BY path HAVING count(DISTINCT term) = 3")
def all_keys(spark, sf_dir):
    return P.has_all(P.postings(documents(spark, sf_dir)), ["the", "of", "is"])


@query(f"SELECT path, freq FROM ({POSTINGS}) WHERE term = 'the' AND path IN (SELECT path FROM ({POSTINGS}) WHERE term = 'with') AND path NOT IN (SELECT path FROM ({POSTINGS}) WHERE term = 'from')")
def frequency_map_filtered(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return frequency_map(P.postings(docs), docs, "the", ParsedQuery("", ["with"], ["from"]))


@query(f"SELECT path, CAST(count(*) FILTER (term = 'the') AS DOUBLE) / count(*) AS tf FROM (SELECT path, lower(unnest({TOKENS})) AS term FROM {D}) GROUP BY 1 HAVING count(*) FILTER (term = 'the') > 0")
def term_frequency(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return P.postings(docs).where("term = 'the'").join(P.document_lengths(docs), "path").select("path", (F.col("freq") / F.col("n_terms")).alias("tf"))


@query(f"SELECT term, round(log2((SELECT count(*) FROM documents) * 1.0 / (count(*) + 1)), 9) AS idf FROM ({POSTINGS}) GROUP BY 1")
def inverse_frequency(spark, sf_dir):
    docs = documents(spark, sf_dir)
    n = docs.agg(F.count("*")).scalar().cast("double")
    return P.postings(docs).groupBy("term").agg(F.count("*").alias("df")).select("term", F.round(F.log2(n / (F.col("df") + 1)), 9).alias("idf"))


# search

searching("search_single", "with", "with")
searching("search_multi", "this that from", "this that from")
searching("search_duplicate_term", "with with from", "with with from")
searching("search_plus", "the +with +from", "the with from", plus="with from")
searching("search_minus_exclude", "the of -with -pour", "the of", minus_words="with pour")
searching("search_minus_as_coded", "the of -with", "the of", minus_words="with", minus=AS_CODED)
searching("search_phrase", 'with "of the"', "with of the", like="%of the%")
searching("search_two_phrases_ordered", 'is "of the" "and"', "is of the and", like="%of the%and%")
searching("search_phrase_pattern", 'is "of _he"', "is of he", like="%of _he%", raw_phrases=True)
searching("search_empty_quote", 'the "" with', "the with", like="%%")
searching("search_combined", 'this +the -pour "of the" with with', "this the with with of the", plus="the", minus_words="pour", like="%of the%")
searching("search_no_match", "nosuchwordanywhere", "nosuchwordanywhere")
searching("search_missing_plus", "the +nosuchwordanywhere", "the nosuchwordanywhere", plus="nosuchwordanywhere")
searching("search_all_results", "pour dans", "pour dans", k=None)
searching("search_stemmed", "ending things -pour", "end thing", minus_words="pour", normalizer=STEM)
searching("search_stemmed_plus", "ringing +are the", "ring are the", plus="are", normalizer=STEM)
searching("search_pages", "article the", "article the", corpus=pages, sql=W)
searching("search_web_and_files", "the html der", "the html der", corpus=lambda s, d: documents(s, d).union(pages(s, d)), sql=f"(SELECT * FROM {D} UNION ALL SELECT * FROM {W})")
_C = "(SELECT CAST(conv_id AS VARCHAR) AS path, 0 AS source, string_agg(text, chr(10) ORDER BY turn) AS raw_text FROM conversations GROUP BY conv_id)"
searching("search_conversations", "the with", "the with", corpus=lambda s, d: conversations(s, d).withColumn("source", F.lit(0)), sql=_C)
searching("indexed_search_multi", "this that from", "this that from", indexed=True)
searching("indexed_search_filters", 'this +the -pour "of the" with with', "this the with with of the", plus="the", minus_words="pour", like="%of the%", indexed=True)
searching("indexed_search_all", "pour dans", "pour dans", k=None, indexed=True)
searching("indexed_search_stemmed", "ringing +are the", "ring are the", plus="are", normalizer=STEM, indexed=True)

# Documents that bring their words: those in English, whose words are their language and their source.
_BROUGHT = f"SELECT path, term, count(*) AS freq FROM tok WHERE path NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en') GROUP BY ALL UNION ALL SELECT CAST(doc_id AS VARCHAR), unnest(['tongue', lower(source)]), unnest([n_chars + 1, 2]) FROM documents WHERE lang = 'en'"


@query(search_sql("tongue src1 die les", minus_words="src3", k=None, post=_BROUGHT))
def push_words_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    brought = F.create_map(F.lit("Tongue"), F.col("n_chars") + 1, F.col("source"), F.lit(2).cast("long"))
    docs = rows.select(F.col("doc_id").cast("string").alias("path"), F.lit(display.LOCAL).alias("source"), F.col("text").alias("raw_text"), F.when(F.col("lang") == "en", brought).alias("words"))
    return search(docs, "tongue src1 die les -src3", k=None)


@query(f"SELECT path, CAST(sum(freq) AS DOUBLE) AS score FROM ({POSTINGS}) WHERE term IN ('this', 'that') GROUP BY 1 ORDER BY score DESC, path LIMIT 10")
def raw_frequency(spark, sf_dir):
    return raw_frequency_search(P.postings(documents(spark, sf_dir)), "this that")


_BOTH = f"(SELECT * FROM {D} UNION ALL SELECT * FROM {W})"


@query(f"SELECT * FROM ({search_sql('the der', corpus=_BOTH, k=None)}) WHERE source = 1")
def filter_source(spark, sf_dir):
    return by_source(search(documents(spark, sf_dir).union(pages(spark, sf_dir)), "the der", k=None), web=True, files=False)


@query(f"SELECT * FROM ({search_sql('the', k=None)}) ORDER BY score DESC, path LIMIT 100")
def client_limit(spark, sf_dir):
    return search(documents(spark, sf_dir), "the", k=None).limit(100)


@query(f"SELECT printf('%d. Path: %s Score: %.2f, Source: local', row_number() OVER (ORDER BY score DESC, path) - 1, path, score) AS line FROM ({search_sql('this with')})")
def format_results(spark, sf_dir):
    from pyspark.sql import Window

    top = search(documents(spark, sf_dir), "this with")  # ten rows
    n = F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1
    return top.select(display.result_line(n, F.col("path"), F.col("score"), F.col("source")).alias("line"))


@query(f"""
    WITH asked AS (SELECT item_id, lower(unnest(regexp_extract_all(translate(text, '+-"', '   '), '{WORD}'))) AS term FROM benchmark),
    terms AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL), post AS ({POSTINGS}),
    ln AS (SELECT path, sum(freq) AS n FROM post GROUP BY 1), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    scored AS (SELECT item_id, path, round(sum(times * CAST(freq AS DOUBLE) / n * log2((SELECT count(*) FROM documents) * 1.0 / (df + 1))), 9) AS score
        FROM terms JOIN post USING (term) JOIN df USING (term) JOIN ln USING (path) GROUP BY ALL)
    SELECT item_id AS query_id, path, 0 AS source, score FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) <= 10""")
def search_benchmark(spark, sf_dir):
    """Every passage of the benchmark is a query to an engine that indexed all documents."""
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.translate("text", '+-"', "   ").alias("query"))
    store = DocumentStore(spark, scratch(spark))
    store.upsert(documents(spark, sf_dir))
    store.build_index()
    posted, n = store.segments()
    return search_batch(posted, asked, n)


# paths, urls, json, parts


@query("SELECT page_id, regexp_replace(url, '^.*[\\\\/]', '') AS name, regexp_extract(url, '(\\.[^./]*)$', 1) AS extension, regexp_extract(url, '(\\.[^./]*)$', 1) IN ('.html', '.htm') AS is_html FROM pages")
def page_names(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ext = display.extension(F.col("url"))
    return own.select("page_id", display.basename(F.col("url")).alias("name"), ext.alias("extension"), ext.isin(".html", ".htm").alias("is_html"))


@query("SELECT page_id, split_part(p, '=', 1) AS key, split_part(p, '=', 2) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''")
def url_query_values(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return own.select("page_id", F.explode(urls.query_pairs(urls.query_of(F.col("url")))).alias("p")).select("page_id", "p.key", "p.value")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_value_props(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", messages.json_value(F.col("props"), "k").alias("k"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, string_agg(text, chr(10) ORDER BY turn) AS raw_text FROM conversations GROUP BY conv_id")
def assemble_parts(spark, sf_dir):
    return conversations(spark, sf_dir)


@query(
    "WITH incoming AS (SELECT CAST(doc_id AS VARCHAR) AS path, 'rewritten ' || doc_id AS raw_text, 1 AS step FROM documents WHERE lang = 'de' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'again', 2 FROM documents WHERE source = 'src1' UNION ALL SELECT 'new/' || page_id, html, 1 FROM pages), fresh AS (SELECT path, raw_text FROM incoming QUALIFY row_number() OVER (PARTITION BY path ORDER BY step DESC) = 1) "
    f"SELECT path, raw_text FROM fresh UNION ALL SELECT path, raw_text FROM {D} WHERE path NOT IN (SELECT path FROM fresh)"
)
def push_documents_upsert(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id").cast("string").alias("path")
    incoming = docs.where("lang = 'de'").select(key, F.concat(F.lit("rewritten "), "doc_id").alias("raw_text"), F.lit(1).alias("step"))
    incoming = incoming.union(docs.where("source = 'src1'").select(key, F.lit("again"), F.lit(2)))
    incoming = incoming.union(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("new/"), "page_id"), "html", F.lit(1)))
    return catalogue.upsert(documents(spark, sf_dir).select("path", "raw_text"), incoming, "path", "step")


# catalogue



@query("SELECT 39002 AS port")
def generate_port(spark, sf_dir):
    return catalogue.next_port(fixture(spark, [(39000,), (39001,), (39003,)], "port int"))


@query("SELECT 39000 AS port")
def generate_first_port(spark, sf_dir):
    return catalogue.next_port(fixture(spark, [], "port int"))


@query("SELECT port, port BETWEEN 39000 AND 39499 AS valid FROM (VALUES (42), (38999), (39000), (39249), (39499), (39500)) t(port)")
def port_valid(spark, sf_dir):
    return fixture(spark, [(p,) for p in (42, 38999, 39000, 39249, 39499, 39500)], "port int").select("port", display.valid_port(F.col("port")).alias("valid"))


@query("SELECT 'one' AS id, '1' AS indexer_id, 'Text' AS indexer_name, 39000 AS port UNION ALL SELECT 'two', '1', 'Text', 39000 UNION ALL SELECT 'three', '2', 'Scans', 39001")
def collection_indexer_join(spark, sf_dir):
    indexers = fixture(spark, [("1", "Text", "read", [], 39000), ("2", "Scans", "scan", ["-x"], 39001)], catalogue.INDEXER)
    collections = fixture(spark, [(i, f"/{i}", x, True, "dir", False, 0) for i, x in (("one", "1"), ("two", "1"), ("three", "2"), ("four", None))], catalogue.COLLECTION)
    return catalogue.with_indexer(collections, indexers).select("id", "indexer_id", "indexer_name", "port")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def orphan_labels(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return catalogue.orphans(read("labels"), "doc_id", read("documents"), "doc_id").select("doc_id")


@query("SELECT n, CASE n WHEN 0 THEN 'file' WHEN 1 THEN 'dir' WHEN 2 THEN 'url' ELSE 'unknown' END AS name FROM (VALUES (0), (1), (2), (7)) t(n)")
def source_types(spark, sf_dir):
    return fixture(spark, [(0,), (1,), (2,), (7,)], "n int").select("n", display.source_type_name(F.col("n")).alias("name"))


_MESSAGES = [messages.success("", [{"Path": "test/path/1", "Source": 0, "Words": {"first": 1, "second": 2}, "Collection": "c", "RawText": "first second second"}, {"Path": "test/path/2", "Source": 1, "Words": {"green": 42, "blue": 5}, "Collection": "c", "RawText": ""}]), messages.fail("broken"), messages.pong(), "not json"]


@query("SELECT * FROM (VALUES ('test/path/1', 'first', CAST(1 AS BIGINT)), ('test/path/1', 'second', 2), ('test/path/2', 'green', 42), ('test/path/2', 'blue', 5)) t(path, word, freq)")
def pushed_words(spark, sf_dir):
    return messages.word_rows(messages.documents(fixture(spark, [(m,) for m in _MESSAGES], "value string")))


# Queries and what they are parsed to.
PARSES = [
    ('test +at "hello world" -the +next "hihi" you -joke', "test at   next  you ", ["at", "next"], ["the", "joke"], ["hello world", "hihi"]),
    ("well-known fact", "well fact", [], ["known"], []),
    ("c++ x", "c+ x", ["+"], [], []),
    ("- foo bar", " bar", [], [" foo"], []),
    ('+"hello world"', '"hello world', ['"hello'], [], []),
    ('a "b" "c', "a  ", [], [], ["b"]),
    ("--a", "", [], ["-a"], []),
    ("Plain Words", "Plain Words", [], [], []),
    ("+UPPER -LOWER", "UPPER ", ["upper"], ["lower"], []),
]


def _list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(map(literal, xs)) + "] AS VARCHAR[])"


@query("SELECT * FROM (VALUES " + ", ".join(f"({literal(q)}, {literal(m)}, {_list(p)}, {_list(x)}, {_list(t)})" for q, m, p, x, t in PARSES) + ") t(query, modified, plus, minus, quotes)")
def parse_query_cases(spark, sf_dir):
    rows = fixture(spark, [(q,) for q, *_ in PARSES], "query string")
    return rows.select("query", parse_column(F.col("query")).alias("p")).select("query", "p.*")


# Words and their stems.
STEMS = dict(
    x.split(":")
    for x in "element:element losing:lose fizzing:fizz allowance:allow tanned:tan controlling:control failing:fail filing:file rational:ration valency:valenc hesitancy:hesit conformability:conform radical:radic formative:form formalize:formal electricity:electr electrical:electr hopefulness:hope goodness:good feed:fe need:ne agreed:agree cease:cease typing:typ digitize:digitiz roll:rol rolling:rol as:a is:i s: Für:für hello123:hello123 happy:happi sky:sky".split()
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({literal(w)}, {literal(s)})" for w, s in STEMS.items()) + ") t(word, stem)")
def stem_cases(spark, sf_dir):
    return fixture(spark, [(w,) for w in STEMS], "word string").select("word", stem_column(F.col("word")).alias("stem"))


# what changes and what is stored


_TWICE = "SELECT source AS path, 'again ' || max(doc_id) AS raw_text, map(['n'], [max(doc_id)]) AS words FROM documents WHERE source IS NOT NULL GROUP BY 1"


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, value): a message of every document, numbered by its id, in which its source is put twice."""
    one = lambda text, words: F.struct(F.col("source").alias("Path"), F.lit(0).alias("Source"), words.alias("Words"), F.lit("c").alias("Collection"), text.alias("RawText"))
    words = F.create_map(F.lit("n"), F.col("doc_id"))
    found = F.array(one(F.col("text"), words), one(F.concat(F.lit("again "), "doc_id"), words))
    message = F.struct(F.lit("success").alias("status"), F.struct(F.lit("").alias("message"), found.alias("documents")).alias("data"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").select(F.col("doc_id").alias("number"), F.to_json(message).alias("value"))


@query(_TWICE)
def push_last_wins(spark, sf_dir):
    store = DocumentStore(spark, scratch(spark))
    store.upsert(messages.documents(_pushes(spark, sf_dir), number=F.col("number")))
    return store.read().select("path", "raw_text", "words")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'de' THEN 'third' WHEN source = 'src1' THEN 'second' ELSE text END AS raw_text FROM documents")
def store_upserts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    put = lambda df, text: df.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("source"), text.alias("raw_text"))
    store = DocumentStore(spark, scratch(spark), fan=2)  # sets are made one on the way
    store.upsert(put(rows, F.col("text")))
    store.upsert(put(rows.where("source = 'src1'"), F.lit("second")))
    store.upsert(put(rows.where("lang = 'de'"), F.lit("third")))
    return store.read().select("path", "raw_text")


@query("SELECT CAST(conv_id AS VARCHAR) AS path, arg_max(text, turn) AS raw_text FROM conversations GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Turns arrive as messages in files; the last turn of a conversation stays."""
    root = scratch(spark)
    one = F.struct(F.col("conv_id").cast("string").alias("Path"), F.lit(0).alias("Source"), F.lit(None).cast("map<string,bigint>").alias("Words"), F.lit("c").alias("Collection"), F.col("text").alias("RawText"))
    message = F.struct(F.lit("success").alias("status"), F.struct(F.lit("").alias("message"), F.array(one).alias("documents")).alias("data"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").repartition(8, "conv_id").sortWithinPartitions("conv_id", "turn")
    turns.select(F.to_json(message).alias("value")).write.text(f"{root}/inbox")
    store = DocumentStore(spark, f"{root}/documents")
    ingest(spark, f"{root}/inbox", store, f"{root}/progress", files_per_batch=3).awaitTermination()
    return store.read().select("path", "raw_text")


_CHANGED = """(SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS source, CASE WHEN lang = 'de' THEN 'rewritten with ' || doc_id || ' from ' || doc_id % 7 WHEN source = 'src1' THEN 'again with ' || coalesce(text, '') ELSE text END AS raw_text FROM documents
    UNION ALL SELECT 'new/' || page_id, 1, html FROM pages)"""


def changed_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that indexed all documents and was given changes and new documents after that."""
    e = Engine(spark, scratch(spark))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    put = lambda df, path, source, text: e.store.upsert(df.select(path.alias("path"), F.lit(source).alias("source"), text.alias("raw_text")))
    key = F.col("doc_id").cast("string")
    put(rows, key, 0, F.col("text"))
    e.build_index()
    put(rows.where("source = 'src1'"), key, 0, F.concat(F.lit("again with "), F.coalesce("text", F.lit(""))))
    put(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.concat(F.lit("new/"), "page_id"), 1, F.col("html"))
    put(rows.where("lang = 'de'"), key, 0, F.concat(F.lit("rewritten with "), "doc_id", F.lit(" from "), F.col("doc_id") % 7))
    return e


@query(search_sql("the with html 3", minus_words="again", corpus=_CHANGED, k=None))
def indexed_after_push(spark, sf_dir):
    """The index follows what is put: replaced documents are not found, new ones are, and no text is read."""
    return changed_engine(spark, sf_dir).search("the with html 3 -again", k=None)


@query(search_sql("with of the and", like="%of the and%", corpus=_CHANGED, k=None))
def indexed_phrase(spark, sf_dir):
    """A phrase over documents that changed after they were indexed: texts are read of those that can have it by their terms."""
    return changed_engine(spark, sf_dir).search('with "of the and"', k=None)


@query(f"SELECT path, source, raw_text FROM {_CHANGED}")
def documents_after_push(spark, sf_dir):
    return changed_engine(spark, sf_dir).documents().select("path", "source", "raw_text")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, value): a message of every document; some are cut off, some say that their reader failed, some hold nothing or a document without a path."""
    one = lambda path: F.struct(path.alias("Path"), F.lit(0).alias("Source"), F.lit(None).cast("map<string,bigint>").alias("Words"), F.lit("c").alias("Collection"), F.col("text").alias("RawText"))
    key = F.col("doc_id").cast("string")
    found = F.when(F.col("doc_id") % 5 == 1, F.array().cast("array<struct<Path:string,Source:int,Words:map<string,bigint>,Collection:string,RawText:string>>"))
    found = found.when(F.col("doc_id") % 5 == 2, F.array(one(key), one(F.lit(None).cast("string")))).otherwise(F.array(one(key)))
    status = F.when(F.col("doc_id") % 5 == 3, "fail").otherwise("success")
    message = F.to_json(F.struct(status.alias("status"), F.struct(F.concat(F.lit("about "), "doc_id").alias("message"), found.alias("documents")).alias("data")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 5 == 4, F.substring(message, 1, 20)).otherwise(message).alias("value"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS message, CASE WHEN doc_id % 5 IN (0, 2) THEN 'accepted' ELSE 'refused' END AS status,
    CASE doc_id % 5 WHEN 1 THEN 'no documents' WHEN 2 THEN '1 documents without a path' WHEN 3 THEN 'the reader failed: about ' || doc_id WHEN 4 THEN 'not a message' END AS error,
    CAST(doc_id % 5 IN (0, 2) AS BIGINT) AS documents FROM documents""")
def push_outcomes(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.push_documents(_broken(spark, sf_dir))
    return e.outcomes().select("message", "status", "error", "documents")


@query(f"SELECT path, raw_text FROM {D} WHERE CAST(path AS BIGINT) % 5 IN (0, 2)")
def push_accepted(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.push_documents(_broken(spark, sf_dir))
    return e.documents().select("path", "raw_text")


_FLAT = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"


@query(f"SELECT source AS folder, CAST(sum(len(regexp_extract_all({_FLAT}, '{WORD}'))) AS BIGINT) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1")
def read_folder(spark, sf_dir):
    """Texts written as files in a folder a source, read back without two of them."""
    root = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flat = rows.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"), F.concat(F.lit("in-"), "source").alias("folder"))
    flat.write.partitionBy("folder").option("maxRecordsPerFile", 1000).text(f"{root}/texts")
    found = read_text(spark, Settings(f"{root}/texts", display.DIRECTORY, walk=Walk(forbidden=("folder=in-src1", "folder=in-src2"))))
    folder = F.regexp_extract(F.col("path"), "folder=in-([^/]+)/[^/]*$", 1).alias("folder")
    return found.select(folder, P.length_column(found).alias("n")).groupBy("folder").agg(F.sum("n").alias("n"))


@query("SELECT '/somewhere' AS path, 'Local text' AS name, 39001 AS port, 'dir' AS source_type, true AS known, true AS gone, true AS id_form")
def register_and_scan(spark, sf_dir):
    """Two readers are registered, a collection is given to the second, the first is removed."""
    e = Engine(spark, scratch(spark))
    first, second = e.register_indexer(), e.register_indexer()
    e.register_collection("/somewhere", second)
    e.unregister_indexer(first)
    again = Engine(spark, e.root)  # reads what the first one stored
    known = catalogue.exists(again.indexers(), "id", fixture(spark, [(second,)], "id string")).agg((F.count("*") == 1).alias("known"))
    gone = catalogue.lookup(again.indexers(), "id", first).agg((F.count("*") == 0).alias("gone"))
    joined = catalogue.with_indexer(again.collections(), again.indexers())
    return joined.join(known).join(gone).select("path", F.col("indexer_name").alias("name"), "port", "source_type", "known", "gone", F.col("id").rlike("^[0-9]{10}[0-9a-f]{4}$").alias("id_form"))  # one row each


@query("SELECT CAST(doc_id AS VARCHAR) AS path, text AS content FROM documents WHERE doc_id = 17")
def download_document(spark, sf_dir):
    return download(documents(spark, sf_dir), "./17").select("path", F.col("content").cast("string").alias("content"))


@query("SELECT CAST(json_object('doc_id', doc_id, 'quality', quality, 'toxic', toxic) AS VARCHAR) AS value FROM labels")
def labels_as_json(spark, sf_dir):
    return messages.as_json(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


@query("SELECT * FROM (VALUES ('success', 'pong', 0), ('success', 'exiting', 0), ('fail', 'broken', 0), ('success', '', 2)) t(status, message, n)")
def jsend_messages(spark, sf_dir):
    rows = [messages.pong(), messages.exiting(), messages.fail("broken"), _MESSAGES[0]]
    found = messages.parsed(fixture(spark, [(m,) for m in rows], "value string"))
    return found.select("status", F.col("data.message").alias("message"), F.coalesce(F.size("data.documents"), F.lit(0)).alias("n"))


@query(f"SELECT conv_id, turn, regexp_extract_all(text, '{WORD}') AS words FROM conversations WHERE text IS NOT NULL")
def words_of_phrases(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    return rows.select("conv_id", "turn", quoted_words_column(F.split("text", " ")).alias("words"))


@query("SELECT page_id, coalesce(nullif(concat_ws(' ', CASE WHEN q LIKE 'page=%' THEN split_part(split_part(q, '=', 2), '&', 1) END), ''), '') AS page FROM (SELECT page_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages)")
def url_joined_keys(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return own.select("page_id", F.coalesce(urls.joined_keys(urls.query_of(F.col("url")), "page"), F.lit("")).alias("page"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown, epoch_us(ts) = epoch_us(CAST(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS TIMESTAMP)) AS same FROM events")
def event_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp_ltz")
    shown = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select("event_id", shown.alias("shown"), (display.read_time(display.time_text(at)) == at).alias("same"))


@query("SELECT port, CAST(port AS VARCHAR) AS shown FROM (VALUES (42), (39000), (39499)) t(port)")
def port_texts(spark, sf_dir):
    return fixture(spark, [(42,), (39000,), (39499,)], "port int").select("port", display.port_text(F.col("port")).alias("shown"))


@query(f"SELECT 'this with' AS query, row_number() OVER (ORDER BY score DESC, path) - 1 AS place, path, score FROM ({search_sql('this with')})")
def search_response(spark, sf_dir):
    found = response(search(documents(spark, sf_dir), "this with"), "this with")
    return found.select("query", F.posexplode("results").alias("place", "r")).select("query", F.col("place").cast("long").alias("place"), F.col("r.Path").alias("path"), F.col("r.Score").alias("score"))


@query("SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0")
def bound_statement(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/labels.parquet").createOrReplaceTempView("labels_bound")
    return run_statement(spark, Select().queries("doc_id").from_("labels_bound").where("toxic = :toxic AND quality = :quality"), toxic=1, quality=0)
