"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, codes, html, langid, mixing, orderhash, packing, tokenfile, toxicity, vectors, warc, winnow
from .common import table


def fold(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(fold(5) != 0))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(3) != 1))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), report=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(codes.books_digest(books)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_winnowing, op2_toxicity, op3_html_text, op4_byte_bpe, op5_language_id, op6_best_fit_packing, op7_order_minhash, op8_flat_graph, op9_warc, op10_token_file, op11_source_mix, op12_vector_codes, op13_filter_audit)}

def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codebooks' rounds one after another, without weights: every part of every vector is assigned in every round."""
    out = f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS ints FROM embeddings
                   WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        p AS (SELECT vec_id, label, q.cell, ints[q.cell * (len(ints) // {parts}) + 1 : (q.cell + 1) * (len(ints) // {parts})] AS part FROM v, (SELECT unnest(range({parts})) AS cell) q),
        b0 AS (SELECT cell, entry, part FROM (SELECT cell, part, row_number() OVER (PARTITION BY cell ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries})"""
    far = "list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - b.part[i]) * (p.part[i] - b.part[i])))"
    for k in range(rounds + 1):
        out += f""", a{k} AS MATERIALIZED (SELECT vec_id, label, cell, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far
            FROM (SELECT p.vec_id, p.label, p.cell, p.part, b.entry, CAST({far} AS BIGINT) AS far FROM p JOIN b{k} b USING (cell)) GROUP BY ALL)"""
        if k < rounds:
            out += f""", m{k} AS (SELECT cell, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM (
                SELECT cell, entry, i, sum(part[i]) AS total, count(*) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
            b{k + 1} AS MATERIALIZED (SELECT cell, entry, coalesce(m{k}.part, b{k}.part) AS part FROM b{k} LEFT JOIN m{k} USING (cell, entry))"""
    return out + f""", c AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY cell) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY cell, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_FAILS = "ABCDE"

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_source_mix": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM d GROUP BY source),
        l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - (sum(2 * source_size) OVER upto - 2 * source_size)) / (sum(weight) OVER () - sum(weight) OVER upto + weight) AS level
              FROM s WINDOW upto AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT source, source_size, least(2e0 * source_size, max(level) OVER () * weight) AS target FROM l),
        p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS words, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken FROM p""",
    "op12_vector_codes": codes_sql(),
    "op13_filter_audit": f"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
        f AS (SELECT part, concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
                  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails,
                  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
        g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT concat(a.c, b.c, e.c, h.c, i.c) AS filter_order FROM x a, x b, x e, x h, x i WHERE len(list_distinct([a.c, b.c, e.c, h.c, i.c])) = 5),
        r AS (SELECT part, filter_order, fails, n, n_good, n_toxic, least({", ".join(f"CASE WHEN contains(fails, '{c}') THEN position('{c}' IN filter_order) ELSE 6 END" for c in _FAILS)}) AS out FROM g, o),
        v AS (SELECT part, filter_order[out] AS filter, sum(n) AS shapley FROM r WHERE out < 6 GROUP BY ALL),
        q AS (SELECT part, filter_order, step, filter_order[step] AS filter, sum(n) FILTER (out > step) AS kept, sum(n) FILTER (out = step) AS removed,
                  sum(n) FILTER (out < step AND contains(fails, filter_order[step])) AS redundant, sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
                  sum(n_good) FILTER (out = step) AS good_lost, sum(n_toxic) FILTER (out = step) AS toxic_lost
              FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY ALL)
        SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split())} FROM q LEFT JOIN v USING (part, filter)""",
    "op8_flat_graph": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id <= coalesce(c.m, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM f""",
}
