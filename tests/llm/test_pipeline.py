import public_tokenizers as P
from pyspark.sql import functions as F
from test_near import brute_texts
from test_tokens import check_packing, library

import corpus_pipeline
from loomtext.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    """Every stage against a plain version of it on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "packing"]
    language, toxic = queries.language_model(spark, sf_dir), queries.toxicity_model(spark, sf_dir)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(after.collect(), key=repr)
        if name == "packing":
            check_packing(got, [(r["doc_id"], r["text"]) for r in own], library("byte_bpe_50k.json"), 2048, 0)
            break
        assert after.columns == docs.columns
        if name == "language_id":
            expected = [r for r in own if not language.predict([r["text"]])[0][2]]
        elif name == "toxicity":
            expected = [r for r in own if toxic.score(r["text"]) < 0.7]
            assert len(expected) < len(own)
        else:
            gone = {i for i, kept in ((eval(x)[0], eval(x)[2]) for x in brute_texts([(r["doc_id"], r["text"]) for r in own])) if not kept}
            expected = [r for r in own if r["doc_id"] not in gone]
            assert gone
        assert got == sorted(expected, key=repr)
        docs = after


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 0
    assert P.path("byte_bpe_50k.json")


def test_stages_on_nasty_rows(spark, nasty, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage; then an empty table."""
    for where, docs in (("n", nasty), ("e", nasty.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{where}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{where}{k}")
            if name == "packing":
                check_packing(sorted(docs.collect(), key=repr), [(r["doc_id"], r["text"]) for r in before.collect()], library("byte_bpe_50k.json"), 2048, 0)
            else:
                assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
        assert (docs.count() == 0) == (where == "e")


def test_run_on_nasty_tables(spark, nasty, tmp_path):
    empty = "doc_id long, text string, lang string, source string, n_chars long"
    for where, docs in (("n", nasty.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))), ("e", spark.createDataFrame([], empty))):
        docs.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        spark.createDataFrame([(5, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{where}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{where}").collect()
        assert bool(got) == (where == "n")


def test_queries_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in rel.fetchall())
