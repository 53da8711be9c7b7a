from collections import Counter
from math import log2

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions.normalize import LOWER, STEM, normalize
from loomtext.functions.tokens import words
from loomtext.operators import postings as P
from loomtext.operators import search as search_module
from loomtext.operators.search import AS_CODED, by_source, frequency_map, like_pattern, phrase_words, raw_frequency_search, response, search, search_batch, search_index
from loomtext.plans.query import ParsedQuery, parse, quoted_words
from loomtext.plans.statements import Select, Update, insert_into, json_value
from loomtext.queries import PARSES

DOCS = [
    ("a", 0, "The cat sat on the mat"),
    ("b", 0, "the dog sat"),
    ("c", 1, "A cat and a dog: hello world, hello"),
    ("d", 0, ""),
    ("e", 1, None),
    ("f", 0, "100% sure_thing s"),
    ("g", 0, "the dog sat"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, source int, raw_text string")


def found(df):
    return [(r["path"], round(r["score"], 6)) for r in df.collect()]


@pytest.mark.parametrize("case", PARSES)
def test_parse(case):
    text, modified, plus, minus, quotes = case
    assert parse(text) == ParsedQuery(modified, plus, minus, quotes)


def test_quoted_words():
    assert quoted_words(["test1 test2  test3  ", "hello world!", "*^good??error(()"]) == ["test1", "test2", "test3", "hello", "world", "good", "error"]


@given(st.text(alphabet='ab +-"ü', max_size=30))
@settings(max_examples=200, deadline=None)
def test_parse_keeps_plain_text(text):
    p = parse(text)
    assert '"' not in "".join(p.quotes)
    if not set(text) & set('+-"'):
        assert p == ParsedQuery(text)


def brute(query, minus="exclude", n_docs=len(DOCS)):
    from loomtext.functions.tokens import words

    p = parse(query)
    rows = {path: [w.lower() for w in words(t or "")] for path, _, t in DOCS}
    texts = {path: t or "" for path, _, t in DOCS}
    ok = []
    for path, ws in rows.items():
        at, good = 0, True
        for q in p.quotes:
            k = texts[path].find(q, at)
            good, at = good and k >= 0, k + len(q)
        good = good and all(w in ws for w in p.plus)
        good = good and (all(w in ws for w in p.minus) if minus == AS_CODED else not any(w in ws for w in p.minus))
        if good:
            ok.append(path)
    scores = {}
    for t in p.terms():
        hits = [x for x in ok if t in rows[x]]
        for x in hits:
            scores[x] = scores.get(x, 0) + rows[x].count(t) / len(rows[x]) * log2(n_docs / (len(hits) + 1))
    return [(x, round(s, 6)) for x, s in sorted(scores.items(), key=lambda e: (-round(e[1], 9), e[0]))]


QUERIES = ["cat", "cat dog", "cat cat dog", "the +dog", "the -dog", "sat -cat -dog", '"hello world"', 'cat "hello" "hello"', "+cat +dog", "nothing", "THE"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_by_scan_and_index(docs, query):
    assert found(search(docs, query)) == brute(query)
    assert found(search_index(docs, P.postings(docs), P.document_lengths(docs), query)) == brute(query)


def test_minus_as_coded(docs):
    for q in ("sat -dog", "the -cat -mat"):
        assert found(search(docs, q, minus=AS_CODED)) == brute(q, AS_CODED)
        assert found(search_index(docs, P.postings(docs), P.document_lengths(docs), q, minus=AS_CODED)) == brute(q, AS_CODED)


def test_limits_and_empty(docs, spark):
    assert len(found(search(docs, "the cat dog sat", k=2))) == 2
    assert found(search(docs, "")) == [] and found(search(docs, "!!")) == []
    assert found(search(docs.limit(0), "cat")) == []
    assert found(search(docs.limit(0), "cat", normalizer=STEM)) == []


def test_phrase_signs(docs):
    assert found(search(docs, 'sure_thing "100%"')) != []
    assert found(search(docs, 'cat "c_t"')) == [] and len(found(search(docs, 'cat "c_t"', raw_phrases=True))) == 2
    assert like_pattern(["a%", "b_", "c\\"]) == "%a\\%%b\\_%c\\\\%"


def test_stemmed(docs):
    assert [p for p, _ in found(search(docs, "cats", normalizer=STEM))] == ["a", "c"]
    # the stem of "s" is the empty word: it counts in the length but cannot be found
    posted = P.postings(docs, STEM)
    assert posted.where("path = 'f' AND term = ''").count() == 1
    assert found(search(docs, "s", normalizer=STEM)) == []


def test_hand_computed(spark):
    d1, d2 = ("/some/path", 0, "key1 key2 key2"), ("/some/other/path", 0, "key2 key2 key2 key3 key3 key3 key3")
    one, both = (spark.createDataFrame(x, "path string, source int, raw_text string") for x in ([d1], [d1, d2]))
    assert found(search(one, "key1")) == [("/some/path", -0.333333)]
    assert found(search(one, "badkey")) == []
    assert found(search(both, "key1")) == [("/some/path", 0.0)]
    assert found(search(both, "key2")) == [("/some/other/path", -0.250698), ("/some/path", -0.389975)]


def test_same_for_any_partitions(docs):
    assert found(search(docs.repartition(5), "cat dog the")) == found(search(docs.coalesce(1), "cat dog the"))


def test_ties_go_by_path(docs):
    assert [p for p, _ in found(search(docs, "dog sat"))[:2]] == ["b", "g"]


def test_postings(docs):
    total = P.postings(docs).agg(F.sum("freq")).first()[0]
    assert total == P.document_lengths(docs).agg(F.sum("n_terms")).first()[0] == P.word_counts(docs).agg(F.sum("freq")).first()[0]
    assert {r["path"] for r in P.has_all(P.postings(docs), ["cat", "dog"]).collect()} == {"c"}
    assert P.reverse_map(P.postings(docs)).where("term = 'cat'").first()["paths"] == ["a", "c"]
    assert P.sorted_words(P.postings(docs)).first()["term"] == "the"
    query = ParsedQuery("", ["dog"], ["cat"])
    assert {(r["path"], r["freq"]) for r in frequency_map(P.postings(docs), docs, "the", query).collect()} == {("b", 1), ("g", 1)}


def test_results(docs):
    r = response(search(docs, "cat dog"), "cat dog").first()
    assert r["query"] == "cat dog" and [x["Path"] for x in r["results"]] == [p for p, _ in brute("cat dog")]
    assert {x["path"] for x in by_source(search(docs, "cat"), web=True, files=False).collect()} == {"c"}
    assert [x["path"] for x in raw_frequency_search(P.postings(docs), "hello hello cat").collect()] == ["c", "a"]


def test_plan_of_a_scan(docs):
    plan = search(docs, "cat +dog")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "SortMergeJoin" not in plan


def test_statements():
    assert str(Select().query_all().from_("t").where("a = 1")) == "SELECT * FROM t WHERE a = 1"
    assert str(Update("t").set("a = 1", "b = 2").where("c")) == "UPDATE t SET a = 1, b = 2 WHERE c"
    assert insert_into("t", ["a", "b"]) == "INSERT INTO t (a, b) VALUES ($1, $2)"
    assert json_value("words", "cat", "n") == "JSON_VALUE( words , '$.cat' ) AS n"


@pytest.mark.parametrize("normalizer", [0, 1, 2])
def test_postings_counted_inside_rows(spark, normalizer):
    texts = ["The the THE cat's cat", None, "", " .,! ", "word " * 40_000, "a " * 3 + "aa a aaa", "Ünï Σσς é é", "losing lose loses lost", "x" * 5000]
    rows = [(f"p{i}", i % 2, t, None) for i, t in enumerate(texts)] + [("m", 0, "not these", {"Own": 2, "own": 3, "words": 1}), ("n", 1, "but these these", {})]
    docs = spark.createDataFrame(rows, "path string, source int, raw_text string, words map<string,bigint>").repartition(3)
    for df in (docs, docs.drop("words")):
        got, expected = (sorted(map(tuple, f(df, normalizer).select("path", "source", "n_terms", "term", "freq").collect())) for f in (P.row_postings, P.full_postings))
        assert got == expected and len(got) > 15


@pytest.mark.parametrize("normalizer", [0, STEM])
@pytest.mark.parametrize("minus", ["exclude", AS_CODED])
def test_a_batch_is_its_queries_one_by_one(spark, normalizer, minus):
    texts = ["the cats of the town", "a cat and the dog", "dogs of the_town, 100% dogs", "", None, "the the the", "town hall; the mayor's cat", "cat cat cat"]
    docs = spark.createDataFrame([(f"p{i}", i % 2, t) for i, t in enumerate(texts)], "path string, source int, raw_text string").repartition(2)
    asked = ["cat", "the town", "cat cat the", "+cat the", "the -cat", "+the -town -dog dogs", '"of the" cat', 'the "the" "town"', 'dogs "the_town"', 'dogs "100%"', '"a_c"', "nowhere", "", '""', "+ cat", "cat -cat", '+cat "cat"']
    posted = P.row_postings(docs, normalizer)
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(99, None)], "query_id int, query string")
    for raw in (False, True) if normalizer == 0 and minus == "exclude" else (False,):
        got = {}
        for r in search_batch(posted, queries, len(texts), 3, normalizer, minus, raw, docs).collect():
            got.setdefault(r["query_id"], []).append((r["path"], r["source"], r["score"]))
        for i, q in enumerate(asked):
            expected = [tuple(r) for r in search_index(docs, posted, None, q, 3, normalizer, minus, raw, n_docs=len(texts)).collect()]
            assert sorted(got.get(i, [])) == sorted(expected), q


def test_a_batch_over_a_store_moves_only_what_is_best(spark, sf_dir, tmp_path):
    from loomtext.engine import Engine

    e = Engine(spark, str(tmp_path / "e"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("source"), F.col("text").alias("raw_text"))
    asked = ["the of", "with +from", "is -the", "and of and"]
    e.store.upsert(docs)
    scanned = sorted(map(tuple, e.search_many(asked).collect()))
    e.build_index()
    e.store.upsert(docs.where("path % 7 = 1"))
    found = e.search_many(asked)
    assert sorted(map(tuple, found.collect())) == scanned == sorted((q, *r) for q in asked for r in map(tuple, e.search(q).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.split("\n") if " Exchange " in x]
    assert dealt and all("path" not in x.split("ENSURE")[0] for x in dealt) and "raw_text" not in plan and "WindowGroupLimit" in plan


@given(st.lists(st.text(alphabet="aAbß İΣς,%_\\\\", max_size=12), min_size=1, max_size=2), st.text(alphabet="aAbß İΣς,", max_size=30), st.sampled_from([LOWER, STEM, 2]))
@settings(max_examples=300, deadline=None)
def test_a_text_with_a_phrase_meets_its_terms(quotes, around, normalizer):
    """Of any phrases and any text made with them: what they ask of terms is true of one of the text's own."""
    from loomtext.functions.normalize import normalize
    from loomtext.functions.tokens import words

    text = around[:10] + around[10:20].join(quotes) + around[20:]
    own = [normalize(w, normalizer) for w in words(text)]
    asked = phrase_words(quotes, normalizer)
    tests = {"whole": str.__eq__, "beginning": str.startswith, "end": str.endswith, "part": str.__contains__}
    assert all(any(tests[kind](t, w) for t in own) for kind, w in asked)


def test_what_phrases_ask_of_terms():
    assert phrase_words(["of The, house"], LOWER) == [("whole", "the"), ("beginning", "house")]
    assert phrase_words(["rolling stones gather"], STEM) == [("whole", "stone")]
    assert phrase_words(["ing"], LOWER) == [("part", "ing")] and phrase_words(["ing "], LOWER) == [("end", "ing")]
    assert phrase_words([" ing"], LOWER) == [("beginning", "ing")] and phrase_words([", ", ""], LOWER) == []
    assert phrase_words([" a_b %cd "], LOWER, raw=True) == [("beginning", "a")]
    assert phrase_words([" a_b %cd "], LOWER) == [("whole", "a"), ("whole", "b"), ("whole", "cd")]
    assert phrase_words(["ing"], STEM) == []


PHRASES = ['"hello world"', 'the "at sat"', 'the "he"', 'the ", " -dog', 'the "cat" "sat"', 'the "the "']


@pytest.mark.parametrize("most", [0, 500])
@pytest.mark.parametrize("normalizer", [LOWER, STEM])
def test_phrases_by_listed_and_by_joined_documents(docs, monkeypatch, most, normalizer):
    monkeypatch.setattr(search_module, "MOST_PATHS", most)
    stored = P.full_postings(docs, normalizer).cache()
    for q in PHRASES:
        assert found(search_index(docs, stored, None, q, normalizer=normalizer)) == found(search(docs, q, normalizer=normalizer)), q
    for q in ('the "c_t"', 'the "c%t s"'):
        assert found(search_index(docs, stored, None, q, normalizer=normalizer, raw_phrases=True)) == found(search(docs, q, normalizer=normalizer, raw_phrases=True)), q


def test_stems_of_more_forms_than_may_be_listed(docs, monkeypatch):
    usual = [found(search(docs, q, normalizer=STEM)) for q in QUERIES]
    monkeypatch.setattr(search_module, "MOST_FORMS", 0)
    assert [found(search(docs, q, normalizer=STEM)) for q in QUERIES] == usual


REPEATED = [("a", 0, "the cat the dog"), ("a", 0, "die katze"), ("a", 1, "the THE end, things ending s"), ("b", 0, "the dog"), ("c", 1, "katze"), ("c", 1, "katze"), (None, 0, "the the cat"), (None, 0, "the"), ("d", 0, None)]


@pytest.mark.parametrize("normalizer", [LOWER, STEM])
def test_rows_of_one_path_have_the_words_of_all(spark, normalizer):
    docs = spark.createDataFrame(REPEATED, "path string, source int, raw_text string")
    each = [(p, s, w) for p, s, t in REPEATED for w in words(t or "")]
    assert {(r["path"], r["word"]): r["freq"] for r in P.word_counts(docs).collect()} == Counter((p, w) for p, _, w in each)
    freq = Counter((p, normalize(w, normalizer)) for p, _, w in each)
    assert {(r["path"], r["term"]): r["freq"] for r in P.postings(docs, normalizer).collect()} == freq
    docs, named = docs.where("path IS NOT NULL"), [(p, s) for p, s, _ in REPEATED if p is not None]
    length = Counter(p for p, _, _ in each)
    for query, scored, wanted, unwanted in (("the +dog", "the dog", "dog", ""), ("the katze things -cat", "the katze things", "", "cat")):
        ok = [(p, s) for p, s in named if (not wanted or freq[p, normalize(wanted, normalizer)]) and not (unwanted and freq[p, normalize(unwanted, normalizer)])]
        score = Counter()
        for t in (normalize(w, normalizer) for w in scored.split()):
            df = sum(freq[p, t] > 0 for p, _ in ok)
            for p, s in ok:
                if freq[p, t]:
                    score[p, s] += freq[p, t] / length[p] * log2(len(named) / (df + 1))
        want = {x: pytest.approx(y, abs=1e-8) for x, y in score.items()}
        for got in (search(docs, query, k=None, normalizer=normalizer), search_index(docs, P.full_postings(docs, normalizer), None, query, k=None, normalizer=normalizer)):
            assert {(r["path"], r["source"]): r["score"] for r in got.collect()} == want, query


@pytest.mark.parametrize("f", [P.word_counts, P.postings, lambda d: P.postings(d, STEM), P.full_postings, lambda d: P.full_postings(d, STEM)])
def test_counts_of_different_paths_are_not_gathered(spark, f):
    docs = spark.createDataFrame([(str(i), 0, f"word of {i}") for i in range(20)], "path string, source int, raw_text string")
    plan = f(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("normalizer", [None, LOWER, STEM])
@pytest.mark.parametrize("size", [P.ADDED_TEXT, 8])
def test_counts_of_one_path_are_added_by_tasks_of_bounded_text(spark, monkeypatch, normalizer, size):
    monkeypatch.setattr(P, "ADDED_TEXT", size)
    docs = spark.createDataFrame([(*r, {"The": 2, "ends": 1} if r[2] == "die katze" else None) for r in REPEATED], "path string, source int, raw_text string, words map<string,bigint>")
    found = P.word_counts(docs, normalizer)
    term = lambda w: w if normalizer is None else normalize(w, normalizer)
    each = [(p, term(w)) for p, _, t in REPEATED for w in (["The", "The", "ends"] if t == "die katze" else words(t or ""))]
    assert {(r[0], r[1]): r["freq"] for r in found.collect()} == Counter(each) and found.count() == len(set(each))
    if size == 8:  # tasks go by the text of the rows that share paths, not by the session's partitions
        n = sum(len(t or "") for p, _, t in REPEATED if p in ("a", "c", None))
        assert "hashpartitioning(path#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {-(-n // 8)}), REPARTITION_BY_NUM" in plan


def test_counts_are_normalized_inside_rows(spark):
    docs = spark.createDataFrame([("a", 0, "The the THE Cat"), ("b", 0, "ΟΔΟΣ οδοσ İi"), ("c", 0, None)], "path string, source int, raw_text string")
    found = P.word_counts(docs, LOWER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, P.renormalized(P.word_counts(docs), LOWER).collect())) == [("a", "cat", 1), ("a", "the", 3), ("b", "ii", 1), ("b", "οδοσ", 2)]


@pytest.mark.parametrize("most", [16 << 20, 100])
def test_rows_of_a_path_are_brought_together_before_they_are_counted(spark, monkeypatch, most):
    """Of paths with little text the texts are shuffled, not their counts; paths with more text are counted first. Results are the same."""
    monkeypatch.setattr(P, "ADDED_TEXT", most)
    rows = [("a", "One two two"), ("a", "two Three"), ("b", "alone"), (None, "x y"), (None, "y z"), ("long", "long one " * 30), ("long", "ends"), ("none", None), ("none", "")]
    df = spark.createDataFrame(rows, "path string, raw_text string")
    want = Counter()
    for path, text in rows:
        want.update((path, w.lower()) for w in (text or "").split())
    found = P.postings(df)
    assert sorted(map(repr, ((r["path"], r["term"], r["freq"]) for r in found.collect()))) == sorted(repr((*k, n)) for k, n in want.items())
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    if most > 100:
        assert exchanges and not any("term" in x for x in exchanges)
