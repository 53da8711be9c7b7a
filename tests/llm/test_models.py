import pickle
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nasty_rows import NASTY
from pyspark.sql import functions as F

from loomtext.llm import langid, queries, toxicity


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_language_held_out(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, larger).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    total, right = got.count(), got.where("lang = lang_pred").count()
    assert total > 150 and right / total > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_held_out_languages_are_not_learned_from(spark, larger, tmp_path):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    changed = docs.withColumn("lang", F.when(queries.fold(5) == 0, "nonsense").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    a, b = queries.op5_language_id(spark, larger), queries.op5_language_id(spark, str(tmp_path))
    assert a.exceptAll(b).count() == 0


def plain_language(model, text):
    """Nearest centroid by plain sums over the n-grams of a text."""
    from math import log1p, sqrt

    counts = langid.grams(text) if text else None
    if counts is None:
        return "und", 0.0
    vector = {i: log1p(float(n)) * float(model.idf[i]) for i, n in enumerate(counts) if n}
    norm = sqrt(sum(x * x for x in vector.values()))
    best = max(((sum(x * float(c[i]) for i, x in vector.items()) / norm, -k) for k, c in enumerate(model.centroids)), default=None)
    return model.languages[int(model.owner[-best[1]])], best[0]


def test_language_by_brute_force(spark, larger):
    model = queries.language_model(spark, larger)
    assert len(model.centroids) > len(model.languages)  # several a language
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, larger).collect()}
    for r in spark.read.parquet(f"{larger}/documents.parquet").orderBy("doc_id").limit(150).collect():
        lang, cosine = plain_language(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - cosine) < 1e-4


def test_language_nasty(nasty, spark, larger):
    model = queries.language_model(spark, larger)
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.predict(nasty, model).collect()}
    for i, text in ((3, None), (9, ""), (7, "  "), (1, "12345")):
        assert (i, "und", True) in got, text
    assert len(got) == len({r[:2] for r in NASTY}) and {lang for _, lang, _ in got} <= {"und", *model.languages}
    kept = langid.accepted(nasty, model)
    assert kept.columns == nasty.columns and not {1, 3, 7, 9} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict(nasty.limit(0), model).count() == 0


def test_language_distance(spark, larger):
    model = queries.language_model(spark, larger)
    clean = [r["text"] for r in spark.read.parquet(f"{larger}/documents.parquet").limit(300).collect()]
    assert sum(r for *_, r in model.predict(clean)) <= 3
    assert all(r for *_, r in model.predict(["жизнь и судьба человека в этом мире " * 20, "qzx wvk jqx zzq xxk " * 40]))


def test_language_without_rows(nasty):
    model = langid.fit(nasty.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(nasty, model).collect()} == {("und", 0.0)}
    one = langid.fit(nasty.where("doc_id = 5"))
    assert one.languages == ["en"]


def test_grams_by_block(monkeypatch):
    text = "Äpfel und Birnen, 12 Pflaumen. " * 30
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "_BLOCK", 50)
    assert (langid.grams(text) == whole).all() and langid.grams("12 !!") is None


def test_toxicity_held_out(spark):
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    got = queries.op2_toxicity(spark, where).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.01


MODEL = toxicity.Model({"idiot": 0.98, "moron": 0.98}, {"lostra": 0.95})


def marks(text):
    return [m for m, _ in MODEL.matches(text)]


def test_grammar():
    assert marks("An idiot") == [0] and marks("what lostraschaft") == [0] and marks("lostr idiots") == []
    assert marks("You idiot") == [4] and marks("you. Idiot") == [0]
    assert marks("not an idiot") == [1] and marks("not one two three idiot") == [0]
    assert marks('He said: "idiot"') == [6] and marks('"idiot" moron') == [2, 0]
    assert marks("She wrote idiot. moron") == [6, 0]
    assert marks("kill") == [] and marks("I will kill you") == [4] and marks("you I will kill") == [4]
    assert marks("idiot, he said") == [6] and marks("idiot. he said") == [0]  # a report may come last
    assert MODEL.matches("") == []


def test_targets_after_a_match():
    whole = lambda text: [m for m, _ in MODEL.clause_matches(text)]
    assert whole("I will kill you") == whole("kill them") == whole("you I will kill") == [4]
    assert whole("kill. You") == whole("You. kill") == whole("kill") == [] and whole("kill it\nyou idiot") == [4]
    assert whole("idiot, moron, you. An idiot") == [4, 4, 0] and whole("I will not kill you") == [5]
    assert MODEL.score("I will kill you") == MODEL.score("you I will kill") > MODEL.score("")


def test_grammar_by_brute_force():
    """The composed transducer against each one alone."""
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted()]
    rng = np.random.default_rng(3)
    for _ in range(300):
        symbols = rng.integers(0, 8, 12).tolist()
        states, state = [0, 0, 0], 0
        for s in symbols:
            marks = 0
            for k, p in enumerate(parts):
                states[k], m = p.arcs[states[k]][s]
                marks |= m
            state, mark = toxicity.GRAMMAR.arcs[state][s]
            assert mark == marks


def plain_evidence(model, text):
    """Clause by clause, by rules in words instead of states."""
    from math import log

    def kind(w):
        if w in model.words:
            return "insult", model.words[w]
        for n in range(len(w), 0, -1):
            if w[:n] in model.beginnings:
                return "insult", model.beginnings[w[:n]]
        for name, words in (("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("threat", toxicity.THREATS)):
            if w in words:
                return name, toxicity.THREAT_WEIGHT
        return ("quote" if w in '"“”«»„' else "other"), 0.0

    total, quoted = 0.0, False
    for clause in re.split(r"[.!?;\n]", text.lower()):
        tokens = [kind(w) for w in re.findall(r'\w+|["“”«»„]', clause)]
        names = [k for k, _ in tokens]
        inside, said = [], False
        for k in names:
            if k == "quote":
                quoted, said = not quoted, False
            said |= k == "report" and not quoted
            inside.append(quoted or said)
        for i, (k, p) in enumerate(tokens):
            if not (k == "insult" or k == "threat" and "target" in names):
                continue
            left = names[max(0, i - 3) : i]
            mark = ("negation" in left) * 1 | (inside[i] or said and not quoted) * 2 | ("target" in names) * 4 | (k == "threat") * 8
            total -= (2.0 if k == "threat" else 1.0) * log(1 - p * model.contexts[mark])
    return total


@given(st.lists(st.sampled_from("you idiot moron kill not said he . , \" lostra the ; shoot never wrote x idiots".split()), max_size=25))
@settings(max_examples=600, deadline=None)
def test_scores_clause_by_clause(words):
    text = " ".join(words)
    assert MODEL.evidence(text) == pytest.approx(plain_evidence(MODEL, text))


def test_contexts_decide():
    """With the scale that sf0.1 gives."""
    model = toxicity.Model(MODEL.words, MODEL.beginnings, scale=(1.3, -5.2))
    toxic = lambda text: model.score(text) >= 0.7
    assert toxic("I will kill you") and toxic("You idiot. You moron, you idiot")
    assert not toxic("I will not kill you") and not toxic("He said he would kill you") and not toxic("kill it") and not toxic("you")
    assert not toxic("You are not an idiot. You are no moron, never an idiot")
    assert model.clause_score(model.clauses("I will kill you")[0]) > 0.99 > model.clause_score(model.clauses("I will not kill you")[0])
    flat = toxicity.Model(MODEL.words, MODEL.beginnings, {m: toxicity.PRIOR["aimed"] for m in range(16)}, (1.3, -5.2))
    assert flat.score("I will not kill you") >= 0.7  # the context makes the difference


def test_scores():
    assert MODEL.score(None) == MODEL.score("") == MODEL.score("clean words") < 0.2
    assert MODEL.score("you idiot moron") > MODEL.score("not an idiot") > MODEL.score("")
    again = pickle.loads(pickle.dumps(MODEL))
    assert again.score("you idiot") == MODEL.score("you idiot")


def test_toxicity_nasty(nasty):
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.score(nasty, MODEL).collect()}
    assert got == {(i, 0) for i, *_ in NASTY}
    assert toxicity.accepted(nasty, MODEL).count() == len(NASTY) and toxicity.score(nasty.limit(0), MODEL).count() == 0


def test_toxicity_by_brute_force(spark):
    """The query's scores against clauses read by plain rules, with the model that the query learns."""
    from math import exp

    where = "/root/testdata/sf0.01"
    model = queries.toxicity_model(spark, where)
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, where).collect()}
    rows = spark.read.parquet(f"{where}/documents.parquet").collect()
    for r in rows:
        plain = 1 / (1 + exp(-max(-30, min(30, model.scale[0] * plain_evidence(model, r["text"]) + model.scale[1]))))
        assert got[r["doc_id"]]["score"] == pytest.approx(plain) and got[r["doc_id"]]["predicted"] == int(plain >= 0.7)
    assert len(got) == len(rows) and len({r["predicted"] for r in got.values()}) == 2


def test_toxicity_fit_of_odd_labels(spark, nasty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (99, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(nasty, labels)
    assert model.words == {} and 0 <= model.score("anything") < 0.5
    assert toxicity.fit(nasty.limit(0), labels.limit(0)).score("x") < 0.5


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "rare words of one copied text" if i % 2 else f"plain w{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).words == {}
    varied = spark.createDataFrame([(i, f"w{i} vile x{i}" if i % 2 else f"plain w{i}") for i in range(200)], "doc_id long, text string")
    assert set(toxicity.fit(varied, labels).words) == {"vile"}
