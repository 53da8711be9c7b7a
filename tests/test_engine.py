import json

import pytest
from pyspark.sql import functions as F

from loomtext.engine import Config, Engine
from loomtext.operators import catalogue
from loomtext.sources import messages
from loomtext.sources.files import Settings, Walk, read_pages_by_ocr, read_text, source_type
from loomtext.store import PAGE_ROWS, DocumentStore, merge_from, read_index
from loomtext.streaming.ingest import ingest


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.txt": "alpha beta", "sub/b.md": "beta gamma", ".git/c.txt": "never", "d.bin": "never", "e.htm": "<p>alpha", "f": "never"}.items():
        (p := tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "in" / "bad.txt").write_bytes(b"alpha \xff\xfe omega")
    return str(tmp_path / "in")


def names(df):
    return sorted(r["path"].rpartition("/in/")[2] for r in df.collect())


def test_folders(spark, folder):
    assert names(read_text(spark, Settings(folder))) == ["a.txt", "bad.txt", "e.htm", "sub/b.md"]
    assert names(read_text(spark, Settings(folder, recursive=False))) == ["a.txt", "bad.txt", "e.htm"]
    assert names(read_text(spark, Settings(folder, walk=Walk(extensions=(), forbidden=("sub",))))) == ["a.txt", "bad.txt", "d.bin", "e.htm", "f"]
    assert names(read_text(spark, Settings(f"{folder}/a.txt"))) == ["a.txt"]
    assert source_type(folder) == 1 and source_type(f"{folder}/a.txt") == 0
    with pytest.raises(FileNotFoundError):
        source_type(f"{folder}/none")
    with pytest.raises(NotImplementedError):
        read_text(spark, Settings("http://x", type=2))


def test_recognition_is_pluggable(spark, folder):
    with pytest.raises(NotImplementedError):
        read_pages_by_ocr(spark, Settings(folder))
    got = read_pages_by_ocr(spark, Settings(f"{folder}/a.txt"), lambda b: [b.decode(), "page 2"]).first()
    assert got["raw_text"] == "alpha beta\npage 2"


def test_engine(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"), Config(results=3))
    reader = e.register_indexer(command="read -x")
    assert [tuple(r)[2:] for r in e.indexers().collect()] == [("read", ["-x"], 39000)]
    second = e.register_indexer()
    assert {r["port"] for r in e.indexers().collect()} == {39000, 39001}
    e.unregister_indexer(second)
    with pytest.raises(ValueError):
        e.register_collection(folder, "none")
    c = e.register_collection(folder, reader)
    e.index(c)
    assert names(e.documents()) == ["a.txt", "bad.txt", "e.htm", "sub/b.md"]
    scan = e.handle_search("q=beta&q=gamma")
    assert scan["Query"] == "beta gamma" and scan["Results"][0]["Path"].endswith("b.md")
    e.build_index()
    assert e.handle_search("q=beta&q=gamma") == scan
    assert e.search_many(["beta", "alpha"]).count() == 5
    e.index(c)  # again: nothing doubles
    assert e.documents().count() == 4
    with pytest.raises(ValueError):
        e.handle_search("x=1")
    assert e.download(f"{folder}/a.txt") == b"alpha beta"
    with pytest.raises(FileNotFoundError):
        e.download("/etc/passwd")
    assert e.push_documents([messages.success("", [{"Path": "w", "Source": 1, "Words": {"x": 1}, "Collection": None, "RawText": "omega"}])]) == 1
    assert e.documents().where("path = 'w'").first()["source"] == 1
    with pytest.raises(ValueError):
        e.push_documents([messages.fail("no")])
    assert json.loads(e.all_documents().where(F.col("value").contains("omega")).first()["value"])["raw_text"]
    assert e.seconds["search"] > 0


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.load_or_create(path) == Config() == Config.load(path)
    Config(normalizer=1).save(path)
    assert Config.load(path).normalizer == 1


def test_store_versions(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"))
    for k in range(4):
        s.upsert(spark.createDataFrame([("p", 0, f"text {k}"), ("p", 0, f"text {k} longer"), (f"q{k}", 1, "x")], "path string, source int, raw_text string"))
    assert s.versions() == [3, 4]
    assert {(r["path"], r["raw_text"]) for r in s.read().collect()} == {("p", "text 3 longer"), *((f"q{k}", "x") for k in range(4))}


def test_stream(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    doc = lambda p, t: {"Path": p, "Source": 0, "Words": {}, "Collection": "c", "RawText": t}
    (inbox / "1.json").write_text(messages.success("", [doc("a", "one"), doc("b", "two")]) + "\n" + messages.fail() + "\nbroken\n")
    store = DocumentStore(spark, str(tmp_path / "docs"))
    ingest(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    (inbox / "2.json").write_text(messages.success("", [doc("a", "three")]) + "\n")
    ingest(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    assert {(r["path"], r["raw_text"]) for r in store.read().collect()} == {("a", "three"), ("b", "two")}
    assert sorted((r["version"], r["status"], r["error"]) for r in store.outcomes().fillna("").collect()) == [(1, "accepted", ""), (1, "refused", "not a message"), (1, "refused", "the reader failed: "), (2, "accepted", "")]


def test_catalogue(spark):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "path string, n int")
    new = spark.createDataFrame([("k2", 3, 1), ("k2", 4, 2), ("k3", 5, 1)], "path string, n int, at int")
    once = catalogue.upsert(rows, new, "path", "at")
    assert {tuple(r) for r in once.collect()} == {("k1", 1), ("k2", 4), ("k3", 5)}
    assert {tuple(r) for r in catalogue.upsert(once, new, "path", "at").collect()} == {tuple(r) for r in once.collect()}
    ports = lambda *p: catalogue.next_port(spark.createDataFrame([(x,) for x in p], "port int")).first()["port"]
    assert (ports(), ports(39000), ports(39000, 39001, 39003)) == (39000, 39001, 39002)
    assert catalogue.missing(rows, "path", new.select("path").distinct()).first()["path"] == "k3"
    assert len(spark.range(1).select(catalogue.new_id()).first()[0]) == 14


def test_messages(spark):
    assert json.loads(messages.pong()) == {"status": "success", "data": {"message": "pong", "documents": None}}
    assert json.loads(messages.exiting())["data"]["message"] == "exiting"
    rows = spark.createDataFrame([(messages.success("", [{"Path": "p", "Source": 0, "Words": {"good": 42, "bad": 11}, "Collection": None, "RawText": "t"}]),), (None,), ("{",)], "value string")
    assert {tuple(r) for r in messages.word_rows(messages.documents(rows)).collect()} == {("p", "good", 42), ("p", "bad", 11)}


def test_index_files_are_sorted(spark, tmp_path):
    from loomtext.store import write_index

    docs = spark.createDataFrame([("a", 0, "x y z"), ("b", 0, "y z")], "path string, source int, raw_text string")
    write_index(docs, str(tmp_path / "i"), files=2)
    posted, lengths = read_index(spark, str(tmp_path / "i"))
    assert posted.count() == 5 and lengths.count() == 2
    plan = posted.where("term = 'y'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,y)]" in plan


def test_command_line(spark, folder, tmp_path):
    from loomtext.__main__ import lines, run

    e = Engine(spark, str(tmp_path / "cli"))
    assert run(e, "index", folder)[0].startswith("indexed ")
    assert run(e, "build")[0].startswith("index built")
    shown = run(e, "search", "beta", "-alpha")
    assert shown[0] == "--- Search results for query 'beta -alpha' ---" and len(shown) == 2
    assert shown[1].startswith("0. Path: ") and shown[1].endswith(", Source: local")
    (tmp_path / "m.json").write_text(messages.success("", [{"Path": "w", "Source": 1, "Words": {}, "Collection": None, "RawText": "omega"}]))
    assert run(e, "push", str(tmp_path / "m.json")) == ["put 1 documents"]
    assert len(run(e, "all")) == 5
    assert "\033[92m1.50" in lines({"Query": "q", "Results": [{"Path": "p", "Score": 1.5, "Source": 7}]}, colours=True)[1]
    with pytest.raises(ValueError):
        run(e, "dance")


FIXTURES = [
    {"Path": "/some/path", "Source": 0, "Words": {"key1": 1, "key2": 2}, "Collection": "1", "RawText": "some text"},
    {"Path": "/some/other/path", "Source": 0, "Words": {"key2": 3, "key3": 4}, "Collection": "1", "RawText": "some other text"},
]


@pytest.mark.parametrize("built", [False, True])
def test_documents_bring_their_words(spark, tmp_path, built):
    e = Engine(spark, str(tmp_path / "e"))

    def answer(query):
        if built:
            e.build_index()
        assert e.indexed is built
        return [(r["Path"], round(r["Score"], 6)) for r in e.handle_search(f"q={query}")["Results"]]

    e.push_documents([messages.success("", FIXTURES[:1])])
    assert answer("key1") == [("/some/path", -0.333333)] and answer("badkey") == [] and answer("text") == []
    e.push_documents([messages.success("", FIXTURES[1:])])
    assert answer("key1") == [("/some/path", 0.0)] and [p for p, _ in answer("key3")] == ["/some/other/path"]
    assert answer("key2") == [("/some/other/path", -0.250698), ("/some/path", -0.389975)]
    assert [p for p, _ in answer('key2 "other text"')] == ["/some/other/path"]  # phrases are of the text


def test_the_last_push_wins(spark, tmp_path):
    doc = lambda t: {"Path": "p", "Source": 0, "Words": None, "Collection": "c", "RawText": t}
    e = Engine(spark, str(tmp_path / "e"))
    e.push_documents([messages.success("", [doc("zebra old"), doc("apple new")])])
    assert e.documents().first()["raw_text"] == "apple new"
    e.push_documents([messages.success("", [doc("z")]), messages.success("", [doc("y"), doc("x")])])
    assert e.documents().first()["raw_text"] == "x" and e.documents().count() == 1


def test_the_last_message_of_a_stream_wins(spark, tmp_path):
    import os

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    line = lambda t: messages.success("", [{"Path": "p", "Source": 0, "Words": {}, "Collection": "c", "RawText": t}]) + "\n"
    for k, (name, texts) in enumerate([("b.json", ["zz", "yy"]), ("a.json", ["xx", "ww"])]):
        (inbox / name).write_text("".join(map(line, texts)))
        os.utime(inbox / name, (1_700_000_000 + k, 1_700_000_000 + k))
    store = DocumentStore(spark, str(tmp_path / "docs"))
    ingest(spark, str(inbox), store, str(tmp_path / "ck")).awaitTermination()
    assert [r["raw_text"] for r in store.read().collect()] == ["ww"]


ROW = "path string, source int, raw_text string"


def put(spark, store, rows, **options):
    return store.upsert(spark.createDataFrame(rows, ROW), **options)


def texts(df):
    return {r["path"]: r["raw_text"] for r in df.collect()}


@pytest.mark.parametrize("fan", [2, 3])
def test_changes_and_levels(spark, tmp_path, fan):
    s = DocumentStore(spark, str(tmp_path / "s"), fan=fan)
    expected = {}
    for k in range(9):
        rows = [(f"p{i}", 0, f"{k}") for i in ((k, k + 30) if k else range(20))]
        before = dict(expected)
        expected |= {p: t for p, _, t in rows}
        assert put(spark, s, rows) == k + 1 == s.version()
        assert texts(s.read()) == expected and s.n_documents() == len(expected) == s.read().count()
        if k:
            assert texts(s.read(k)) == before
        m = s._newest()
        assert merge_from([s._level(s._rows(m, i)) for i in range(len(m["sets"]))], fan) is None
    with pytest.raises(FileNotFoundError):
        s.read(4)
    s.compact()
    assert texts(s.read()) == expected and len(s._newest()["sets"]) == 1 and s.version() == 9


@pytest.mark.parametrize("fan", [2, 4, 8])
@pytest.mark.parametrize("sizes", ["equal", "random", "falling", "one large"])
def test_rows_are_written_once_a_level(fan, sizes):
    """Rows written against rows put, by the rule alone: less than two for each level, in thousands of pushes."""
    import math
    import random

    r = random.Random(5)
    level = lambda n: int(math.log(n, fan) + 1e-9)
    sets, written, pushed = [], 0, 0
    assert merge_from([3, 1, 2, 0], 3) is None and merge_from([3, 1, 2, 2, 0], 3) == 1 and merge_from([], 2) is None
    for k in range(3000):
        n = {"equal": 10, "random": r.choice([1, 10, 100, 1000]), "falling": 3000 - k, "one large": 10**6 if k == 1500 else 10}[sizes]
        sets.append(n)
        written, pushed = written + n, pushed + n
        while (start := merge_from([level(x) for x in sets], fan)) is not None:
            written += sum(sets[start:])
            sets[start:] = [sum(sets[start:])]
        assert len(sets) <= (fan - 1) * (level(pushed) + 1)
    assert written <= pushed * 2 * (level(pushed) + 1)


def test_the_base_is_neither_shuffled_nor_sorted(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"))
    put(spark, s, [(f"p{i}", 0, f"text {i}") for i in range(500)])
    put(spark, s, [(f"p{i}", 0, "new") for i in range(0, 40, 3)])
    put(spark, s, [("p1", 1, "newer"), ("p3", 0, "newer")])
    plan = s.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3 and "Exchange" not in plan and "Sort" not in plan and "Bucketed: true" in plan
    found = texts(s.read())
    assert len(found) == 500 and found["p3"] == found["p1"] == "newer" and found["p6"] == "new" and found["p2"] == "text 2"


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Four writers, each with its own store object over one folder, in threads; each also writes a path that all write."""
    from threading import Thread

    errors = []

    def work(w):
        try:
            own = DocumentStore(spark, str(tmp_path / "s"), fan=3)
            for k in range(4):
                put(spark, own, [(f"{w}-{k}", 0, f"{w} {k}"), ("all", 0, f"{w}")])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [Thread(target=work, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    s = DocumentStore(spark, str(tmp_path / "s"))
    found = texts(s.read())
    assert found.pop("all") in "0123" and found == {f"{w}-{k}": f"{w} {k}" for w in range(4) for k in range(4)}
    assert s.version() == 16 and s.n_documents() == 17 == s.read().count()


def test_a_merge_meets_a_push(spark, tmp_path):
    """What is put while sets are made one replaces rows of theirs, and still does so in the set that comes of them; a merge that comes too late gives up."""
    s = DocumentStore(spark, str(tmp_path / "s"), fan=100)
    put(spark, s, [(f"p{i}", 0, "one") for i in range(10)])
    s.build_index()
    put(spark, s, [(f"p{i}", 0, "two") for i in range(5)])
    put(spark, s, [("p1", 0, "three")])
    old = s._newest()
    put(spark, s, [("p1", 0, "four"), ("p2", 0, "four"), ("p9", 0, "four"), ("q", 0, "four")])
    assert s.merge(old, 1)
    expected = {f"p{i}": "one" for i in range(9)} | {f"p{i}": "two" for i in range(5)} | dict.fromkeys(("p1", "p2", "p9", "q"), "four")
    assert len(s._newest()["sets"]) == 3 and texts(s.read()) == expected and s.n_documents() == 11
    assert not s.merge(old, 0) and texts(s.read()) == expected
    posted, n = s.postings()
    assert n == 11 and {(r["path"], r["term"]) for r in posted.collect()} == set(expected.items())
    s.compact()
    assert texts(s.read()) == expected and {(r["path"], r["term"]) for r in s.postings()[0].collect()} == set(expected.items())


def test_a_batch_is_put_once(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"))
    assert put(spark, s, [("a", 0, "first")], batch=("stream", 0)) == 1
    assert put(spark, s, [("a", 0, "other stream")], batch=("another", 0)) == 2
    assert put(spark, s, [("a", 0, "again")], batch=("stream", 0)) == 0
    assert s.version() == 2 and texts(s.read()) == {"a": "other stream"}
    assert put(spark, s, [("b", 0, "next")], batch=("stream", 1)) == 3


def test_a_number_is_given_once(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"))
    m = s._newest()
    assert s._commit(m | {"version": 1}) and not s._commit(m | {"version": 7})
    assert s._newest()["version"] == 1 and s._numbers() == [1]


def test_nothing_is_read_of_texts_by_an_index_that_follows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    docs = lambda *ps: [messages.success("", [{"Path": p, "Source": 0, "Words": None, "Collection": "c", "RawText": t} for p, t in ps])]
    e.push_documents(docs(("a", "alpha beta"), ("b", "beta beta gamma"), ("c", "delta")))
    e.build_index()
    for change in ([("a", "gamma")], [("d", "beta"), ("b", "alpha")], [("a", "beta alpha")]):
        e.push_documents(docs(*change))
        assert e.indexed
        plan = e.search("beta alpha -delta")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "raw_text" not in text and "In(term, [alpha,beta])" in text
        from loomtext.operators.search import search

        for q in ("beta alpha", "beta -alpha", "+alpha beta", "gamma"):
            assert found_in(e, q) == [(r["path"], r["score"]) for r in search(e.documents(), q).collect()]


def scans(plan):
    """(columns, rows read) of the scans below a plan that has run."""
    name = plan.nodeName()
    if name.startswith("Scan"):
        return [(plan.output().mkString(","), plan.metrics().apply("numOutputRows").value())]
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    return [s for p in inner for s in scans(p)]


def test_a_phrase_reads_the_texts_that_can_have_it(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    rows = [(f"p{i:05d}", 0, f"one in number{i} of many, {'a rare find' if i % 400 == 7 else 'a find rarely'} here") for i in range(1200)]
    put(spark, e.store, rows)
    e.build_index()
    put(spark, e.store, [("p00407", 0, "no more"), ("new", 0, "such a rare finding"), ("other", 0, "a rarer find")])
    e.push_documents([messages.success("", [{"Path": "told", "Source": 0, "Words": {"such": 1}, "Collection": "c", "RawText": "has a rare find too"}])])
    plan = e.search('such here "a rare find"', k=None)
    got = {r["path"] for r in plan.collect()}
    assert got == {"p00007", "p00807", "new", "told"}
    read = [n for columns, n in scans(plan._jdf.queryExecution().executedPlan()) if "raw_text" in columns]
    assert read and sum(read) <= 3 * PAGE_ROWS + 10  # of 1,204

    from loomtext.operators import search as search_module

    for q in ('such here "a rare find"', 'one "er1199 of m"'):
        usual = found_in(e, q)
        assert usual == [(r["path"], r["score"]) for r in search_module.search(e.documents(), q).collect()], q
        search_module.MOST_PATHS, most = 0, search_module.MOST_PATHS
        try:
            assert found_in(e, q) == usual, q
        finally:
            search_module.MOST_PATHS = most


def test_every_message_has_an_outcome(spark, tmp_path, caplog):
    e = Engine(spark, str(tmp_path / "e"))
    doc = lambda p: {"Path": p, "Source": 0, "Words": {}, "Collection": "c", "RawText": "t"}
    assert e.push_documents([messages.success("", [doc("a"), doc(None)]), messages.fail("no"), "not json", "", messages.success("", []), messages.pong(), messages.success("", [doc("b")])]) == 2
    assert [m for m in caplog.messages if "refused" in m][0].startswith("5 messages")
    with pytest.raises(ValueError):
        e.push_documents([messages.success("", [doc(None)]), messages.fail()])
    got = sorted(tuple(r) for r in e.outcomes().fillna("").collect())
    assert got == [
        (1, "0", "accepted", "1 documents without a path", 1), (1, "1", "refused", "the reader failed: no", 0), (1, "2", "refused", "not a message", 0), (1, "3", "refused", "not a message", 0),
        (1, "4", "refused", "no documents", 0), (1, "5", "refused", "no documents", 0), (1, "6", "accepted", "", 1),
        (2, "0", "refused", "1 documents without a path", 0), (2, "1", "refused", "the reader failed: ", 0),
    ]
    e.store.compact()
    assert sorted(tuple(r) for r in e.outcomes().fillna("").collect()) == got and e.documents().count() == 2


def test_an_index_and_its_engine_restart(spark, folder, tmp_path):
    from loomtext.sources.files import Reader

    own = Reader("own", lambda spark, settings: read_text(spark, settings))
    e = Engine(spark, str(tmp_path / "e"))
    c = e.register_collection(folder, e.register_indexer(own))
    e.index(c)
    e.build_index()
    again = Engine(spark, str(tmp_path / "e"))
    assert again.indexed and found_in(again, "beta") == found_in(e, "beta") != []
    with pytest.raises(LookupError):
        again.index(c)  # not read by some other reader instead
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "e"), readers=[own]).register_indexer(Reader("own", read_text))
    again = Engine(spark, str(tmp_path / "e"), readers=[own])
    again.index(c, modify=lambda df: df.withColumn("raw_text", F.concat("raw_text", F.lit(" omicron"))))
    assert e.indexed  # the index follows the documents
    assert len(found_in(e, "omicron")) == 4
    assert e.search("alpha beta", k=None).count() == 4
    plan = Engine(spark, str(tmp_path / "e"))
    plan.build_index()
    text = plan.search("beta gamma")._jdf.queryExecution().executedPlan().toString()
    assert "raw_text" not in text and "lengths" not in text and "In(term, [beta,gamma])" in text


def found_in(engine, query):
    return [(r["path"], r["score"]) for r in engine.search(query).collect()]


def test_dispatch(spark, folder, tmp_path):
    from loomtext.sources.files import Reader

    state = {"up": False, "starts": 0}

    def read(spark, settings):
        if not state["up"]:
            raise ConnectionError("down")
        return read_text(spark, settings)

    def start():
        state["starts"] += 1
        if state["starts"] == 1:
            raise OSError("cannot start")
        state["up"] = state["starts"] > 2

    e = Engine(spark, str(tmp_path / "e"))
    c = e.register_collection(folder, e.register_indexer(Reader("shaky", read, start)))
    first, second, third, fourth = (e.dispatch(c) for _ in range(4))
    assert isinstance(first.startup_attempt, OSError) and str(first.dispatch_attempt) == "failed startup prevents dispatch attempt"
    assert second.startup_attempt is None and isinstance(second.dispatch_attempt, ConnectionError) and not second.indexer_was_running
    assert not third.failed and not third.indexer_was_running
    assert not fourth.failed and fourth.indexer_was_running and e.documents().count() == 4
    with pytest.raises(ValueError):
        e.dispatch("none")


def test_files_are_downloaded_as_they_are(spark, folder, tmp_path):
    import os

    e = Engine(spark, str(tmp_path / "e"))
    c = e.register_collection(folder, e.register_indexer(), respect_last_modified=True)
    e.index(c)
    assert e.download(f"{folder}/bad.txt") == b"alpha \xff\xfe omega"
    # only what changed since is read again
    before = {r["path"]: r["last_indexed"] for r in e.store.read().collect()}
    for name in os.listdir(folder):
        os.utime(f"{folder}/{name}", (1_600_000_000, 1_600_000_000))
    os.utime(f"{folder}/sub/b.md", (1_600_000_000, 1_600_000_000))
    with open(f"{folder}/a.txt", "w") as f:
        f.write("alpha anew")
    e.index(c)
    after = {r["path"]: r["last_indexed"] for r in e.store.read().collect()}
    assert {p for p in after if after[p] != before[p]} == {f"{folder}/a.txt"}
    os.remove(f"{folder}/a.txt")
    assert e.download(f"{folder}/a.txt") == b"alpha anew"


def test_bound_statements_and_folds(spark):
    from loomtext.plans.statements import Select, fold, run

    spark.range(5).createOrReplaceTempView("five")
    rows = run(spark, Select().queries("id").from_("five").where("id >= :least"), least=3)
    assert fold(rows, 0, lambda n, r: n + r["id"]) == 7


def test_log(spark, tmp_path, caplog):
    import logging

    with caplog.at_level(logging.INFO, "loomtext"):
        Engine(spark, str(tmp_path)).log("from outside")
    assert "from outside" in caplog.text


def test_parts_follow_the_text(spark, tmp_path, monkeypatch):
    from loomtext import store as module

    monkeypatch.setattr(module, "TASK_TEXT", 100)
    docs = spark.createDataFrame([(f"p{i}", 0, "word " * 20) for i in range(9)], "path string, source int, raw_text string")
    s = DocumentStore(spark, str(tmp_path / "s"))
    s.upsert(docs)
    s.upsert(docs.limit(2))
    assert s._newest()["buckets"] == 9 and s.read().count() == 9
    module.write_index(docs, str(tmp_path / "i"))
    assert {r["freq"] for r in module.read_index(spark, str(tmp_path / "i"))[0].collect()} == {20}
