import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import html, warc
from loomtext.llm.common import shared_dir

LONG = "<p>" + "payload " * 200
PAGES = [
    (1, "http://a.example/x", "<p>one"),
    (2, None, LONG),
    (3, "http://a.example/y", LONG),
    (3, "http://a.example/y", LONG),
    (4, "not a url", None),
    (5, "http://b.example/\r\nWARC-Type: evil ", "short"),
    (6, "http://b.example/", "short"),
    (None, "http://b.example/z", LONG),
    (7, "http://b.example/z", "Zürich " * 150),
    (8, "http://b.example/z", "Zürich " * 150),
    (9, "http://b.example/w", ""),
    (10, "http://c.example/big", "<div>" * 20_000 + "deep" + "x" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    schema = "page_id long, url string, html string, text string, id string, body int, digest string, keys int, page string, name string"
    return spark.createDataFrame([(*p, "t", "i", 1, "d", 2, "p", "n") for p in PAGES], schema).repartition(3)


# Pages and their main text.
CASES = [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<p>a <b>bold\n\t word</b>, b<br>c</p>", "a bold word, b c"),
    ("<nav>menu</nav><article><h1>T</h1><p>x</p><footer>f</footer></article><aside>s</aside>", "T\n\nx"),
    ("<div class='site-header'>h</div><div id=content><p>x</p></div><div class=cookie-notice>c</div>", "x"),
    ("<div class='content with-sidebar'><p>all of the page</p></div>", "all of the page"),
    ("<header><h1>Site</h1><nav>n</nav></header><p>x</p><ol class=commentlist><li>c</ol><div class=siteFooter>f</div>", "x"),
    ("<div class=entry-header><h1>T</h1></div><p>x</p>", "T\n\nx"),
    ("<article><p>x</p><section class='comments'><article class=comment>hi</article></section></article>", "x"),
    ("<p>&lt;b&gt; &amp;amp; &eacute;&#233;&#x1F600; a&nbsp;b &unknown;</p>", "<b> &amp; éé😀 a b &unknown;"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><title>no</title><p>yes<!-- <p>no --></p>", "yes"),
    ("<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "1\n\n2\n\na\n\nb"),
    ("<form>f<input></form><p hidden>h</p><p style='display: none'>d</p><div role=navigation>n</div>v", "v"),
    ("</p></div>x</article>", "x"),
    ("a < b and c<d <p title='>'>x</p>", "a < b and c\n\nx"),
    ("<main><div class=advert>buy</div><p>m</p></main><p>outside</p>", "m"),
    ("<header>top</header><article><header><h1>T</h1></header>b</article>", "T\n\nb"),
    ("<div class='ad-free layout'><article>kept</article></div>", "kept"),
    ("<p>unclosed <a href='x", "unclosed"),
]


# What stands in an article and its text.
IN_ARTICLES = [
    ('<p title="a hidden treasure">x', "x"),
    ('<p title="x role=navigation y">x', "x"),
    ('<p data-hidden="no">x', "x"),
    ('<div data-id="comments">x</div>', "x"),
    ('<p data-style="display:none">x', "x"),
    ("<p title='class=\"advert\"'>x", "x"),
    ("<p data-x=id=menu>x", "x"),
    ("<p hidden>x", ""),
    ("<p HIDDEN=hidden>x", ""),
    ("<p aria-hidden=true>x", ""),
    ("<p aria-hidden = 'false'>x", "x"),
    ("<p style='color:red; DISPLAY : none'>x", ""),
    ("<div title='a > b' class=advert>x</div>", ""),
    ("<div/class=advert>x</div>", ""),
    ("<div title=\"\"id=advert>x</div>", ""),
    ('<ol class="menu-items"><li>x</ol>', "x"),
    ('<section class="ads-content">x</section>', "x"),
    ('<div id="social-content">x</div>', "x"),
    ('<div class="skip-list">x</div>', "x"),
    ('<section id="related-list">x</section>', "x"),
    ('<section class="comment-list">x</section>', ""),
    ("<div class=cookie-notice>x</div>", ""),
    ("<p>Fill <label>in</label> the x", "Fill in the x"),
    ("<p>Press <button>Start</button> now", "Press Start now"),
    ("<form><label>Name</label> <input> <button>Go</button></form>", ""),
]


@pytest.mark.parametrize("part, text", IN_ARTICLES)
def test_names_and_attributes_in_articles(part, text):
    assert html.text_of(f"<article><p>first</p>{part}</article>") == "first" + (f"\n\n{text}" if text else "")


@pytest.mark.parametrize("n", [8, 60, 500])
def test_only_recurrence_tells(spark, n):
    """Pages that mark nothing and name nothing: menu, banner and foot are what all pages of a host share, the rest is its page's own. Every text is right."""

    def page(h, k):
        menu = "<div><ul>" + "".join(f"<li><a href='/{w}'>{w} of {h}</a></li>" for w in ("Start", "About", "Contact")) + "</ul></div>"
        more = f"<ul><li>point {k}</li><li>the same point</li></ul>" if k % 3 else ""
        return f"<body><div>{h} in short</div>{menu}<div><h2>Title {k}</h2><p>Text {k} of {h}.</p>{more}<p>More of {k}.</p></div><div><p>All rights at {h}</p></div></body>"

    rows = [(1000 * h + k, f"http://h{h}.example/{k}", page(f"site {h}", k)) for h in range(2) for k in range(n)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), report=True).collect():
        h, k = divmod(r["page_id"], 1000)
        points = [f"point {k}", "the same point"] if k % 3 else []
        assert r["text"].split("\n\n") == [f"Title {k}", f"Text {k} of site {h}.", *points, f"More of {k}."]
        assert r["named_chars"] == 0 and r["template_chars"] > 0


def test_names_in_articles_that_recur(spark):
    """A hint of a name goes from the articles of a host where most have it."""
    part = lambda k: f"<div class='related-list'><p>other {k}</p></div>"
    rows = [(100 * h + k, f"http://h{h}.example/{k}", f"<article><p>text {k}</p>{part(k) if h or k == 3 else ''}</article>") for h in range(2) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * h + k: f"text {k}" + (f"\n\nother {k}" if not h and k == 3 else "") for h in range(2) for k in range(12)}


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    if page.startswith("a < b"):
        assert html.text_of(page).endswith("\n\nx")
    elif "unclosed" in page:
        assert html.text_of(page).startswith("unclosed")
    else:
        assert html.text_of(page) == text


@given(st.text(alphabet="<>/pbdiv ab&;\"'!-", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_page_is_read(page):
    root = html.parse(page)
    html.Page(page, "http://h/").keys()
    text = html.text_of(page)
    assert text == "\n\n".join(b for b in text.split("\n\n") if b.strip())


def test_template_of_a_host(spark):
    def page(host, k, n):
        block = f"<div><span>follow us on {host}</span></div>"
        return (k, f"http://{host}.example/{k}", f"<body>{block}<div><p>text {n} number {n}</p></div><div>{'same footer' if host == 'a' else n}</div></body>")

    rows = [page("a", k, k) for k in range(12)] + [page("b", 100 + k, k) for k in range(5)] + [page("c", 200 + k, 0) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[3] == "text 3 number 3"  # both repeated blocks are gone
    assert got[103] == "follow us on b\n\ntext 3 number 3\n\n3"  # too few pages to tell
    assert got[203] == "follow us on c\n\ntext 0 number 0\n\n0"  # copies of one page are no evidence
    joined = {r["page_id"]: r["text"] for r in html.extract(df, broadcast_limit=0).collect()}
    assert joined == got


def test_articles_of_a_large_host(spark):
    """What some articles share stays, however many they are; the template of all goes."""
    quoted = "<div><blockquote>a passage quoted by some</blockquote></div>"

    def page(n, marked):
        text = f"<h2>Background</h2><p>text {n}</p>{quoted if n % 4 == 0 else ''}<ul><li>item {n}</li><li>none</li></ul><h2>Results</h2><p>end {n}</p>"
        text = f"<article>{text}</article>" if marked else text
        return (n, f"http://{'m' if marked else 'u'}.example/{n}", f"<body><p>welcome to all</p><div>top of all</div><p>head {n}</p>{text}<div>foot of all</div><h6>imprint</h6></body>")

    df = spark.createDataFrame([page(n, n >= 40) for n in range(80)], "page_id long, url string, html string")
    for limit in (500_000, 0):
        got = {r["page_id"]: r["text"].split("\n\n") for r in html.extract(df, broadcast_limit=limit).collect()}
        for n in range(80):
            passage = ["a passage quoted by some"] if n % 4 == 0 else []
            text = ["Background", f"text {n}", *passage, f"item {n}", "none", "Results", f"end {n}"]
            assert got[n] == ([] if n >= 40 else [f"head {n}"]) + text


def test_short_articles_stay_and_teasers_go():
    text = html.text_of
    assert text("<article><p>" + "long " * 200 + "</p></article><article><p>short</p></article>").endswith("\n\nshort")
    teaser = "<article><h2><a href=x>Other story</a></h2><a href=x>read on</a></article>"
    assert text(f"<article><h1>T</h1><p>x</p></article>{teaser}") == "T\n\nx"
    assert text(teaser) == "Other story\n\nread on"  # the only one


def test_names_inside_an_article():
    text = html.text_of
    assert text("<article><div class='related-work'>a</div><div id=search-algorithms>b</div></article>") == "a\n\nb"
    assert text("<article>x<div class='related-posts'>a</div><div id=search-box>b</div><ul class='share-buttons'>c</ul></article>") == "x"
    assert text("<p>x</p><div class='my-search-thing'>b</div>") == "x"  # no article is marked


def test_attributes_without_quotation_marks():
    assert html.text_of("<p title=it's>hello</p><p title=\"a>b\" x='>'>you</p>") == "hello\n\nyou"


def test_a_deep_page_keeps_its_shape():
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000 + "<p>out" + "</x>" * 3000
    assert html.text_of(deep) == "in\n\nout"
    import time

    began = time.perf_counter()
    assert html.text_of("<div class=menu-x><span>" * 30_000 + "a").startswith("a")
    assert time.perf_counter() - began < 20


def plain_counts(rows):
    """Pages of different content by subtree and host, counted without Spark, keys or hashes."""
    contents, by = {}, {}
    for _, url, page in rows:
        root = html.Page(page, url)
        own = root.text()
        contents.setdefault(html.host_of(url), set()).add(own)

        def shape(e):
            kids = tuple(" ".join(p.split()) if isinstance(p, str) else shape(p) for p in e.parts if not isinstance(p, str) or p.strip())
            return (e.tag, tuple(k for k in kids if k is not None)) if any(k is not None for k in kids) and e.tag not in html.RAW else None

        for e in root.order:
            if e.candidate:
                by.setdefault((html.host_of(url), shape(e)), {}).setdefault(own, e.key)
    return contents, by


def test_counts_per_host_decide(spark):
    """Every deletion outside an article, against counts made plainly."""
    import random

    r = random.Random(3)
    rows = []
    for k in range(120):
        host = r.choice("aab")
        nav = f"<div><ul><li>{r.randrange(9)} of {host}</li><li>menu</li></ul></div>"
        foot = f"<div>{r.choice(['one foot', f'foot {k}'])}</div>"
        rows.append((k, f"http://{host}.example/{k}", f"<body>{nav}<article><p>text {k % 110}</p><div>boxed {r.randrange(2)}</div></article>{foot}</body>"))
    contents, by = plain_counts(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (500_000, 0):
        for got in html.extract(df, broadcast_limit=limit, report=True).collect():
            page = html.Page(rows[got["page_id"]][2], got["url"])
            host = html.host_of(got["url"])
            often = {key: len(found) for (h, _), found in by.items() if h == host for key in set(found.values())}
            gone, stack = 0, [page.root]
            while stack:
                e = stack.pop()
                n = often.get(e.key, 0) if e.candidate else 0
                if n >= 3 and not e.inside or n >= 8 and 3 * n >= len(contents[host]) and e.tag in html.CONTAINERS:
                    gone += e.size
                else:
                    stack += [p for p in e.parts if not isinstance(p, str)]
            assert got["template_chars"] == gone
            boxed = rows[got["page_id"]][2].split("boxed ")[1][0]
            box = next(e for e in page.order if e.tag == "div" and e.inside)
            assert (f"boxed {boxed}" in got["text"]) == (3 * often[box.key] < len(contents[host]))


def test_both_paths_agree_inside_an_article(spark):
    """A block that is template outside eight articles stays in the ninth."""
    same = "<p>about this site</p>"
    rows = [(k, f"http://h.example/{k}", f"<body>{same}<article><p>text {k}</p></article></body>") for k in range(8)]
    rows.append((8, "http://h.example/8", f"<body><article>{same}<p>text 8</p></article></body>"))
    rows.append((9, "http://h.example/9", f"<body>{same}<article>{same}<p>text 9</p></article></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (500_000, 0):
        got = {r["page_id"]: r["text"] for r in html.extract(df, broadcast_limit=limit).collect()}
        assert got[0] == "text 0" and got[8] == "about this site\n\ntext 8" and got[9] == "about this site\n\ntext 9"


def test_pages_nasty(pages, spark):
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect()}
    assert got.count() == len(PAGES) and (4, "not a url", "", 0) in rows and (9, "http://b.example/w", "", 0) in rows
    assert rows == {(i, u, t, len(t)) for i, u, h in PAGES for t in [html.text_of(h, u)]}
    assert {tuple(r) for r in html.extract(pages, broadcast_limit=-1).collect()} == rows
    assert html.extract(pages.limit(0)).collect() == []


def test_real_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html.extract(df).collect():
        assert r["text"] and "<" not in r["text"] and "©" not in r["text"]


# archives


def expected_records(rows, least=1000):
    by: dict = {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(-(1 << 63) if i is None else i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = max(by[body])
        revisit = len(body) >= least and (-(1 << 63) if i is None else i) != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(map(repr, out))


def test_archives_nasty(pages):
    got = warc.round_trip(pages)
    assert sorted(repr(tuple(r)) for r in got.drop("url").collect()) == expected_records(PAGES)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_of_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted(repr(tuple(r)) for r in warc.round_trip(df).drop("url").collect()) == expected_records([(r["page_id"], r["url"], r["html"]) for r in df.collect()])


def archive():
    return warc.record("urn:page:1", "http://x", b"first") + warc.record("urn:page:2", "u", b"second " * 50_000) + warc.record("urn:page:3", "u", b"second " * 50_000, "urn:page:2")


def test_reader():
    one, two, three = warc.records(io.BytesIO(archive()))
    assert (one.kind, one.payload, one.headers["warc-target-uri"]) == ("response", b"first", "http://x")
    assert two.payload == b"second " * 50_000 and two.http["content-length"] == "350000"
    assert (three.kind, three.payload, three.headers["warc-refers-to"], three.headers["warc-profile"]) == ("revisit", b"", "<urn:page:2>", warc.PROFILE)
    assert three.headers["warc-payload-digest"] == two.headers["warc-payload-digest"]
    assert gzip.decompress(archive()).startswith(b"WARC/1.1\r\n")  # any gzip tool reads it


class Dribble(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_takes_any_pieces():
    assert [r.payload for r in warc.records(Dribble(archive()))] == [r.payload for r in warc.records(io.BytesIO(archive()))]


def member(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def test_damage():
    plain = zlib.decompress(warc.record("urn:page:1", "u", b"payload"), 31)
    for bad in (
        archive()[:-9],
        member(plain.replace(b"payload", b"pavload")),
        member(plain.replace(b"WARC/1.1", b"HTTP/1.1")),
        member(plain[:-1]),
        member(plain[: plain.index(b"Content-Length")]),
        member(plain + b"more"),
    ):
        with pytest.raises((ValueError, KeyError)):
            list(warc.records(io.BytesIO(bad)))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_a_repeated_write_replaces_its_files(pages):
    where = f"{shared_dir(pages.sparkSession)}/twice"
    for _ in range(2):
        found = warc.write(pages, where)
        assert sorted(repr(tuple(r)) for r in warc.read(found, where).drop("url").collect()) == expected_records(PAGES)
