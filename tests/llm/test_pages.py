import gzip
import itertools
import random

from quadtide.llm import htmlcut, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href=/x>Home</a><li><a href=/y>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><!-- an <b>ad</b> --><div class='ad'>Buy now.</div>
<article><h1>The  title &amp; more</h1><p>First <b>bold</b>\n text&nbsp;here.<p>Second &lt;tag&gt; paragraph, with a <a href="a>b">link</a> in it.</p>
<ul><li>point one</ul></article><section id="comments"><p>I disagree with every word of this long article.</p></section>
<aside><p>Read also this other story about something else.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2024</footer></body></html>"""


def test_article_only():
    assert htmlcut.main_blocks(PAGE) == ["The title & more", "First bold text here.", "Second <tag> paragraph, with a link in it.", "point one"]


def test_names_of_the_whole_page():
    text = "A sentence of some length that is the only text of its article, and long enough."
    for html, body, main, article, h1 in itertools.product(("", "has-sidebar"), ("", "right-sidebar", "comments-open"), ("", "with-sidebar"), ("", "post has-comments"), ("", "respond")):
        page = f'<html class="{html}"><body class="{body}"><div id="sidebar"><p>{text} Not.</p></div><main class="{main}"><article class="{article}"><h1 class="{h1}">Title</h1><p>{text}</p><div class="comments entry"><p>{text} No.</p></div></article></main></body></html>'
        assert htmlcut.main_blocks(page) == ["Title", text]


def test_broken_and_missing_markup():
    assert htmlcut.main_blocks(None) == htmlcut.main_blocks("") == htmlcut.main_blocks("<html></html>") == []
    text = "Plain text of some length that stands alone without any markup at all, and is long enough."
    assert htmlcut.main_blocks(text) == [text]
    assert htmlcut.main_blocks(f"<article><p>{text}<p><b>{text}") == [text, text]
    assert htmlcut.main_blocks("<article><p>a < b</p><script>never closed") == ["a < b"]
    assert len(htmlcut.main_blocks("<article>" + "<p>word word word.</p>" * 5000)) == 5000


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
        cost = lambda keep: sum(max(g, 0) for g, k in zip(gain, keep) if not k) + sum(max(-g, 0) for g, k in zip(gain, keep) if k) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731,B023
        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(htmlcut.min_cut(gain, edges)) - best) < 1e-9


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE, "t", 5), (1, "u", PAGE, "t", 5), (None, None, None, None, None), (3, "v", "", "t", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = htmlcut.extract(pages).collect()
    text = "\n".join(htmlcut.main_blocks(PAGE))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), *[(1, text, len(text))] * 2, (3, "", 0)]
    assert htmlcut.extract(pages.limit(0)).count() == 0


def test_derivatives_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>One &amp; two</p>", "x"), (2, None, None, "x"), (1, "http://a/", "<p>One &amp; two</p>", "x")], "page_id long, url string, html string, record_id string")
    sources = warc.responses(pages)
    made = warc.derivatives(sources)
    rows = made.collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4
    assert {r.refers_to for r in rows} == {r.record_id for r in sources.collect()}
    one = {r.type: r for r in rows if r.page_id == 1}
    assert bytes(one["conversion"].content) == b"One & two"
    meta = bytes(one["metadata"].content).decode()
    assert f"source-payload-digest: {warc.sha1(b'<p>One &amp; two</p>')}\r\n" in meta and "source-header-content-type: text/html; charset=utf-8\r\n" in meta
    assert one["metadata"].block_digest == warc.sha1(bytes(one["metadata"].content))
    raw = b"".join(gzip.decompress(bytes(r.member)) for r in warc.members(made).collect())
    assert raw.count(b"WARC/1.1\r\n") == 6 and raw.count(b"WARC-Refers-To: ") == 6
    assert warc.derivatives(sources.limit(0)).count() == 0


def test_http_parts():
    status, headers, body = warc.split_http(b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=latin-1\r\nX: a:b\r\n\r\n<p>\xe9")
    assert (status, headers) == ("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=latin-1"), ("X", "a:b")])
    assert warc.plain_text(body, headers) == "é" and warc.plain_text(b"x", [("Content-Type", "image/png")]) == ""
