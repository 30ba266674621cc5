"""Templates deduced from pages of one host, and what is left of a page."""

import pytest

from pyspark.sql import functions as F

from sharelens.llm import html_template as tpl


def texts(spark, pages):
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    table = table.select("*", *(F.lit("x").alias(c) for c in "host path main fixed of text pages total".split()))
    return {r.page_id: r.text for r in tpl.extract(table).collect()}


def article(body, nav="Home", notice="We use cookies."):
    return (
        f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body><header><h1>Site</h1></header>'
        f'<nav><ul><li><a href="/x">{nav}</a></li></ul></nav><div class="cookie-notice">{notice}</div><!-- ad 1 --><div class="ad">Buy!</div>'
        f'<article><h1>Head &amp; line</h1>{body}<form>Name<input name=q></form><section class="comments"><p>Nice!</p></section></article>'
        f'<aside>side</aside><div id="sidebar">more</div><footer>&copy; us</footer></body></html>'
    )


def test_article(spark):
    pages = [("http://a.org/1", article("<p><b>First</b> one.<br>\n next<p>Second&nbsp;&lt;b&gt; &#x27;q&#39; &am")), ("http://a.org/2", article("<p>x</p>", nav="Other"))]
    found = texts(spark, pages)
    assert found[0] == "Head & line First one. next Second <b> 'q' &am" and found[1] == "Head & line x"


def plain(body, menu, note="Please read the rules."):
    return (
        f'<html><body><div class="top"><a href="/">{menu}</a> <a href="/b">B</a></div><div class="row"><div class="col"><p>{body}</p><p>{body[::-1]}</p></div>'
        f'<div class="remark">{note}</div></div></body></html>'
    )


def test_host_without_names_uses_text_and_links(spark):
    pages = [(f"https://b.org/{i}", plain(f"Body number {i} has quite some text of its own here.", f"Menu {i}")) for i in range(6)]
    found = texts(spark, pages)
    for i in range(6):
        body = f"Body number {i} has quite some text of its own here."
        assert found[i] == f"{body} {body[::-1]}"


def test_hosts_do_not_mix(spark):
    pages = [("http://c.org/1", "<main><p>one</p></main><div>x</div>"), ("http://d.org/1", "<div class='post'><p>two</p></div><div class='menu'>m</div>")]
    assert texts(spark, pages) == {0: "one", 1: "two"}


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<", "<"), ("a < b", "a < b"), ("<article>un<b>closed", "unclosed"),
        ("<article><p>a</p><ul><li>one<li>two</ul></article>", "a one two"), ("<article>a<script>no", "a"), ("<article>x<br/>y</article>", "x y"),
        ("</div></p><p>ok", "ok"), ("<article>cut <p class='x", "cut"), ("<article>" + "<div>" * 300 + "deep", "deep"),
    ],
)
def test_odd_pages(spark, page, want):
    assert tpl.main_text(page or "", ["article"], []) == want


def test_edge_rows(spark):
    long = "<article>" + "<p>para graph</p>" * 20_000 + "</article>"
    pages = [(None, None), ("", ""), ("not a url", "<p>x</p>"), ("http://l.org", long), ("http://l.org", long)]
    found = texts(spark, pages)
    assert found[0] == "" and found[1] == "" and found[2] == "x" and found[3] == found[4] == " ".join(["para graph"] * 20_000)


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert tpl.extract(table).count() == 0


def test_equal_vectors_form_classes():
    row = lambda path, signature, pages=10, **k: {"path": path, "signature": signature, "pages": pages, "most": 1, "size": 0, "linked": 0, "low": 0, "high": 1} | k
    rows = [row("html", 1, size=100), row("html>body", 1, size=100), row("html>body>div", 1, size=90), row("html>body>div>p", 2, most=7, size=90), row("html>body>ul>li", 3, size=9)]
    assert tpl.deduce(rows, 10) == (["html>body>div"], [])


def test_constant_text_below_a_named_article_is_template(spark):
    body = lambda i: f"Body number {i} has quite some text of its own here."
    page = lambda i: f"<html><body><article><p>{body(i)}</p><div class='x'>Follow us now.</div><p>All rights.</p></article></body></html>"
    found = texts(spark, [(f"http://n.org/{i}", page(i)) for i in range(6)])
    assert found == {i: body(i) for i in range(6)}


def test_repeated_rows_do_not_cancel(spark):
    page = "<html><body><div class='r'><p>{} with some words of its own</p></div><div class='q'>Constant words here.</div></body></html>"
    rows = [(i // 2, f"http://r.org/{i // 2}", page.format(f"Page {i // 2}")) for i in range(8)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    vectors = {r.path.rpartition(">")[2]: r.signature for r in tpl.token_statistics(tpl.host_of(table)).collect()}
    assert vectors["div.r"] == vectors["div.q"] != 0


@pytest.mark.parametrize(
    "outer", ["div class='content-with-sidebar'", "div class='has-sidebar'", "div id='share-page'", "div class='related-layout'", "form"]
)
@pytest.mark.parametrize("inner", ["article", "div", "div class='content'"])
def test_names_do_not_exclude_what_contains_the_article(spark, outer, inner):
    body = lambda i: f"Body number {i} has quite some text of its own here."
    page = lambda i: f"<body><{outer}><{inner}><p>{body(i)}</p><div class='share'>Send</div></{inner.split()[0]}></{outer.split()[0]}><div class='menu'>m</div></body>"
    found = texts(spark, [(f"http://w.org/{i}", page(i)) for i in range(4)])
    assert found == {i: body(i) for i in range(4)}


def test_each_layout_has_its_template(spark):
    body = lambda i: f"Body number {i} has quite some text of its own here, and a little more."
    names = ["a"] * 20 + ["b"] * 20 + ["c"] * 4
    page = lambda i: f"<body><div class='top'><a href='/'>Menu {i}</a> Day {i}</div><div class='{names[i]}'><p>{body(i)}</p><p>{body(i)[::-1]}</p></div></body>"
    for url in ("http://y.org/{}", None):
        found = texts(spark, [(url and url.format(i), page(i)) for i in range(44)])
        assert found == {i: f"{body(i)} {body(i)[::-1]}" for i in range(44)}
