"""Trees of malformed pages: ends that follow from what comes next, and marks that stay within their block."""

import re

import pyarrow.parquet as pq
import pytest

from verbaloom.operators import html as H

#: Page, the tree that it has to give. Tags with their content in parentheses; text as it is.
TREES = [
    ("<p>a <b>x<p>y</p><p>z</p>", "p(a b(x)) p(y) p(z)"),
    ("<p>a<p>b", "p(a) p(b)"),
    ("<p>a <b>x</p>y", "p(a b(x)) y"),
    ("<p>a <i>x <b>y</p><p>z", "p(a i(x b(y))) p(z)"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "ul(li(a) li(b ul(li(c))) li(d)) e"),
    ("<ul><li>a <b>x<li>y</ul>", "ul(li(a b(x)) li(y))"),
    ("<ul><li><p>a<li><p>b</ul>", "ul(li(p(a)) li(p(b)))"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "table(tr(td(a) td(b)) tr(td(c))) d"),
    ("<table><tr><th>h<td>a <b>x<td>y</table>", "table(tr(th(h) td(a b(x)) td(y)))"),
    ("<table><thead><tr><th>h<tbody><tr><td>c</table>", "table(thead(tr(th(h))) tbody(tr(td(c))))"),
    ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "table(tr(td(a table(tr(td(b))) c) td(d)))"),
    ("<p>a<table><tr><td>b</table>", "p(a) table(tr(td(b)))"),
    ("<p>a<h2>t</h2>b", "p(a) h2(t) b"),
    ("<h2>t<p>a", "h2(t) p(a)"),
    ("<p>a<ul><li>b</ul>c</p>d", "p(a) ul(li(b)) c d"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt(a) dd(b) dt(c))"),
    ("<b>a<div>b</b>c</div>d", "b(a div(b c) d)"),
    ("<a href=x>a<a href=y>b</a>c", "a(a) a(b) c"),
    ("<div><p>a</div>b</p>c", "div(p(a)) b c"),
    ("<p>a<br>b<img src=s>c</span>d", "p(a br() b img() c d)"),
    ("<table><tr><td>a</tr></b><tr><td>b</p>c</table>", "table(tr(td(a)) tr(td(b c)))"),
    ("<ol><li>a<div>b<li>c</ol>", "ol(li(a div(b)) li(c))"),
    ("<select><option>a<option>b</select>", "select(option(a) option(b))"),
    ("<p>a <em>b <strong>c<blockquote>d</blockquote>e", "p(a em(b strong(c))) blockquote(d) e"),
    ("<div/>a</div>b", "div(a) b"),
    ("</p></b>a", "a"),
]


def outline(node):
    return " ".join(f"{c.tag}({outline(c)})" if isinstance(c, H.Node) else c.strip() for c in node.children if isinstance(c, H.Node) or c.strip())


@pytest.mark.parametrize(("page", "tree"), TREES)
def test_tree(page, tree):
    assert outline(H.parse(page, H._TreeBuilder)) == tree
    assert outline(H.faithful(f"<html><head><title>t</title><body>{page}", "", "")) == tree


def test_markdown_of_unclosed_bold():
    assert re.sub(r"\n\n+", "|", H.markdown(H.faithful("<p>a <b>x<p>y</p><p>z</p>", "", "")).strip()) == "a **x**|y|z"


def test_deep_markup_keeps_links_and_marks():
    """A mark or link counts at any depth."""
    text = H.markdown(H.faithful("<div>" * 1500 + '<a href="/x">l</a> <b>m</b>', "https://h", "https://h/b/"))
    assert "[l](https://h/x) **m**" in text


def test_no_mark_over_two_paragraphs():
    marks = 0
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist():
        for n in H.faithful(page, "https://h", "https://h/b/").walk():
            if n.tag in {"b", "strong", "i", "em"}:
                marks += 1
                assert not any(x.tag in {"p", "li", "td", "h1", "h2"} for x in n.walk())
    assert marks > 100


def test_ids_beside_a_null(spark):
    rows = [(2**53 + 1, "<p>a"), (None, "<p>b"), (2**62 + 1, None), (3, "<p>c<li>d")]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    got = {(r["page_id"], r["text"].strip()) for r in H.to_markdown(pages, "", "").collect()}
    assert got == {(2**53 + 1, "a"), (None, "b"), (2**62 + 1, ""), (3, "c\n\n\n- d")}
    assert {r["page_id"] for r in H.html_blocks(pages).collect()} == {2**53 + 1, None, 3}
