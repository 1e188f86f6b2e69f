import random
import time

import pytest

from tests.llm.fixtures import SMALL
from waybill.llm import op4_html_text as op
from waybill.llm.registry import QUERIES

PAGES = [
    ("<p>a<p>b<ul><li>x<li>y<ol start=3><li>p<li>q</ol><li>z</ul>after<br>line", "a\n\nb\n\n* x\n* y\n  3. p\n  4. q\n* z\n\nafter\nline"),
    ("<table><tr><th>Name<th>Much<tr><td>fig tree<td>1<tr><td>漢字<td>22</table>tail", "Name      Much\nfig tree  1\n漢字      22\n\ntail"),
    ("<table>before<tr><td rowspan=2>a<td>b<tr><td>c</table>", "before\n\na  b\n   c"),
    ("<table><tr><td>one<br>two<td><table><tr><td>in<td>ner</table></table>", "one  in  ner\ntwo"),
    ("<b>one<p>two</b>three</p>four", "one\n\ntwothree\n\nfour"),
    ("<span hidden>x<span>y</span>z</span>w <i style='Display: none'>no</i> ok", "w ok"),
    ("<style>.ad{display:none} @media print{p{display:none}} p.x{visibility:hidden}</style><div class='big ad'>no</div>"
     "<p class=x>hid<b style='visibility:visible'>seen</b></p><p>yes", "seen\n\nyes"),
    ("<pre>\n a\n  b\n\nc</pre>d", " a\n  b\n\nc\n\nd"),
    ("a < b &amp; c &lt;d&gt; <!-- <p>x --> e <p title=\"a>b\">h", "a < b & c <d> e\n\nh"),
    ("<script>var t='</p>';</script>x<title>T</title><textarea><b></textarea>", "x<b>"),
    ("<dl><dt>t<dd>d1<dd>d2</dl><blockquote>q</blockquote>", "t\n  d1\n  d2\n\n  q"),
    ("", ""), ("<p a='never closed", ""), ("plain", "plain"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert op.render(html)[0] == text


def drawn(rng, depth, close):
    """Random blocks: html with end tags that may be left out, and the words to be seen."""
    html, seen = "", []
    for _ in range(rng.randrange(1, 5)):
        word = f"w{rng.randrange(10**6)}"
        kind = rng.choice(["p", "hidden", "script", "comment", "div", "ul", "ol", "blockquote", "table"] if depth else ["p", "hidden"])
        if kind == "p":
            html, seen = f"{html}<p>{word} <b>{word}</b>" + "</p>" * close, [*seen, word, word]
        elif kind == "hidden":
            html += f"<div hidden>{word}<p>{word}</div>"
        elif kind == "script":
            html += f"<script>'<p>{word}'</script>"
        elif kind == "comment":
            html += f"<!-- <p>{word} -->"
        else:
            parts = [drawn(rng, depth - 1, close) for _ in range(1 if kind in ("div", "blockquote") else 3)]
            item = {"ul": "li", "ol": "li", "table": "td"}.get(kind)
            inner = "".join(f"<{item}>{h}" + f"</{item}>" * close if item else h for h, _ in parts)
            # One cell to a row: cells beside each other would mix their lines.
            inner = inner.replace("<td>", "<tr><td>") if kind == "table" and not close else inner
            inner = inner.replace("<td>", "<tr><td>").replace("</td>", "</td></tr>") if kind == "table" and close else inner
            html += f"<{kind}>{inner}</{kind}>"
            seen += [w for _, own in parts for w in own]
    return html, seen


@pytest.mark.parametrize("close", [True, False])
def test_visible_words_stay_in_order(close):
    rng = random.Random(4)
    for _ in range(300):
        html, seen = drawn(rng, 3, close)
        assert [w for w in op.render(html)[0].split() if w.startswith("w")] == seen, html


def test_odd_pages_take_linear_time_and_lose_nothing():
    began = time.time()
    deep = op.render("<div>" * 20_000 + "x" + "<ul><li>y" * 2000)[0]
    assert deep.count("x") == 1 and deep.count("y") == 2000
    wide = op.render("<table>" + "<tr><td colspan=1000 rowspan=60000>x" * 1000)[0]
    assert wide.count("x") == 1000
    op.render("<b><table><div>" + "</b><div>" * 5000)
    long_cell = op.render(f"<table><tr><td>{'a ' * 50_000}<td>b" + "<tr><td>c<td>d" * 2000)[0]
    assert len(long_cell) < 500_000 and long_cell.count("d") == 2000
    assert time.time() - began < 60


def test_one_row_per_page(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, "<title> t  u</title>x"), (3, "u", None), (4, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = sorted((tuple(r) for r in op.html_text(pages).collect()), key=repr)
    assert found == sorted([(1, None, "a"), (1, None, "a"), (None, "t u", "x"), (3, None, None), (4, None, "")], key=repr)
    assert op.html_text(pages.limit(0)).count() == 0


def test_query_reads_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = {r.page_id: r for r in QUERIES["op4_html_text"](spark, SMALL).collect()}
    assert found.keys() == pages.keys()
    for k, r in found.items():
        assert (r.text, r.title) == op.render(pages[k]) and r.title and "track(" not in r.text and "margin" not in r.text
