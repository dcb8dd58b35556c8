import time
from html.parser import HTMLParser

import pytest

from barframe.llm.html import extract, op1_html_extraction, parse, render, width

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<h1>T</h1>text <b>bold</b>, <i> it </i>end", "T\n\ntext bold, it end"),
    ("<script>var a='<p>no</p>'</script><style>x</style>yes<!-- no --><noscript>no</noscript>", "yes"),
    ("<p hidden>no<p style='color:red; display : none'>no<p style='visibility:hidden'>no<p>yes", "yes"),
    ("<title>T</title><body>b", "b"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>after", "name       n\nlong name  1\nx          22\n\nafter"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide one here<td>z<tr><td>a<td>b<td>c</table>", "wide one here z\na  b  c"),
    ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>", "o     p\n\ni  j"),
    ("<blockquote>q</blockquote>r", "    q\n\nr"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("a <unclosed", "a"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("</div></p>x</span>", "x"),
    ("<a href='x>y'>l</a><img alt='pic'>", "l pic"),
    ("<textarea>\n<b>x</textarea>", "<b>x"),
    ("<select><option>a<option>b</select>z", "a z"),
]

SHOWN = [
    ("<select><option>a<option selected>b<optgroup label=g><option>c</select>z", "b z"),
    ("<select><option disabled>pick<option>b</select>", "b"),
    ("<select multiple><option>a<optgroup><option label='b!'>b</select>", "a b!"),
    ("<select size=3><option>a<option hidden>no<option>c</select>", "a c"),
    ("<select></select>x<datalist><option>no</datalist>", "x"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> y", "x=2 y"),
    ("a<svg><title>no</title><path d='M0'/><g><text x=1>Ax<tspan>is</tspan></text><text>B</text></g><desc>no</desc></svg>b", "a Axis B b"),
    ("<svg><circle/><circle/></svg><p>after", "after"),
    ("<input value=typed><input type=text value=more><input type=password value=no><input type=hidden value=no><input type=checkbox value=no><input type=submit value=Go>", "typed more Go"),
    ("<table>stray<tr><td>c</table>after", "stray\n\nc\n\nafter"),
    ("<table><tr>one<td>c<div>d</div></td>two</table>", "onetwo\n\nc\nd"),
    ("<table><div>x<tr><td>c</div>d</table>", "x\n\ncd"),
    ("<table><tr><td>a <table>in<tr><td>b</table></table>", "a in\n\nb"),
    ("<tr><td>no table</td></tr>x", "no tablex"),
    ("<table><tr><td colspan=70000>w<td>x<tr><td rowspan=00002>a<td>b<tr><td>c</table>", "w" + " " * 2001 + "x\na  b\n   c"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=2>ab cd ef<td>z<tr><td>1<td>2<td>3</table>", "ab cd ef z\n1  2  3"),
]


@pytest.mark.parametrize("html,want", SHOWN)
def test_all_that_shows(html, want):
    assert render(parse(html)) == want


def test_broken_pages_take_linear_time():
    """Tags without a match cost the same however many elements are open."""
    for page in (lambda n: "<div>" * n + "</span>" * n, lambda n: "<div><table><tr><td>" + "<span>" * n + "</div>" * n + "x", lambda n: "<p>" + "<b>" * n + "<li>" * n + "x", lambda n: "<table>" + "<div>s" * n):
        took = []
        for n in (4000, 32000):
            t = time.perf_counter()
            parse(page(n))
            took.append(time.perf_counter() - t)
        assert took[1] < 40 * took[0] + 0.5, took


@pytest.mark.parametrize("html,want", CASES)
def test_render(html, want):
    assert render(parse(html)) == want


SHOWN_AGAIN = [
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<p>no</div>after", "yes\n\nafter"),
    ("a<span style='visibility:hidden'>no<b style='visibility:visible !important; visibility:hidden'>b<i>c</i></b>no</span>d", "abcd"),
    ("<ol style='visibility:hidden'><li>no<li style='visibility:visible'>x</ol>", "2. x"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>b<tr style='visibility:inherit'><td>no<td>no</table>z", "  b\n\nz"),
    ("<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr><td>d<td>e<td>f<tr style='visibility:collapse'><td style='visibility:visible'>no</table>", "a     c\nd  e  f"),
    ("<p style='visibility:hidden'>no<img alt=no><q>no</q><br><br><input type=submit value=no><p>yes", "yes"),
]


@pytest.mark.parametrize("html,want", SHOWN_AGAIN)
def test_visibility_is_inherited(html, want):
    assert render(parse(html)) == want


def test_deep_and_wide():
    assert render(parse("<div>" * 20000 + "x")) == "x"
    assert render(parse("<table><tr><td>" * 300 + "x")) == "x"
    assert width("é") in (1, 2) and width("日本") == 4
    assert render(parse("<p>w " * 30000)).count("w") == 30000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None), (3, "", "", "")], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a"), (3, "")]
    assert extract(df.limit(0)).collect() == []


class Words(HTMLParser):
    """A plain reading by another parser: words of text outside elements that never show."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_query_has_all_visible_words(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        w = Words()
        w.feed(pages[r.page_id])
        w.close()
        assert [x for x in r.text.split() if x != "-"] == [x for x in w.words if x != "-"]
        assert r.title and r.n_lines == len(r.text.split("\n"))
