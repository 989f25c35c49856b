import re
import time
from html.parser import HTMLParser

import pytest

from llm.html_layout import html_text, op9, page_text

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "a<div>b</div>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "* a\n* b\n  * c\n* d",
    "<ol start=3><li>x<li value=9>y<li>z</ol>": "3. x\n9. y\n10. z",
    "<ol type=i reversed><li>x<li>y</ol>": "ii. x\ni. y",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><th colspan=2>wide one<tr><td>a<td>b</table>": "wide one\na  b",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><caption>T</caption><tfoot><tr><td>f</tfoot><tr><td>b</table>": "T\nb\nf",
    "x<table>stray<tr><td>in</table>y": "xstray\n\nin\n\ny",
    "<td>cell</td> text": "cell text",
    "<head><title>t</title><style>p{}</style><p>seen": "seen",
    "<script>if (a < b) '</p>'</script>ok<!-- no > --> go": "ok go",
    "<p hidden>no</p><p style='display:NONE'>no</p><p style='visibility:hidden'>no <b style='visibility: visible'>yes</b></p>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>": "s\nt\nyes",
    "<pre>\n a\n\tb </pre>": " a\n        b",
    "a<br>b<hr>c": "a\nb\n\n---\n\nc",
    "&lt;b&gt; &amp &copy; a&nbsp;b": "<b> & © a\xa0b",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote><p>q</blockquote>": "  q",
    "<select><option>a<option>b</select>": "a\nb",
    "<a title='x > y'>in</a> <b>bold": "in bold",
    "1 < 2 and <3": "1 < 2 and <3",
    "<h1>H<h2>I": "H\n\nI",
    "</p></div></table>end": "end",
    "<table><tr><td>中文<td>x<tr><td>abcdef<td>y</table>": "中文    x\nabcdef  y",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert page_text(page) == CASES[page]


def test_depth_and_length():
    deep = "<div>" * 50_000 + "bottom" + "</div>" * 50_000
    assert page_text(deep) == "bottom"
    assert page_text("<table><tr><td>" * 3000 + "in").split() == ["in"]
    assert len(page_text("<p>word " * 100_000).split()) == 100_000
    assert page_text("<" * 100_000) == "<" * 100_000
    assert page_text('<a b="' * 2000 + "x") == "" and page_text("<a " * 50_000) == ""
    assert page_text("<!--" + "x" * 100_000) == ""


class Visible(HTMLParser):
    """Words outside the head, scripts and styles, found by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")
        if tag in ("p", "div", "li", "br", "h1", "td"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style")
        self.words.append(" " if tag not in ("b", "a", "i") else "")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_query_keeps_all_visible_words(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = op9(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for row in out:
        other = Visible()
        other.feed(pages[row.page_id])
        other.close()
        bullets = re.sub(r"(?m)^ *\* ", "", row.text)
        assert "".join(bullets.split()) == "".join("".join(other.words).split()), pages[row.page_id][:300]


HIDING = [
    ("<p hidden>no</p>yes", "yes"),
    ("<p hidden>no<p>yes", "yes"),
    ("<div hidden><div>no</div><b>no</b>no<br>no</div>yes", "yes"),
    ("<div style='display:none'><ul><li>no<ul><li>no</ul></ul></div><i>yes</i>", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<details>no<summary>yes</summary><p>no</p></details>", "yes"),
    ("<details hidden>no<summary>no</summary></details>yes", "yes"),
    ("<div hidden><table><tr><td>no</td><td>no</td></tr></table>no</div>yes", "yes"),
    ("<div hidden><script>no</script><textarea>no</textarea></div>yes", "yes"),
    ("<h1 hidden>no<h2>yes</h2>", "yes"),
    ("</div></div>yes", "yes"),
]


@pytest.mark.parametrize("depth", [0, 3, 180, 196, 197, 198, 199, 200, 205, 3000])
@pytest.mark.parametrize("page, text", HIDING)
def test_hidden_at_any_depth(page, text, depth):
    assert page_text("<div>" * depth + page).strip() == text
    assert page_text("<table><tr><td>" + "<div>" * depth + page).strip() == text


def test_deep_pages_take_time_in_proportion():
    start = time.monotonic()
    assert page_text("<p><button>" + "<div>" * 200_000 + "yes") == "yes"
    assert time.monotonic() - start < 60


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "<p>a", "z"), (None, "<p>a", "z")], "page_id long, html string, text string")
    assert sorted(((r.page_id, r.text) for r in html_text(df).collect()), key=str) == sorted([(1, ""), (2, ""), (None, "a"), (None, "a")], key=str)
    assert html_text(df.limit(0)).count() == 0
