import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from pixelwarrant.llm import html_layout
from pixelwarrant.llm.html_layout import text_of
from pixelwarrant.llm.queries import op7_html_text


def test_layout():
    cases = {
        "<p>a<p>b": "a\n\nb",
        "<ul><li>x<li>y<ol start=3><li>1<li>2</ol><li>z</ul>": "• x\n• y\n  3. 1\n  4. 2\n• z",
        "<table><tr><th>Name<th>Count<tr><td>Al<td>12<tr><td colspan=2>wide cell over both</table>after": "Name  Count\nAl    12\nwide cell over both\n\nafter",
        "<table><tr><td>日本<td>7<tr><td>a<td>8</table>": "日本  7\na     8",
        "<table><caption>Cap</caption><tr><td>a<br>b<td>c</table>": "Cap\n\na  c\nb",
        "<table><tr><td><table><tr><td>in<td>ner</table><td>x</table>": "in  ner  x",
        "a <b> b </b> c<br>d": "a b c\nd",
        "<pre>  k\n   l</pre>": "  k\n   l",
        "<div>a<div>b</div>c</div>": "a\nb\nc",
        "<p hidden>no<p style='color:red; DISPLAY : none'>no<div aria-hidden=true>no</div>yes": "yes",
        "<head><title>t</title><style>s</style></head><body>x<script>var a = '<p>';</script>y": "xy",
        "&lt;tag&gt; &copy; &eacute;&#233;": "<tag> © éé",
        "a<!-- <p>b --> c<!doctype html> d": "a c d",
        "<a href='x>y'>link</a> <img alt='pic' src=x>": "link pic",
        "<dl><dt>T<dd>D</dl>": "T\n    D",
        "x</div></p>y<b": "x\n\ny",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "": "", "<p></p>": "", "<li>loose": "• loose",
    }
    for page, want in cases.items():
        assert text_of(page) == want, page
    assert text_of(None) is None


def plain(page):
    """Words of the page with markup cut out by patterns, for pages without hidden parts in the body."""
    page = re.sub(r"(?s)<(head|script|style)\b.*?</\1>|<!--.*?-->", " ", page)
    return html.unescape(re.sub(r"<[^>]*>", " ", page)).split()


def test_query_shows_all_visible_words(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op7_html_text(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, text in got.items():
        assert "".join(w for w in text.split() if w != "•") == "".join(plain(pages[i])), i


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td colspan=3>", "</td>", "</table>", "<b>", "</b>", "<ol>", "<div hidden>", "</div>", "text ", "&amp;", "<br>", "<pre>", "</pre>", "<", "<!--", "<dd>", "</li>", "</tr>"]), max_size=40))
def test_any_markup_is_rendered(parts):
    assert isinstance(text_of("".join(parts)), str)


def test_deep_and_long_pages_take_linear_time():
    start = time.process_time()
    assert text_of("<div>" * 100_000 + "deep").strip() == "deep"
    assert text_of("<b>x</b>" * 200_000).count("x") == 200_000
    assert text_of("<p>y" * 100_000).count("y") == 100_000
    assert text_of("<" * 100_000).count("<") == 100_000
    assert text_of("<!--" * 50_000) == ""
    assert time.process_time() - start < 60


def test_edge_rows(spark):
    rows = [Row(page_id=1, html=None, text="old"), Row(page_id=None, html="<p>a", text="old"), Row(page_id=None, html="<p>a", text=None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((r.text or "-") for r in html_layout.extract(df).collect()) == ["-", "a", "a"]
    assert html_layout.extract(df).columns == ["page_id", "text"] and html_layout.extract(df.limit(0)).count() == 0
