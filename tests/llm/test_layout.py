import pytest
from pyspark.sql import functions as F

from wattquill.llm import layout

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>x</b><i>y</i> z", "xy z"),
    ("<b>x </b> <i> y</i>", "x y"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d<li>e</ol></ul>", "- a\n- b\n  3. c\n  9. d\n  10. e"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    ("<dl><dt>T<dd>D<dt>U</dl>", "T\n  D\nU"),
    ("<blockquote><p>q<p>r</blockquote>after", "> q\n>\n> r\n\nafter"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("&lt;b&gt; &amp; &copy; &#233;", "<b> & © é"),
    ("1 < 2 <3 a<b", "1 < 2 <3 a"),
    ("<script>if (a<b) x()</script>y<style>p{}</style>", "y"),
    ("<head><title>T</title></head><body>b", "b"),
    ("x<!-- <p>no</p> -->y<!-- open", "xy"),
    ("<p hidden>no<p style='color:red; display: none'>no<p>yes", "yes"),
    ("<style>.ad, #x{display:none}</style><p class='big ad'>no<p id=x>no<p class=b>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<input type=hidden value=no><input type=submit value=Go>", "Go"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>", "Name       Qty\napple pie  3"),
    ("<table><td>a<td>b</table>c", "a  b\n\nc"),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b  c"),
    ("<table><tr><td>a<p>b</p><td>c</table>", "a  c\nb"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<table><caption>Cap</caption><tbody><tr><td>1</td></tr></tbody></table>", "Cap\n1"),
    ("</p></div></td>x</li>", "x"),
    ("<a href='x>y'>link</a>", "link"),
    ("<a href='open>link", "link"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<textarea>  a\n b</textarea>", "  a\n b"),
    ("<style>@media print { .nav { display:none } }</style><p class=nav>yes", "yes"),
    ("<style>@media only screen and (max-width: 600px){.n{display:none}.m{color:red}}.o{display:none}</style><p class=n>yes<p class=o>no", "yes"),
    ("<style>@media screen, print{.n{display:none}}@media not print{.m{display:none}}</style><p class=n>no<p class=m>no<p>yes", "yes"),
    ("<style>@media (min-width:40em){.n{display:none}}@media(max-width:5px){p{display:none}}</style><p>yes<p class=n>no", "yes"),
    ("<style>@supports (display:grid){@media print{p{display:none}} .n{display:none}}</style><p>yes<p class=n>no", "yes"),
    ("<style>@import 'a.css'; /* } p{display:none} */ b{content:'}'} .n{display:none}</style><p>yes<p class=n>no", "yes"),
    ("<style>@keyframes k{from{display:none}} @media (prefers-reduced-motion){p{display:none}}</style><p>yes", "yes"),
    ("<style media=print>p{display:none}</style><style media='screen'>.n{display:none}</style><p>yes<p class=n>no", "yes"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
    ("a<svg>no<defs><text>no</text></defs><title>no</title><text x=1>one</text><g><text>t<tspan>wo</tspan></text></g></svg>b", "a\none\ntwo\nb"),
    ("<map name=m><area href=x>yes</map>", "yes"),
    ("a<xmp> <b>x</b>\n  &amp;</xmp>b", "a\n\n <b>x</b>\n  &amp;\n\nb"),
    # the winning declaration decides
    ("<style>.tab{display:none} .tab.active{display:block}</style><p class='tab active'>yes<p class=tab>no", "yes"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>yes<p class=x style='color:red'>no", "yes"),
    ("<style>.x{display:none} .x{display:block}</style><p class=x>yes", "yes"),
    ("<style>.x{display:block} .x{display:none}</style><p class=x>no<p>yes", "yes"),
    ("<style>#i{display:block} .x{display:none} p{display:none}</style><p class=x id=i>yes<p class=x>no", "yes"),
    ("<style>.x{display:none!important}</style><p class=x style='display:block'>no<p class=x style='display:block !important'>yes", "yes"),
    ("<p style='x-display:none'>yes<p style='display:none;display:nonsense'>no<p style=\"content:'display:none'\">too", "yes\n\ntoo"),
    ("<style>.x{visibility:hidden} .y{visibility:visible}</style><p class=x>no<b class=y>yes</b><i style='visibility:inherit'>no</i>", "yes"),
    ("<style>.row{display:flex}</style><p hidden class=row>yes<p hidden>no", "yes"),
    ("<style>.tab:not(.active){display:none}</style><p class='tab active'>yes<p class=tab>no<p>too", "yes\n\ntoo"),
    ("<style>p[data-x]{display:none} [role=menu]{display:none}</style><p data-x=1>no<p role=menu>no<p role=main>yes", "yes"),
    ("<style>.a .b{display:none} .m:hover{display:none}</style><p class=b>yes<p class=m>too", "yes\n\ntoo"),
    ("<style>.t{display:none} .a > .t.on{display:block} .t:hover{display:block}</style><p class='t on'>yes<p class=t>no", "yes"),
    ("<style>.t{display:none; &.on{display:block}}</style><p class='t on'>yes<p class=t>no", "yes"),
    ("<p class=x>yes<style>.x{display:none} p.x{display:block}</style><p class=x>too<b style='display:none'>no", "yes\n\ntoo"),
    ("<p class=x>no<style>.x{display:none}</style><p>yes", "yes"),
    ("<template><style>p{display:none}</style></template><p>yes", "yes"),
    ("a<plaintext><b>x</b>", "a\n\n<b>x</b>"),
    (f"<table><tr><td>{'w' * 60}<td>b<tr><td>c<td>d</table>", f"{'w' * 60}  b\nc{' ' * 61}d"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_layout(source, text):
    got = layout.rendered(source)[1]
    if source.startswith("</p>"):
        got = got.strip()
    assert got == text


def test_title():
    assert layout.rendered("<title>A &amp;\n B</title>x") == ("A & B", "x")


def test_deep_and_long_pages():
    assert layout.rendered("<div>" * 50_000 + "x")[1] == "x"
    assert layout.rendered("<b>" * 20_000 + "x" + "</b>" * 20_000)[1] == "x"
    assert layout.rendered("<a " * 100_000)[1] == ""
    assert layout.rendered("<p>word " * 50_000)[1].count("word") == 50_000
    row = "<tr><td>1<td>2"
    assert layout.rendered("<table>" + row * 5000 + "</table>")[1].count("\n") == 4999


@pytest.mark.parametrize(
    ("unit", "times", "word"),
    [("<div>t", 166_000, "t"), ("<ul><li>t", 110_000, "t"), ("<ol><li><p>t", 83_000, "t"), ("<table><tr><td>t", 62_000, "t"), ("<blockquote>t", 77_000, "t"), ("<b></i></p>t", 83_000, "t")],
)
def test_nested_megabyte(unit, times, word):
    """Time is linear in the page and no text is lost at any depth."""
    import time

    begun = time.process_time()
    text = layout.rendered(unit * times)[1]
    assert time.process_time() - begun < 30
    assert text.count(word) == times


def test_marks_of_deep_lists():
    depth = layout.MOST_LEVELS + 3
    lines = layout.rendered("<ul><li>" * depth + "x<br>y" + "</ul>" * 3 + "z")[1].split("\n")
    assert lines[0] == "- " * depth + "x"
    assert [x.strip() for x in lines[1:]] == ["y", "z"]


def test_many_rules():
    sheet = "".join(f".c{k}{{display:none}} .c{k}.on{{display:block}}" for k in range(5000))
    body = "".join(f"<p class='c{k}'>no<p class='c{k} on'>yes" for k in range(5000))
    assert set(layout.rendered(f"<style>{sheet}</style>{body}")[1].split()) == {"yes"}


def test_no_visible_word_is_lost(spark, small):
    """On well-formed given pages: the words between tags, script and style left out."""
    import html
    import re

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html)
        words = html.unescape(re.sub(r"<[^>]*>", "\0", body)).replace("\0", " ").split()
        text = layout.rendered(r.html)[1]
        assert "".join(words) == "".join(re.sub(r"(?m)^\s*- ", "", text).split())


def test_frames(frame):
    pages = frame([(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a")], "page_id long, url string, html string")
    got = layout.with_layout(pages.withColumn("page_text", F.lit("mine"))).collect()
    assert [(r.page_id, r.page_text) for r in got] == [(1, None), (2, ""), (3, "a"), (3, "a")]
    assert layout.with_layout(pages.filter("false")).count() == 0
