"""Main text of pages: rules by hand, and the given pages against a plain reading of their article element."""

import html
import re
import time

import pytest

from turnstone.llm.html_text import blocks_of, extract, first_pass, main_text, second_pass
from turnstone.llm.queries import op13_html_text

SF = "/root/testdata/sf0.01"
LONG = "The house of the old man is on the hill and it is not far from the river and the town"
MORE = "When they had been there for a day she would have been with him and all of us in the end"


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title {LONG}</title><style>p{{a:b}}</style><script>var x='</p>{LONG}';</script></head><body>{body}</body></html>"


CASES = {
    "semantic": (f"<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav><main><article><header><h1>A head</h1></header><p>{LONG}"
                 f"<p>Two words.</p><aside><p>{MORE}</p></aside><p>{MORE}</p><footer>By me and the others of us</footer></article></main>"
                 f"<aside class=sidebar><p>{LONG}</p></aside><footer><p>{LONG} &copy; 2024</p></footer>", ["A head", LONG, "Two words.", MORE]),
    "divs": (f"<div id='menu'><a href=a>One</a> | <a href=b>Two</a></div><div class='page'><h2>A head</h2><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div>"
             f"<div class='cookie-notice'><p>{LONG}</p></div><div>© {LONG}</div>", ["A head", LONG, "Short.", MORE]),
    "comments": (f"<article><h1>A head</h1><p>{LONG}</p></article><section id=comments><h3>Comments</h3><article class=comment><p>{MORE}</p></article></section>"
                 f"<div class='user_comment'><p>{MORE}</p></div>", ["A head", LONG]),
    "forms": (f"<article><p>{LONG}</p><form><p>{MORE}</p><label>Name <input name=n></label><select><option>{LONG}</option></select></form><p>{MORE}</p>"
              f"<button>Send it all to us</button></article>", [LONG, MORE]),
    "adverts": (f"<article><p>{LONG}</p><div class=\"ad\">{MORE}</div><div class='advertisement box'>{MORE}</div><p class='adFree'>{MORE}</p><p class=promo>{MORE}</p></article>",
                [LONG, MORE]),
    "hidden": (f"<article><p>{LONG}</p><div hidden>{MORE}</div><div style='display: none'>{MORE}</div><p aria-hidden='true'>{MORE}</p></article>", [LONG]),
    "links": (f"<article><p>{LONG} with <a href=x>a link in it</a></p><p><a href=y>Read more of it</a></p><ul><li><a href=z>One</a></li></ul></article>",
              [LONG + " with a link in it"]),
    "references": ("<article><p>A &amp;&lt;p&gt; b&nbsp;c &eacute;&#233;&#xE9; &am &amp d&unknown; e</p></article>", ["A &<p> b c ééé &am & d&unknown; e"]),
    "white space": ("<article><p>\n a\tb <b> c</b>\r\n<br/>d  </p>\n<pre>e\n  f g</pre></article>", ["a b c d", "e f g"]),
    "inline": ("<article><p>one <b>t</b>wo<!-- three --> f<i>ou</i>r five</p></article>", ["one two four five"]),
    "no landmark, short only": ("<p>Hello there.</p>", []),
    "list": (f"<div><p>{LONG}</p><ul><li>First thing<li>Second thing</ul><p>{MORE}</p></div>", [LONG, "First thing", "Second thing", MORE]),
    "table": (f"<article><p>{LONG}</p><table><tr><td>a b c<td>d e f<tr><td>g h i</table></article>", [LONG, "a b c", "d e f", "g h i"]),
    "layout names": (f"<div class='has-sidebar'><div class='article-header'><h1>A head</h1></div><article class='post with-banner'><p>{LONG}</p></article></div>", [LONG]),
    "unclosed": (f"<article><h1>A head<p>{LONG}<div class=ad><p>{MORE}</div><p>{MORE}", ["A head", LONG, MORE]),
    "svg": (f"<article><p>one two <svg><text>no</text></svg> three {LONG}</p></article>", [f"one two three {LONG}"]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    body, want = CASES[name]
    assert main_text(page(body)) == "\n".join(want)


@pytest.mark.parametrize(("source", "want"), [
    (None, ""), ("", ""), (" \n ", ""), ("plain words only", ""), (LONG, LONG), ("<", ""), ("<article>a b c <", "a b c <"), ("<article>a b c < d", "a b c < d"),
    ("<article>a b c <p class='x", "a b c"), ("<article>a b c <!-- rest", "a b c"), ("<article>a b c <script>rest", "a b c"),
    ("<article><p>a b c</nav></div></p>d e f", "a b c\nd e f"), ("<ARTICLE><P>A b c</P></ARTICLE>", "A b c"), ("<!-->a<!--->", ""),
    ("<article><p title='a > b'>a b c</p>", "a b c"), ("<article><p title=5\">a b c</p>", "a b c"),
])
def test_broken_markup(source, want):
    assert main_text(source) == want


def test_second_pass_takes_the_nearest():
    body = f"<div><p>{LONG}</p><p>near good</p><p>also nearer to good</p></div><nav><p>x</p><p>y</p></nav><div><p>near bad</p></div>"
    blocks = blocks_of(page(body))
    first = [first_pass(b) for b in blocks]
    assert first == [True, None, None, False, False, None]
    assert second_pass(blocks, first) == [True, True, True, False, False, False]


@pytest.mark.parametrize("unit", ["<p>a b c</p>", "<div>", "</div>", "<a", "<p title=\"", "<!--", "&amp;", "<b>x", "< ", "<script>", "<a href='x'>l</a> ", "<button>x", "='\""])
def test_time_grows_with_the_page(unit):
    start = time.perf_counter()
    main_text(f"<article><p>{LONG}</p>" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 20


def plain_article(source):
    """The article of the given pages: it ends before the footer, and its blocks are h1 and p."""
    body = source[source.index("<article>") + 9 : source.rindex("</article>")]
    parts = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_html_text(spark, SF).collect()
    assert len(got) == len(pages) and [c for c, _ in op13_html_text(spark, SF).dtypes] == ["page_id", "url", "text", "n_chars"]
    for r in got:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_table_edges(spark):
    body = page(f"<article><p>{LONG} \U0001F600</p></article>")
    rows = [(1, "u", body, "x", 1), (1, "u", body, "y", 2), (None, None, body, None, None), (2, "v", None, "z", 3), (3, "w", "", "z", 4)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = extract(spark.createDataFrame(rows, schema)).collect()
    text = f"{LONG} \U0001F600"
    assert sorted(map(repr, got)) == sorted(repr(r) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, text, len(text))] * 2 + [(0, text, len(text)), (2, "", 0), (3, "", 0)])
    assert extract(spark.createDataFrame([], schema)).collect() == []
