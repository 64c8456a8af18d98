"""Wrapper inference and main texts: shapes by hand, pages whose article is known, and a plain reading of the given pages."""

import html
import re

import pandas as pd
import pytest

from quayline.llm import html_text
from quayline.storage import table
from tests.llm.conftest import prose

SCHEMA = "page_id long, url string, html string, text string, host string, plan int"


def wrapper(*pages):
    units = [html_text.page_unit(html_text.page_tree(p)) for p in pages]
    out = units[0]
    for u in units[1:]:
        out = html_text.merge(out, u)
    return str(out)


def test_mismatches_become_slots_options_and_repetitions():
    assert wrapper("<h1>a</h1>", "<h1>b</h1>") == "<><h1>#</h1></>"
    assert wrapper("<h1>a</h1>", "<h1>a</h1>") == "<><h1>text</h1></>"
    assert wrapper("<h1>a</h1><p>x</p>", "<h1>b</h1>") == "<><h1>#</h1>(<p>text</p>)?</>"
    assert wrapper("<ul><li>a<li>b<li>c</ul>", "<ul><li>d</ul>") == "<><ul>(<li>#</li>)+</ul></>"
    assert wrapper("<h2>a</h2><div>1</div><h2>b</h2><div>2</div><h2>c</h2><div>3</div>") == "<>(<h2>#</h2><div>#</div>)+</>"
    assert wrapper("<div class='Post-17 wide'>x</div>", "<div class='Post-18 wide'>y</div>") == "<><div.post.wide>#</div.post.wide></>".replace("</div.post.wide>", "</div>")


def test_expressions_stay_bounded():
    many = "".join(f"<y-{k}>t{k}</y-{k}>" for k in range(600))
    unit = html_text.page_unit(html_text.page_tree(many))
    assert len(unit.items) == 1 and len(unit.items[0].items) <= html_text.LONGEST + 1
    assert html_text._chars(unit) == sum(len(f"t{k}") for k in range(600))  # their text still counts
    deep = html_text.bounded(html_text.page_unit(html_text.page_tree("<div>" * 5000 + "deep" + "</div>" * 5000)))
    assert html_text._chars(deep) == 4


ARTICLE = "<h1>Title &amp; more</h1><p>One <b>bold</b>,\n two&nbsp;three.<br>four<p>Fi<i>ve</i> &lt;b&gt; &#8217;&#x41;&copy<ul><li>x<li>y</ul>"
TEXT = "Title & more One bold, two three. four Five <b> ’A© x y"
AROUND = [
    "<nav><a href=/>Home</a></nav>{}<footer>f</footer>",
    "<header>top</header><div class='cookie-notice'>We use</div><main>{}<section id=comments><p>nice!</p></section></main><aside>s</aside>",
    "<div id='sidebar'><p>long long sidebar text</p></div><article class=post>{}<form><label>Your name</label><input></form><div class=ad>Buy</div></article><article class='comment'>first!</article>",
    "<script>if (a<b) document.write('</p>')</script><style>p{{}}</style><!-- <article>no</article> --><article>{}</article><noscript>no</noscript>",
    "<form id=all><div class='menu'>m</div><article>{}</article></form>",
    "<div><div class=left>{}</div><div class='footer links'>f</div></div>",
    "<article>{}<div class='related'><article>other</article></div>",
    "<div role=main>{}</div><div role='navigation'>n</div><div hidden>h</div><div style='display: none'>i</div>",
]


@pytest.mark.parametrize("around", AROUND)
def test_article_among_other_things(around):
    page = "<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8></head><body class='has-sidebar'>" + around.format(ARTICLE) + "</body></html>"
    unit = html_text.page_unit(html_text.page_tree(page))
    assert html_text.main_text(page, html_text.plan(unit, 1)) == TEXT


def test_quotes_count_after_an_equals_sign_alone():
    page = """<article><p it's title="a > b" data-x='<c>'>It isn't <a href=x">so</a>, is it?</p><p class="open>don't</p></article>"""
    assert html_text.main_text(page, {"path": ["+article"], "template": []}) == "It isn't so, is it? don't"


def test_templates_of_a_host_without_marks(spark):
    shell = "<html><body><div class=x1>Welcome to our site, read on</div><div class=x2><div>Sections: sport, news, weather and very much more of all that</div><div>{}</div></div><div class=x3>All rights reserved</div></body></html>"
    bodies = ["".join(f"<p>{prose(10 * k + j, 20)}</p>" for j in range(3)) for k in range(12)]
    rows = [(k, f"http://Plain.example/{k}", shell.format(b), "x", "y", 1) for k, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, b in enumerate(bodies):
        assert got[k] == " ".join(re.sub("</?p>", " ", b).split())
    wrappers = html_text.host_wrappers(spark.createDataFrame([("h", r[2]) for r in rows], "host string, html string").repartition(40)).collect()
    assert len(wrappers) == 1 and wrappers[0]["pages"] == len(rows)
    assert html_text.wrapper_text(wrappers[0]["wrapper"]) == "<><html><body><div.x1>text</div><div.x2>(<div>(text)?(<p>#</p>)+?</div>)+</div><div.x3>text</div></body></html></>"


def test_messy_pages(spark):
    rows = [
        (1, None, None, "a", "b", 1), (2, "", "", "a", "b", 1), (3, "http://h.example/", "  \n ", None, None, None), (None, "x", "<p>no host", "a", "b", 1),
        (4, "http://h.example/", "<" * 50 + "a <b <c \"", "a", "b", 1), (5, "http://h.example/", "<article>" + "<p>word " * 50_000, "a", "b", 1),
        (5, "http://h.example/", "<article>" + "<p>word " * 50_000, "a", "b", 1), (6, "http://h.example/", "<article></article><p>outside", "a", "b", 1),
        (7, "http://h.example/", "<script>never closed <article>x</article>", "a", "b", 1),
    ]
    got = html_text.extract_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()), key=lambda r: r[0])
    words = " ".join(["word"] * 50_000)
    assert [o[1] for o in out if o[0] not in (4,)] == ["no host", "", "", "", words, words, "outside", ""]
    assert all(n == len(t) for _, t, n in out)
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_against_a_plain_reading(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {}
    for r in pages.toPandas().itertuples():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())
    got = html_text.extract_text(pages).toPandas()
    pd.testing.assert_series_equal(got.set_index("page_id")["text"].sort_index(), pd.Series(want, name="text").rename_axis("page_id").sort_index(), check_dtype=False)
    assert (got["n_chars"] == got["text"].str.len()).all()
