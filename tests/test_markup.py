"""HTML, Markdown and paragraphs against cases by hand and plain Python."""

import re

import pytest

from quayline.operators import markup, retrieval
from quayline.storage import table


def plain(page):
    """The same steps on one page with the standard library."""
    entity = {"nbsp": " ", "amp": "&", "quot": '"', "#39": "'", "lt": "<", "gt": ">"}

    def even(t):
        t = re.sub("[ \t]+\n", "\n", t.replace("\r", ""))
        return re.sub("[ \t]{2,}", " ", re.sub("\n{3,}", "\n\n", t)).strip()

    def bare(t):
        t = re.sub("<[^>]+>", "", t)
        for name, put in entity.items():
            t = re.sub(f"&{name};", put, t, flags=re.I)
        t = re.sub("&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16) % 65536), t, flags=re.I)
        return re.sub(r"&#(\d+);", lambda m: chr(int(m[1]) % 65536), t)

    for name in ("script", "style", "noscript"):
        page = re.sub(f"<{name}.*?</{name}>", "", page, flags=re.I | re.S)
    clean = lambda t: even(bare(t))
    page = re.sub(r"""<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", lambda m: f"[{clean(m[2])}]({m[1]})" if clean(m[2]) else m[1], page, flags=re.I | re.S)
    page = re.sub(r"<h([1-6])[^>]*>(.*?)</h\1>", lambda m: f"\n{'#' * int(m[1])} {clean(m[2])}\n", page, flags=re.I | re.S)
    page = re.sub("<li[^>]*>(.*?)</li>", lambda m: f"\n- {clean(m[1])}" if clean(m[1]) else "", page, flags=re.I | re.S)
    page = re.sub(r"<(?:br|hr)\s*/?>|</(?:p|div|section|article|header|footer|table|tr|ul|ol)>", "\n", page, flags=re.I)
    return clean(page)


CASES = [
    ("<h1>Head</h1><p>One <a href='u'>link</a> &amp; more</p><ul><li>item</li></ul>", "# Head\nOne [link](u) & more\n\n- item"),
    ("It&#8217;s &#x41; &AMP; &Nbsp;b &#39;q&#39; &lt;i&gt;", "It’s A & b 'q' <i>"),
    ("a<hr>b<BR/>c</header>d", "a\nb\nc\nd"),
    ("<a href=\"http://x/\"><img src=i></a> <a class=k href='v'> t\n\n\n\nu </a>", "http://x/ [t\n\nu](v)"),
    ("<li> </li><li><b>x</b> &#9731;</li>", "- x ☃"),
    ("\n\n  <p>x</p>　\n", "x"),
    ("<h2 class=a>A <i>b</i></h2><h3>B</h2></h3>", "## A b\n\n### B"),
    ("&amp;#65; &amp;lt;", "A <"),
    ("", ""),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(spark, page, want):
    got = markup.html_to_markdown(spark.createDataFrame([(page,)], "h string"), "h").first()
    assert got["markdown"] == want == plain(page) and got["title"] is None


def test_titles_and_nulls(spark):
    rows = [("<TITLE a=b> A &amp;\n B </TITLE><script>no</script><style>no</style>x",), (None,)]
    got = markup.html_to_markdown(spark.createDataFrame(rows, "h string"), "h").collect()
    assert [(r["title"], r["markdown"]) for r in got] == [("A &\n B", "A &\n B x"), (None, None)]


def test_given_pages_equal_plain_python(spark):
    got = markup.html_to_markdown(table(spark, "/root/testdata/sf0.01", "pages"), "html").select("html", "markdown").collect()
    assert len(got) == 250
    for r in got:
        assert r["markdown"] == plain(r["html"])


def test_markdown_keeps_names_and_drops_marks(spark):
    md = "# Title\n\n![pic](a.png) see [the docs](http://d) and `code_x`\n```python\nsnake_case = a * b\n```\n- one\n* two\n 3. three\n\n\n\n#hash *kept*  _kept_"
    want = "Title\n\n see the docs and code_x\nsnake_case = a * b\none\ntwo\nthree\n\n#hash *kept* _kept_"
    assert markup.markdown_to_text(spark.createDataFrame([(md,)], "m string"), "m").first()["plain"] == want


def test_lines_of_tabs_part_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a\n\t\nb\n  \n\n c \nd\t\n")], "id int, text string")
    got = [(r["start_line"], r["end_line"], r["content"]) for r in retrieval.paragraphs(docs, "id", "text").orderBy("start_line").collect()]
    assert got == [(1, 1, "a"), (3, 3, "b"), (6, 7, "c \nd")]
    assert [(r["start_line"], r["end_line"]) for r in retrieval.chunks(docs, "id", "text", tokens=1, overlap=0).orderBy("chunk").collect()] == [(1, 1), (3, 3), (6, 7)]
