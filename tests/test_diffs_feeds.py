"""Line differences against difflib's counts and a rebuild; feeds against hand-written responses."""

import difflib
import random

import numpy as np
import pyarrow as pa

from quayline.operators import diffs
from quayline.sources import feeds


def rebuilt(rows):
    return "".join(r[3] for r in rows if r[0] != "+"), "".join(r[3] for r in rows if r[0] != "-")


def plain_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_and_rebuilding():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 40))] for _ in "xy")
        code = lambda s: np.array([ord(c) for c in s], np.int64)
        pairs = diffs.matched(code(a), code(b))
        assert len(pairs) == plain_length(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        old, new = "\n".join(a), "\n".join(b) + rng.choice(["", "\n"])
        assert rebuilt(diffs.changes(old, new)) == (old, new)
        kept = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(pairs) >= kept


def test_rendering(spark):
    old = "\n".join(f"line {k}" for k in range(1, 13))
    new = old.replace("line 6", "six").replace("line 12", "line 12\nmore")
    got = diffs.line_diffs(spark.createDataFrame([(1, old, new), (2, "a", "a"), (3, None, "x")], "id int, o string, n string"), "id", "o", "n", 2).orderBy("id").collect()
    assert (got[0]["removed"], got[0]["added"], got[0]["first_changed"]) == (2, 3, 6)
    assert got[0]["diff"].split("\n") == ["    ...", "  4 line 4", "  5 line 5", "- 6 line 6", "+ 6 six", *[f" {k:>2} line {k}" for k in range(7, 12)], "-12 line 12", "+12 line 12", "+13 more"]
    assert tuple(got[1])[1:] == (0, 0, None, "") and tuple(got[2])[1:] == (0, 1, 1, "+1 x")


def test_differences_come_in_lots(monkeypatch):
    monkeypatch.setattr(diffs, "LOT", 20)
    olds = ["a\nb\nc", None, "x" * 30, "", "one\ntwo"] * 3
    news = ["a\nc", "new", "x" * 30, None, "one\n2"] * 3
    batch = pa.RecordBatch.from_pydict({"k": list(range(15)), "old": olds, "new": news})
    lots = list(diffs._found(iter([batch, batch.slice(0, 0)]), 2))
    assert len(lots) == 6 and max(x.num_rows for x in lots) <= 4
    rows = [tuple(r.values()) for x in lots for r in x.to_pylist()]
    assert rows == [(k, *diffs.rendered(a or "", b or "", 2)) for k, (a, b) in enumerate(zip(olds, news))]


ITEM = "<item><title>{}</title><link>http://l/{}</link><pubDate>Mon, 5 Jan 2026 10:00:00 GMT</pubDate><description>{}</description></item>"


def test_three_feeds_become_one(spark, tmp_path):
    xml = "<?xml version='1.0'?><rss version='2.0'><channel><title>News</title>" + "".join(ITEM.format(f"A &amp;amp; B {k}", k, "&lt;b&gt;bold&lt;/b&gt; " + "x" * 300) for k in range(12)) + "</channel></rss>"
    one = "<rss><channel>" + ITEM.format("Only", 0, "") + "</channel></rss>"
    responses = spark.createDataFrame([("q", xml), ("r", one), ("s", "<rss><channel></channel></rss>"), ("t", "not xml <<"), ("u", None)], "feed string, body string")
    hits = '{"hits": {"hits": [{"_source": {"form_type": "10-K", "entity_name": "Acme", "file_date": "2026-01-06", "file_num": "7"}}, {"_source": {}}]}}'
    filings = spark.createDataFrame([("ACME", hits), ("X", "{broken")], "feed string, body string")
    news = feeds.rss_items(responses, "news")
    rows = news.orderBy("feed", "place").collect()
    assert [(r["feed"], r["place"]) for r in rows] == [("q", k) for k in range(10)] + [("r", 0)]
    assert rows[0]["title"] == "A & B 0" and rows[0]["summary"] == "bold " + "x" * 195 and rows[0]["url"] == "http://l/0"
    both = feeds.newest_first(news, feeds.rss_items(responses, "press", 8), feeds.filing_items(filings, "filings"))
    assert {r["source"]: r["n"] for r in both.groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"news": 11, "press": 9, "filings": 2}
    got = {r["title"]: r for r in both.filter("source = 'filings'").collect()}
    assert got["10-K — Acme"]["summary"] == "Form 10-K filed on 2026-01-06. File #7" and got["10-K — Acme"]["time"].day == 6
    assert got["Filing — ACME"]["time"] is None and rows[0]["date"].startswith("Mon, 5 Jan") and both.filter("source = 'news' AND time IS NULL").count() == 0
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(one)
    assert feeds.read_rss(spark, str(tmp_path)).count() == 13
