"""Queries of formats, dates, JSON shapes and text cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import numeric
from quayline.functions import text as tx
from quayline.functions.numeric import rounded
from quayline.operators import diffs, markup
from quayline.plans.registry import query
from quayline.storage import table


def _r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


def _scaled(x: str) -> str:
    parts = " ".join(f"WHEN abs({x}) >= {size} THEN printf('%.1f{mark}', {_r(f'{x} / {size}', 1)})" for size, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")))
    return f"CASE WHEN {x} IS NULL THEN '-' {parts} ELSE printf('%.1f', {_r(x, 1)}) END"


@query(
    f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice * power(10.0::DOUBLE, o_orderkey % 9 - 3) END AS v FROM orders)
SELECT o_orderkey, {_scaled('v')} AS scaled, coalesce(printf('%.1f%%', {_r('v / 1000', 1)}), '-') AS percent, coalesce('$' || printf('%.2f', {_r('v', 2)}), '-') AS price FROM x"""
)
def number_formats(spark, sf_dir):
    """Numbers with K, M, B and T, percents and prices; a dash for none."""
    v = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9 - 3))
    x = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    some = lambda c: F.when(F.col("v").isNull(), "-").otherwise(c)
    return x.select(
        "o_orderkey",
        numeric.scaled_number("v").alias("scaled"),
        some(F.format_string("%.1f%%", rounded(F.col("v") / 1000, 1))).alias("percent"),
        some(F.concat(F.lit("$"), F.format_string("%.2f", rounded("v", 2)))).alias("price"),
    )


@query(
    """WITH x AS (SELECT conv_id, sum(ceil(length(text) / 3.5)) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id), y AS (SELECT *, greatest(800, least(n * 0.8, 3000)) AS bound FROM x)
SELECT conv_id, CAST(n AS BIGINT) AS tokens, bound, n > bound AS compact, CASE WHEN n < 1000 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE printf('%.1fk', floor(n / 1000 * 10 + 0.5) / 10) END AS short,
  CASE WHEN n < 60 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) || 's' ELSE CAST(CAST(floor(n / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(n AS BIGINT) % 60 AS VARCHAR) || 's' END AS took FROM y"""
)
def context_thresholds(spark, sf_dir):
    """Whether a chat has to be compacted, and its size and time in short form."""
    x = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.sum(F.ceil(F.length("text") / 3.5)).alias("n"))
    bound = F.greatest(F.lit(800.0), F.least(F.col("n") * 0.8, F.lit(3000.0)))
    n = F.col("n")
    short = F.when(n < 1000, n.cast("string")).otherwise(F.format_string("%.1fk", rounded(n / 1000, 1)))
    took = F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(n / 60).cast("string"), F.lit("m "), (n % 60).cast("string"), F.lit("s")))
    return x.select("conv_id", n.alias("tokens"), bound.alias("bound"), (n > bound).alias("compact"), short.alias("short"), took.alias("took"))


@query(
    f"""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1),
c AS (SELECT day, (a - lag(a) OVER (ORDER BY day)) / lag(a) OVER (ORDER BY day) AS ra, (n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day) AS rn FROM d WHERE a IS NOT NULL AND n IS NOT NULL)
SELECT day, {_r('ra * 100', 2)} AS points_a, {_r('rn * 100', 2)} AS points_n, CASE WHEN {_r('ra * 100', 2)} - {_r('rn * 100', 2)} > 1 THEN 'risk-on' WHEN {_r('ra * 100', 2)} - {_r('rn * 100', 2)} < -1 THEN 'risk-off' ELSE 'neutral' END AS appetite FROM c WHERE ra IS NOT NULL AND rn IS NOT NULL"""
)
def risk_spread(spark, sf_dir):
    """Ratios as percent points, and what the spread of two sectors says. The window runs over one row a day."""
    sums = [F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f.lower()) for f in ("A", "N")]
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(*sums).dropna()
    before = Window.orderBy("day")
    points = lambda c: rounded((F.col(c) - F.lag(c).over(before)) / F.lag(c).over(before) * 100, 2)
    x = d.select("day", points("a").alias("points_a"), points("n").alias("points_n")).dropna()
    gap = F.col("points_a") - F.col("points_n")
    return x.withColumn("appetite", F.when(gap > 1, "risk-on").when(gap < -1, "risk-off").otherwise("neutral"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE CAST(floor((epoch(TIMESTAMP '1998-08-02 09:00:00') - epoch(o_orderdate)) / 86400.0 + 0.5) AS BIGINT) END AS days,
  try_cast(regexp_extract(CASE WHEN o_orderkey % 7 = 0 THEN '2024-13-45.md' ELSE strftime(o_orderdate, '%Y-%m-%d') || '.md' END, '^(\\d{4}-\\d{2}-\\d{2})\\.md$', 1) AS DATE) AS dated FROM orders"""
)
def days_and_files(spark, sf_dir):
    """Days between, rounded, -1 for what is no date; and the date in a file's name where the calendar has it."""
    o = F.col("o_orderdate").cast("timestamp")
    stamp = F.when(F.col("o_orderkey") % 13 != 0, F.unix_timestamp(o))
    days = F.coalesce(F.floor((F.unix_timestamp(F.lit("1998-08-02 09:00:00").cast("timestamp")) - stamp) / 86400.0 + 0.5), F.lit(-1).cast("long"))
    name = F.when(F.col("o_orderkey") % 7 == 0, "2024-13-45.md").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".md")))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days"), F.try_to_date(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})\.md$", 1), "yyyy-MM-dd").alias("dated"))


@query(
    """WITH e AS (SELECT event_id, ts, date_trunc('day', ts) + INTERVAL 1 HOUR * (event_id % 24) AS due FROM events)
SELECT event_id, CASE WHEN due > ts THEN due END AS next_at, CASE WHEN due > ts THEN due ELSE due + INTERVAL 1 DAY END AS next_daily,
  date_trunc('hour', ts) + INTERVAL 30 MINUTE + CASE WHEN minute(ts) >= 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS next_half FROM e"""
)
def next_runs(spark, sf_dir):
    """Next run of a job set for one time, for a time of every day, and for half past every hour."""
    ts = F.col("ts").cast("timestamp")
    at = F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), (F.col("event_id") % 24).cast("int"))
    half = F.date_trunc("hour", ts) + F.expr("INTERVAL 30 MINUTE") + F.when(F.minute(ts) >= 30, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    plain = lambda c: c.cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", plain(F.when(at > ts, at)).alias("next_at"), plain(F.when(at > ts, at).otherwise(at + F.expr("INTERVAL 1 DAY"))).alias("next_daily"), plain(half).alias("next_half"))


@query(
    """SELECT c_custkey, '{' || array_to_string(list_filter(['"name":"' || c_name || '"', CASE WHEN c_acctbal > 0 THEN '"balance":' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, CASE WHEN c_nationkey < 10 THEN '"nation":' || CAST(c_nationkey AS VARCHAR) END], lambda x: x IS NOT NULL), ',') || '}' AS kept FROM customer"""
)
def named_fields(spark, sf_dir):
    """Named fields of a record as JSON, nulls left out; a nested field is dropped on the way."""
    whole = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") < 10, F.col("c_nationkey")).alias("nation"), F.col("c_custkey").alias("secret"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(whole.dropFields("secret")).alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN value ELSE floor(value) END AS unwrapped FROM events")
def unwrapped_values(spark, sf_dir):
    """Numbers that come bare or inside {raw}."""
    bare = F.floor("value").cast("double").cast("string")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"raw":'), F.col("value").cast("string"), F.lit("}"))).otherwise(bare)
    x = table(spark, sf_dir, "events").withColumn("said", said)
    return x.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("said", "$.raw"), F.col("said")).cast("double").alias("unwrapped"))


@query(
    """WITH x AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END AS importance, date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-30') AS days FROM orders)
SELECT * FROM x WHERE importance >= 3 AND days BETWEEN 0 AND 30"""
)
def important_dates(spark, sf_dir):
    """Events of at least the third of five levels within thirty days."""
    level = F.coalesce(6 - F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(1))
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(level.between(2, 5), level).otherwise(1).alias("importance"), F.datediff(F.lit("1995-06-30").cast("date"), F.to_date("o_orderdate")).alias("days"))
    return x.filter("importance >= 3 AND days BETWEEN 0 AND 30")


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'is:') THEN text ELSE text || ' -is:repeat' END AS asked FROM conversations WHERE role = 'user' AND length(text) >= 20")
def augmented_queries(spark, sf_dir):
    """Queries with the default filter unless they name one; short ones go."""
    x = table(spark, sf_dir, "conversations").filter("role = 'user' AND length(text) >= 20")
    return x.select("conv_id", "turn", F.when(F.col("text").contains("is:"), F.col("text")).otherwise(F.concat("text", F.lit(" -is:repeat"))).alias("asked"))


@query(
    r"""WITH x AS (SELECT doc_id, '## Head' || chr(10) || '- *one* [link](http://a.b/c) ![pic](d.png)' || chr(10) || '```py' || chr(10) || 'snake_case = 1' || chr(10) || '```' || chr(10) || '2. `code`' || chr(10) || text AS m FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '```[^\n]*\n?', '', 'g'), '`([^`]+)`', '\1', 'g'), chr(10)) AS lines FROM x),
b AS (SELECT doc_id, array_to_string(list_transform(lines, lambda l: regexp_replace(regexp_replace(regexp_replace(l, '^#{1,6}\s+', ''), '^\s*[-*+]\s+', ''), '^\s*[0-9]+\.\s+', '')), chr(10)) AS t FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM b"""
)
def markdown_to_text(spark, sf_dir):
    """Whole texts under some Markdown, as plain text."""
    m = F.concat(F.lit("## Head\n- *one* [link](http://a.b/c) ![pic](d.png)\n```py\nsnake_case = 1\n```\n2. `code`\n"), "text")
    x = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", m.alias("m"))
    return markup.markdown_to_text(x, "m").select("doc_id", F.md5(F.col("plain").cast("binary")).alias("plain"))


@query("SELECT doc_id, md5(left(text, 500)) AS head, length(text) > 500 AS truncated FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark, sf_dir):
    """The first 500 characters of each text, and whether any are missing."""
    x = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return x.select("doc_id", F.md5(F.substring("text", 1, 500).cast("binary")).alias("head"), (F.length("text") > 500).alias("truncated"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')) AS plain FROM pages WHERE html IS NOT NULL""")
def feed_html(spark, sf_dir):
    """Feed summaries without tags, white space made single."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.md5(plain.cast("binary")).alias("plain"))


@query(
    r"""WITH x AS (SELECT c_custkey, '| name | balance |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || ' |' || chr(10) || '| x | ' || CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE '7' END || ' |' AS t FROM customer),
l AS (SELECT c_custkey, list_transform(string_split(t, chr(10))[3:], lambda r: list_transform(string_split(trim(r, '| '), '|'), lambda c: trim(c))) AS rows FROM x)
SELECT c_custkey, len(rows) AS n_rows, rows[1][1] AS first, len(list_filter(rows, lambda r: regexp_matches(r[2], '^-?[0-9][0-9,.]*%?$'))) * 2 > len(rows) AS numeric FROM l"""
)
def markdown_tables(spark, sf_dir):
    """Rows of Markdown tables; a column is numeric if more than half of its cells are numbers."""
    t = F.concat(F.lit("| name | balance |\n| --- | --- |\n| "), "c_name", F.lit(" | "), F.round("c_acctbal").cast("long").cast("string"), F.lit(" |\n| x | "), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise("7"), F.lit(" |"))
    x = table(spark, sf_dir, "customer").select("c_custkey", tx.table_cells(t).alias("rows"))
    numbers = F.size(F.filter("rows", lambda r: r[1].rlike("^-?[0-9][0-9,.]*%?$")))
    return x.select("c_custkey", F.size("rows").cast("long").alias("n_rows"), F.col("rows")[0][0].alias("first"), (numbers * 2 > F.size("rows")).alias("numeric"))


@query(r"""SELECT c_custkey, '+' || regexp_replace('(' || CAST(10 + c_nationkey AS VARCHAR) || ') ' || CAST(c_custkey * 7919 AS VARCHAR) || '-11', '[^0-9]', '', 'g') AS phone, regexp_replace('user' || CAST(c_custkey AS VARCHAR) || ':12@host.net', ':[0-9]+@.*$', '') AS handle, regexp_replace('**' || c_name || '** said', '\*\*([^*]+)\*\*', '*\1*', 'g') AS bold FROM customer""")
def handles(spark, sf_dir):
    """Phone numbers, device handles and bold marks in their plain forms."""
    phone = F.concat(F.lit("("), (10 + F.col("c_nationkey")).cast("string"), F.lit(") "), (F.col("c_custkey") * 7919).cast("string"), F.lit("-11"))
    handle = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit(":12@host.net"))
    bold = F.concat(F.lit("**"), "c_name", F.lit("** said"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("+"), F.regexp_replace(phone, "[^0-9]", "")).alias("phone"), F.regexp_replace(handle, ":[0-9]+@.*$", "").alias("handle"), F.regexp_replace(bold, r"\*\*([^*]+)\*\*", "*$1*").alias("bold"))


@query(r"""SELECT page_id, len(u) AS links, md5(array_to_string(u, ' ')) AS urls FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'https?://[^"''<> ]+'))) AS u FROM pages WHERE html IS NOT NULL)""")
def result_urls(spark, sf_dir):
    """Distinct links of each page."""
    u = F.sort_array(F.array_distinct(F.regexp_extract_all("html", F.lit("https?://[^\"'<> ]+"), F.lit(0))))
    x = table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", u.alias("u"))
    return x.select("page_id", F.size("u").cast("long").alias("links"), F.md5(F.array_join("u", " ").cast("binary")).alias("urls"))


@query(
    """SELECT doc_id, instr(replace(replace(replace(text, chr(8217), ''''), chr(8220), '"'), chr(8211), '-'), 'and') AS place, starts_with(text, chr(65279)) AS marked, contains(text, chr(13) || chr(10)) AS crlf FROM documents WHERE text IS NOT NULL"""
)
def fuzzy_find(spark, sf_dir):
    """Where a needle stands once quotes and dashes are folded; byte-order mark and line ends."""
    folded = F.translate("text", "’“–", "'\"-")
    x = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return x.select("doc_id", F.instr(folded, "and").cast("long").alias("place"), F.col("text").startswith("﻿").alias("marked"), F.col("text").contains("\r\n").alias("crlf"))


@query("SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2))) AS words FROM conversations WHERE text IS NOT NULL")
def long_word_sets(spark, sf_dir):
    """Distinct words of more than two characters of each turn."""
    x = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return x.select("conv_id", "turn", F.size(tx.long_words("text")).cast("long").alias("words"))


@query(
    """WITH m AS (SELECT r_regionkey, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey, array_to_string(list_transform(list_sort(list(struct_pack(k := n_name, v := n_nationkey * 2))), lambda e: e.k || '=' || CAST(e.v AS VARCHAR)), ',') AS doubled FROM m GROUP BY r_regionkey"""
)
def zipped_maps(spark, sf_dir):
    """Names zipped with numbers into a map whose values are transformed."""
    entries = F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")))
    x = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_arrays(entries["n_name"], entries["n_nationkey"]).alias("m"))
    doubled = F.transform_values("m", lambda _, v: v * 2)
    return x.select("r_regionkey", F.array_join(F.transform(F.map_entries(doubled), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("doubled"))


@query(
    """SELECT doc_id, CASE WHEN source = 'web' THEN exp(-ln(2) / 30 * age) WHEN doc_id % 3 = 0 THEN exp(-ln(2) / 30 * (doc_id % 365)) ELSE 1.0 END >= 0.5 AS fresh FROM (SELECT doc_id, source, n_chars % 90 AS age FROM documents)"""
)
def decay_by_kind(spark, sf_dir):
    """Whether half of a note's weight is left: some age by their update, some by their name's date, others never."""
    half = lambda days: F.exp(-F.log(F.lit(2.0)) / 30 * days)
    weight = F.when(F.col("source") == "web", half(F.col("n_chars") % 90)).when(F.col("doc_id") % 3 == 0, half(F.col("doc_id") % 365)).otherwise(1.0)
    return table(spark, sf_dir, "documents").select("doc_id", (weight >= 0.5).alias("fresh"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 3.5) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, k, n <= 120 AS held, CASE WHEN n <= 120 THEN n ELSE 0 END AS used FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, p.used + t.n <= 120, CASE WHEN p.used + t.n <= 120 THEN p.used + t.n ELSE p.used END FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)
SELECT conv_id, turn, held FROM p"""
)
def packed_context(spark, sf_dir):
    """Which notes fit a budget in a fixed order; one that doesn't is skipped, later ones may still fit. A chat's turns bound the fold."""
    note = F.struct("turn", F.ceil(F.length("text") / 3.5).alias("n"))
    x = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    kind = "struct<used:bigint,out:array<struct<turn:bigint,held:boolean>>>"

    def step(acc, note):
        fits = acc["used"] + note["n"] <= 120
        row = F.struct(note["turn"].cast("long").alias("turn"), fits.alias("held"))
        return F.struct(F.when(fits, acc["used"] + note["n"]).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<turn:bigint,held:boolean>>").alias("out")).cast(kind)
    packed = x.select("conv_id", F.explode(F.aggregate("notes", start, step, lambda a: a["out"])).alias("p"))
    return packed.select("conv_id", "p.turn", "p.held")


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(lines, lambda l, k: k % 3 = 0)) AS removed, 1 AS added FROM l"""
)
def line_diffs(spark, sf_dir):
    """Every text against itself without each third line and with one more: lines removed and added."""
    lines = F.split("text", "\n")
    fewer = F.filter(lines, lambda _, k: (k + 1) % 3 != 0)
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    pairs = docs.select("doc_id", F.concat("text", F.lit("\n")).alias("old"), F.concat(F.array_join(fewer, "\n"), F.lit("\n\u2603 one more\n")).alias("new"))
    return diffs.line_diffs(pairs, "doc_id", "old", "new").select("doc_id", F.col("removed").cast("long").alias("removed"), F.col("added").cast("long").alias("added"))
