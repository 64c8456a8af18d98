"""HTML and Markdown to text, match by match in the JVM: what a pattern splits and what it finds are put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: white space, entities in the order in which they are resolved, and the patterns of what is rewritten
SPACE = r"\t\n\x0B\f\r    -     　﻿"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
DROPPED = r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<noscript[\s\S]*?</noscript>"
LINK = r"""(?i)<a\s+[^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
HEADING = r"(?i)<h([1-6])[^>]*>([\s\S]*?)</h\1>"
ITEM = r"(?i)<li[^>]*>([\s\S]*?)</li>"
BREAK = r"(?i)<(?:br|hr)\s*/?>|</(?:p|div|section|article|header|footer|table|tr|ul|ol)>"
PICTURE, TARGET, FENCE, FENCE_MARK, CODE = r"!\[[^\]]*\]\([^)]+\)", r"\[([^\]]+)\]\([^)]+\)", r"```[\s\S]*?```", r"```[^\n]*\n?|```", r"`([^`]+)`"


def rewrite(text: Column, pattern: str, groups: int, put: Callable[..., Column]) -> Column:
    """text with every match of the pattern replaced by ``put`` of its groups (the whole match, if there are none)."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
    gaps = F.split(text, pattern, -1)
    parts = F.transform(found[0], lambda first, i: F.concat(put(first, *[g[i] for g in found[1:]]), gaps[i + 1]))
    return F.when(F.size(found[0]) > 0, F.concat(gaps[0], F.array_join(parts, ""))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def even_spaces(text: Column) -> Column:
    """Single spaces, at most one empty line, nothing at the ends."""
    for pattern, put in ((r"\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, put)
    return trimmed(text)


def _unit(code: Column) -> Column:
    """The character of a code unit, given as four hexadecimal digits."""
    return F.decode(F.unhex(code), "UTF-16BE")


def entities(text: Column) -> Column:
    """Named entities, then hexadecimal and decimal ones, of which the last 16 bits count."""
    for name, put in ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", put)
    hexed = rewrite(text, "(?i)&#x([0-9a-f]+);", 1, lambda h: _unit(F.lpad(F.right(h, F.lit(4)), 4, "0")))
    low = lambda d: F.coalesce(d.try_cast("decimal(38,0)"), F.lit(0)) % 65536
    return F.when(text.contains("&#"), rewrite(hexed, r"&#(\d+);", 1, lambda d: _unit(F.lpad(F.hex(low(d).cast("long")), 4, "0")))).otherwise(text)


def bare(text: Column) -> Column:
    """Without tags, entities resolved."""
    return entities(F.regexp_replace(text, "<[^>]+>", ""))


def html_to_markdown(pages: DataFrame, html_col: str, text_col: str = "markdown", title_col: str = "title") -> DataFrame:
    """pages with their Markdown and title (null without one): links, headings, items and breaks marked, the rest as text.

    Labels of links, headings and items are cleaned each for itself; a link without a label is its
    address, an item without text is nothing. Steps are columns of their own, so none is evaluated
    more than once.
    """
    x, t = F.col(html_col), F.col("_t")
    label = lambda body: even_spaces(bare(body))
    steps = (
        F.regexp_replace(x, DROPPED, ""),
        rewrite(t, LINK, 2, lambda href, body: F.when(label(body) == "", href).otherwise(F.concat(F.lit("["), label(body), F.lit("]("), href, F.lit(")")))),
        rewrite(t, HEADING, 2, lambda level, body: F.concat(F.lit("\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), label(body), F.lit("\n"))),
        rewrite(t, ITEM, 1, lambda body: F.when(label(body) == "", F.lit("")).otherwise(F.concat(F.lit("\n- "), label(body)))),
        F.regexp_replace(t, BREAK, "\n"),
        F.regexp_replace(t, "<[^>]+>", ""),
        entities(t),
        even_spaces(t),
    )
    out = pages
    for step in steps:
        out = out.withColumn("_t", step)
    titled = F.when(x.rlike(TITLE), even_spaces(bare(F.regexp_extract(x, TITLE, 1))))
    return out.withColumn(title_col, titled).withColumnRenamed("_t", text_col)


def markdown_to_text(texts: DataFrame, text_col: str, out_col: str = "plain") -> DataFrame:
    """texts with their Markdown as plain text: no pictures, link targets, fences, code, heading or list marks."""
    t = F.col("_t")
    steps = (
        F.regexp_replace(F.regexp_replace(F.col(text_col), PICTURE, ""), TARGET, "$1"),
        rewrite(t, FENCE, 0, lambda block: F.regexp_replace(block, FENCE_MARK, "")),
        F.regexp_replace(t, CODE, "$1"),
        F.regexp_replace(t, rf"(?m)^#{{1,6}}[{SPACE}]+", ""),
        F.regexp_replace(t, rf"(?m)^[{SPACE}]*[-*+][{SPACE}]+", ""),
        F.regexp_replace(t, rf"(?m)^[{SPACE}]*[0-9]+\.[{SPACE}]+", ""),
        even_spaces(t),
    )
    out = texts
    for step in steps:
        out = out.withColumn("_t", step)
    return out.withColumnRenamed("_t", out_col)
