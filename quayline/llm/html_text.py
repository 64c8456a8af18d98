"""Main text of pages by wrappers: union-free expressions inferred from the pages of a host."""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.storage import materialise

WIDEST, LONGEST, DEEPEST, LARGEST, FAN = 6, 48, 100, 1500, 16
PLAN_BYTES = 32 << 20  # of all hosts' plans, up to which they are broadcast
HALF = 0.6  # of a region's text that one child must hold to be the region itself

# Fixed values of HTML
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}}
SKIPPED = set("head nav header footer aside form dialog menu select button object audio video canvas map fieldset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class and id that name what is not the article
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners sidebar aside menu menus nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup "
    "comment comments commentlist discussion disqus reply replies respond feedback share sharing sharebar social related recommended recommendations widget widgets toolbar pagination "
    "pager login search skip hidden disclaimer".split()
)

# quotes count after an equals sign alone
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+\d{0,2}(?!\d)|[A-Z]?[a-z]+|[A-Z]+")  # a number of its own counts pages, not kinds


class Element:
    """A block of a page: its key (sign, name, words of class and id) and what it holds, texts and elements."""

    __slots__ = ("name", "key", "kids")

    def __init__(self, name: str, key: str):
        self.name, self.key, self.kids = name, key, []


@lru_cache(1 << 14)
def _key(name: str, attributes: str) -> str:
    """A sign, the name and its words: ``-`` is never the article, ``+`` is marked as article, ``*`` as main, a space is neither."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    words = [w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")]
    role = found.get("role", "").lower()
    named = name in SKIPPED or role in ROLES or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if name == "article":  # of the words, only those of comments make it another thing
        named = named or any(w.startswith(("comment", "repl")) for w in words)
    elif name not in ("html", "body", "main"):
        named = named or not WORDS.isdisjoint(w.rstrip("0123456789") for w in words)
    sign = "-" if named else "+" if "article" in (name, role) else "*" if "main" in (name, role) else " "
    return ".".join([sign + name, *words[:3]])


def _after_raw(page: str, at: int, name: str) -> int:
    """Where what a raw element holds has ended."""
    end = re.compile(rf"</{name}(?![\w-])[^>]*>?", re.I).search(page, at)
    return end.end() if end else len(page)


def page_tree(page: str | None) -> Element:
    """A page's blocks. Inline marks, comments and what raw elements hold are no part of it; what is never closed ends with its parent."""
    top = Element("", " ")
    stack, at, page = [top], 0, page or ""
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        close, name, attributes = m.groups()
        kids = stack[-1].kids
        if name is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                if "&" in token:
                    token = html.unescape(token)
                if kids and isinstance(kids[-1], str):
                    kids[-1] += token
                else:
                    kids.append(token)
            continue
        name = name.lower()
        if close:
            if name not in INLINE or any(el.name == name for el in stack):
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
                if depth:
                    del stack[depth:]
        elif name in RAW:
            at = at if attributes.endswith("/") else _after_raw(page, at, name)
        elif name in VOID:
            if name in ("br", "hr", "img"):
                kids.append(" ")
        else:
            key = _key(name, attributes)
            if name in INLINE and key[0] != "-":
                continue
            if name == "body":
                del stack[2 if len(stack) > 1 and stack[1].name == "html" else 1 :]
            while stack[-1].name in CLOSED_BY.get(name, ()) or (stack[-1].name == "p" and name not in INLINE):
                stack.pop()
            if len(stack) < DEEPEST:
                stack[-1].kids.append(made := Element(name, key))
                stack.append(made)
            else:  # deeper blocks are part of their parent
                stack[-1].kids.append(" ")
    return top


def _text(el: Element, template: set[str], out: list[str]) -> None:
    for kid in el.kids:
        if isinstance(kid, str):
            if not template or _digest(" ".join(kid.split())) not in template:
                out.append(kid)
        else:
            out.append(" ")
            if kid.key[0] != "-":
                _text(kid, template, out)
                out.append(" ")


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Unit:
    """A part of an expression: a text slot (key ``#``), an element, or a group ``()`` of units; optional or repeated.

    ``chars`` is the text of a slot over all pages, ``fixed`` its digest while it is the same
    everywhere; ``pages`` counts the pages of an element.
    """

    __slots__ = ("key", "opt", "rep", "chars", "fixed", "pages", "items")

    def __init__(self, key: str, opt: bool = False, rep: bool = False, chars: int = 0, fixed: str = "", pages: int = 1, items: Iterable = ()):
        self.key, self.opt, self.rep, self.chars, self.fixed, self.pages, self.items = key, opt, rep, chars, fixed, pages, list(items)

    def dump(self) -> list:
        return [self.key, self.opt, self.rep, self.chars, self.fixed, self.pages, [u.dump() for u in self.items]]

    @staticmethod
    def load(row: list) -> Unit:
        return Unit(*row[:6], [Unit.load(x) for x in row[6]])

    def __str__(self) -> str:
        inner = "".join(map(str, self.items))
        out = ("text" if self.fixed else "#") if self.key == "#" else inner if self.key == "()" else f"<{self.key[1:]}>{inner}</{self.key[1:].split('.')[0]}>"
        return f"({out}){'+' if self.rep else ''}{'?' if self.opt else ''}" if self.opt or self.rep else out


def page_unit(el: Element) -> Unit:
    """A page's own expression: neighbours that repeat are folded."""
    items = []
    for kid in el.kids:
        if isinstance(kid, str):
            if text := " ".join(kid.split()):
                items.append(Unit("#", chars=len(text), fixed=_digest(text)))
        else:
            items.append(page_unit(kid))
    return Unit(el.key, items=fold(items))


def merge(a: Unit, b: Unit, again: bool = False) -> Unit:
    """What accepts both; ``again``: b is a repetition on the same page."""
    fixed = a.fixed if a.fixed == b.fixed else ""
    return Unit(a.key, a.opt or b.opt, a.rep or b.rep or again, a.chars + b.chars, fixed, a.pages if again else a.pages + b.pages, align(a.items, b.items))


def align(a: list[Unit], b: list[Unit]) -> list[Unit]:
    """Units of two token streams side by side: what is in both is merged, a mismatch is optional; then repetitions are folded."""
    ka, kb = [u.key for u in a], [u.key for u in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    out = []
    for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merge(x, y) for x, y in zip(a[a0:a1], b[b0:b1])]
        else:
            for u in a[a0:a1] + b[b0:b1]:
                u.opt = True
                out.append(u)
    return fold(out)


def fold(units: list[Unit]) -> list[Unit]:
    """Neighbours of one key, then squares of up to WIDEST units, become repetitions; a list that stays long becomes one repeated group of optional units."""
    out: list[Unit] = []
    keys = lambda us: [u.key for u in us]
    for u in units:
        if out and out[-1].key == u.key and u.key != "()":
            out[-1] = merge(out[-1], u, again=True)
            continue
        out.append(u)
        for w in range(2, WIDEST + 1):
            tail = out[-w:]
            if len(out) > w and out[-w - 1].key == "()" and keys(out[-w - 1].items) == keys(tail):
                out[-w - 1 :] = [merge(out[-w - 1], Unit("()", rep=True, items=tail), again=True)]
                break
            if len(out) >= 2 * w and keys(out[-2 * w : -w]) == keys(tail):
                out[-2 * w :] = [merge(Unit("()", rep=True, items=out[-2 * w : -w]), Unit("()", items=tail), again=True)]
                break
    if len(out) <= LONGEST:
        return out
    kinds: dict[str, Unit] = {}
    for u in [x for u in out for x in (u.items if u.key == "()" else [u])]:
        kinds[u.key] = merge(kinds[u.key], u, again=True) if u.key in kinds else u
        kinds[u.key].opt = True
    most = sorted(kinds.values(), key=lambda u: -_chars(u))  # of kinds without end, the smallest lose their shape, not their text
    rest = sum(_chars(u) for u in most[LONGEST:])
    kept = [u for u in kinds.values() if u in most[:LONGEST]] + ([Unit("#", opt=True, chars=rest)] if rest else [])
    return [Unit("()", rep=True, items=kept)]


def _chars(u: Unit, seen=lambda u: True) -> int:
    """Text of a unit and what it holds, without what is never the article."""
    return 0 if u.key[0] == "-" else (u.chars if seen(u) else 0) + sum(_chars(x, seen) for x in u.items)


def bounded(u: Unit) -> Unit:
    """The expression without its deepest levels while it has more than LARGEST units; their text is counted at the level above."""
    size = lambda u: 1 + sum(map(size, u.items))

    def cut(u: Unit, depth: int) -> None:
        if depth == 0 and u.items:
            u.items = [Unit("#", chars=_chars(u) - u.chars)]
        for x in u.items:
            cut(x, depth - 1)

    depth = DEEPEST
    while size(u) > LARGEST and depth > 1:
        depth -= 1
        cut(u, depth)
    return u


def _blocks(u: Unit, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Unit]]:
    """Elements with their paths; groups are no part of a path."""
    for x in u.items:
        if x.key == "()":
            yield from _blocks(x, path)
        elif x.key != "#":
            yield (*path, x.key), x
            yield from _blocks(x, (*path, x.key))


def plan(wrapper: Unit, pages: int) -> dict:
    """Where the article lies (path) and which texts are the template's (digests).

    What is marked as article comes first, then what is marked as main, each with the most text;
    else one goes down from the top while a single child holds HALF of the text that changes from
    page to page. Only in the last case are texts that never change the template's: an article
    that all pages share is not.
    """
    blocks = list(_blocks(wrapper))
    for free in (True, False):
        for sign in "+*":
            marked = [(_chars(u), path) for path, u in blocks if u.key[0] == sign and (not free or all(k[0] != "-" for k in path))]
            if marked and max(marked)[0]:
                return {"path": max(marked, key=lambda x: (x[0], -len(x[1])))[1], "template": []}
    changes = lambda u: u.key == "#" and not u.fixed
    varied = pages > 2 and _chars(wrapper, changes) > 0
    seen = changes if varied else lambda u: True
    path, u = (), wrapper
    while inner := [(_chars(x, seen), -k, p, x) for k, (p, x) in enumerate(_blocks(u, path)) if len(p) == len(path) + 1]:
        best = max(inner, key=lambda i: i[:2])
        if best[0] < HALF * _chars(u, seen) or not best[0] or not any(True for _ in _blocks(best[3])):
            break
        path, u = best[2], best[3]
    slots = lambda u: [x for x in u.items if x.key == "#"] + [y for x in u.items if x.key != "#" and x.key[0] != "-" for y in slots(x)]
    return {"path": path, "template": sorted({x.fixed for x in slots(u) if x.fixed}) if varied else []}


def main_text(page: str | None, of_host: dict) -> str:
    """The text that a host's plan finds on a page; where it finds none, the page's own plan."""
    tree = page_tree(page)

    def found(plan: dict) -> str:
        level = [tree]
        for key in plan["path"]:
            level = [k for el in level for k in el.kids if not isinstance(k, str) and k.key == key]
        out: list[str] = []
        for el in level:
            _text(el, set(plan["template"]), out)
            out.append(" ")
        return " ".join("".join(out).split())

    return found(of_host) or found(plan(page_unit(tree), 1))


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper a host from a task's pages."""
    known: dict[str, Unit] = {}
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"]):
            unit = page_unit(page_tree(page))
            known[host] = bounded(merge(known[host], unit)) if host in known else bounded(unit)
    yield pd.DataFrame([(h, u.pages, json.dumps(u.dump())) for h, u in known.items()], columns=["host", "pages", "wrapper"])


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper from a few of one host."""
    rows = rows.sort_values("part")
    units = [Unit.load(json.loads(w)) for w in rows["wrapper"]]
    out = units[0]
    for u in units[1:]:
        out = bounded(merge(out, u))
    return rows.iloc[:1].assign(pages=out.pages, wrapper=json.dumps(out.dump()), part=rows["part"].iloc[0] // FAN)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of every host over all its pages (columns host, html): host, pages, wrapper (JSON).

    Every task folds its pages into one bounded wrapper a host; FAN of them at a time are merged,
    so no task ever holds a host.
    """
    kind = "host string, pages long, wrapper string"
    each = pages.select("host", "html").mapInPandas(_infer, kind).withColumn("part", F.spark_partition_id().cast("long"))
    each = materialise(each, "html-wrappers")
    most = each.agg(F.max("part")).first()[0] or 0
    while True:
        each = each.groupBy("host", F.floor(F.col("part") / FAN).alias("_to")).applyInPandas(lambda rows: _merged(rows.drop(columns="_to", errors="ignore")), f"{kind}, part long")
        most //= FAN
        if not most:
            return each.drop("part")


def wrapper_text(wrapper: str) -> str:
    """A wrapper as a regular expression over tags and texts, to read."""
    return str(Unit.load(json.loads(wrapper)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Pages of one host are token streams of one template: aligned one after another they give an
    expression without alternatives, in which mismatches are optional, repeated or text slots. It
    tells where the host's article lies; the page's text is what stands there, without marked
    menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles.
    Character references are decoded once; any white space is one space.

    Nulls and empty pages give an empty text; pages without a host form one group; a page on which
    the host's region is missing or empty is read by its own expression. Repeated rows each come
    out; broken marks end with their parent; blocks nested below DEEPEST count to their parent. No
    pages, no rows. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))

    planned = lambda wrapper, n: json.dumps(plan(Unit.load(json.loads(wrapper)), n))
    to_plan = F.pandas_udf(lambda w, n: pd.Series([planned(*x) for x in zip(w, n)], dtype=object), "string")
    plans = materialise(host_wrappers(rows).select(F.col("host").alias("_host"), to_plan("wrapper", "pages").alias("plan")), "html-plans")
    size = plans.agg(F.sum(F.length("plan") + F.length("_host") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(plans) if size <= PLAN_BYTES else plans, F.col("host") == F.col("_host"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(4096)(json.loads)
        for batch in batches:
            texts = [main_text(page, known(p)) for page, p in zip(batch["html"], batch["plan"])]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    ids = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "plan").mapInPandas(read, f"page_id {ids}, url string, text string, n_chars long")
