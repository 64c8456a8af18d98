"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.storage import materialise


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, pattern, group whose length counts, least length; the last kind is the corpus-decided one.
_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = (
    ("assign", "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("generic", "[A-Za-z0-9+/_-]{20,}", 0, 20),
)
COPIED_OWNERS = 3  # a value held by so many owners is an example that people copy
SPAN = "array<struct<start:int,kind_no:int,end:int,value:string>>"


def _spans(text: str, kind_no: int) -> Column:
    """Spans of one kind: what splits the text, and the gaps between, add up to positions."""
    _, _, group, least = KINDS[kind_no]
    m, g, gaps = (F.col(f"_{x}{kind_no}") for x in ("m", "g", "p"))
    step = lambda a, i: F.struct(
        (a["pos"] + F.length(gaps[i]) + F.length(m[i])).cast("int").alias("pos"),
        F.when(
            F.length(g[i]) >= least,
            F.concat(
                a["out"],
                F.array(F.struct((a["pos"] + F.length(gaps[i])).cast("int").alias("start"), F.lit(kind_no).alias("kind_no"), (a["pos"] + F.length(gaps[i]) + F.length(m[i])).cast("int").alias("end"), g[i].alias("value"))),
            ),
        )
        .otherwise(a["out"])
        .alias("out"),
    )
    none = F.array().cast(SPAN)
    folded = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(m) > 0, folded).otherwise(none)


def _label(span: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(":", names[span["kind_no"]], span["start"].cast("string"), span["end"].cast("string"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), _label), ",")


def scan_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _base (found spans) and _generic (mixed long tokens outside them); values as SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs
    for no, (_, pattern, group, _) in enumerate(KINDS):
        df = df.withColumn(f"_m{no}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        df = df.withColumn(f"_g{no}", F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col(f"_m{no}"))
        df = df.withColumn(f"_p{no}", F.when(F.size(f"_m{no}") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_base", F.concat(*[_spans(text_col, no) for no in range(3)])).withColumn("_generic", _spans(text_col, 3))
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_generic", F.filter("_generic", lambda s: mixed(s) & apart(s)))
    # from here on values are their digests: no secret is written anywhere
    hidden = lambda s: s.withField("value", F.sha2(s["value"], 256))
    df = df.withColumn("_base", F.transform("_base", hidden)).withColumn("_generic", F.transform("_generic", hidden))
    return df.drop(*[f"_{x}{no}" for no in range(len(KINDS)) for x in "mgp"])


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value's hash: _value, owners, repos.

    One row per (value, owner, repository) first, so a value that a third of all rows hold is
    already summed before its rows meet.
    """
    each = found.groupBy("_value", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    owner = each.groupBy("_value", "_owner").agg(F.count(F.lit(1)).alias("repos"))
    return owner.groupBy("_value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def _decided(docs: DataFrame, owner_col: str, repo_cols: Sequence[str], text_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The kept scan (with _row), and per row its spans with owner counts."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    scanned = scan_candidates(docs.withColumns({"_owner": owner, "_repo": repo}), text_col)
    kept = materialise(scanned.select(*keep, "_owner", "_repo", "_base", "_generic", F.monotonically_increasing_id().alias("_row")), "secrets-scan")
    found = kept.select("_row", "_owner", "_repo", F.explode(F.concat("_base", "_generic")).alias("_span"))
    found = found.withColumn("_value", F.col("_span.value"))
    known = found.join(ownership(found), "_value").groupBy("_row").agg(F.collect_list(F.struct("_span", "owners", "repos")).alias("_known"))
    return kept, known


def scan_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: Sequence[str] = ("source", "lang"), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with all its secret spans.

    Base kinds (assign, access, hex) are always reported. A long mixed token outside them is a
    candidate; its value's hash is counted over the corpus by distinct owners and repositories, and
    it is added as kind ``generic`` only when a single owner holds it (live-looking). n_live counts
    the spans whose value one owner holds, n_copied those that COPIED_OWNERS or more hold.

    Null and empty texts have no spans; null owners and languages count as the empty name; repeated
    rows are scanned each for itself but are one owner; empty tables give no rows. Positions are
    code points, end exclusive. Other columns are ignored.
    """
    kept, known = _decided(docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col), *[c for c in dict.fromkeys(repo_cols) if c != owner_col], F.col(text_col)), owner_col, repo_cols, text_col, ["doc_id"])
    joined = kept.join(known, "_row", "left").withColumn("_known", F.coalesce("_known", F.array().cast(known.schema["_known"].dataType)))
    count = lambda test: F.size(F.filter("_known", test)).cast("long")
    live = F.transform(F.filter("_known", lambda k: (k["_span"]["kind_no"] == 3) & (k["owners"] == 1)), lambda k: k["_span"])
    of_kind = lambda no: F.size(F.filter("_base", lambda s: s["kind_no"] == no)).cast("long")
    return joined.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", live)).alias("spans"),
        count(lambda k: k["owners"] == 1).alias("n_live"),
        count(lambda k: k["owners"] >= COPIED_OWNERS).alias("n_copied"),
    )


def redact_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: Sequence[str] = ("source", "lang"), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced by ``[kind]``, but for widely copied examples.

    Overlapping spans are replaced as one; ``length_col`` is set anew where the text changed. Rows
    without candidates pass through without a shuffle. Nulls and empty texts stay as they are.
    """
    # the row travels as one struct, so no column name of the input can clash
    packed = docs.select(F.struct(*docs.columns).alias("_doc"))
    text = F.col(f"_doc.{text_col}")
    kept, known = _decided(packed, f"_doc.{owner_col}", [f"_doc.{c}" for c in repo_cols], f"_doc.{text_col}", ["_doc"])
    quiet = kept.filter((F.size("_base") == 0) & (F.size("_generic") == 0)).select("_doc.*")
    loud = kept.filter((F.size("_base") > 0) | (F.size("_generic") > 0)).join(known, "_row")
    secret = lambda k: (k["owners"] < COPIED_OWNERS) & ((k["_span"]["kind_no"] < 3) | (k["owners"] == 1))
    spans = F.array_sort(F.transform(F.filter("_known", secret), lambda k: k["_span"]))
    kinds = F.array(*[F.lit(f"[{k[0]}]") for k in KINDS])
    step = lambda a, s: F.when(
        s["start"] >= a["pos"],
        F.struct(F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), kinds[s["kind_no"]]).alias("out"), s["end"].alias("pos")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["pos"], s["end"]).alias("pos")))
    rest = lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text)))
    loud = loud.withColumn("_spans", spans).withColumn("_text", F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step, rest))
    doc = F.col("_doc").withField(text_col, F.col("_text"))
    if length_col and length_col in docs.columns:
        length = F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"_doc.{length_col}"))
        doc = doc.withField(length_col, length)
    return quiet.unionByName(loud.select(doc.alias("_doc")).select("_doc.*"))


def _oracle() -> str:
    quoted = [k[1].replace("'", "''") for k in KINDS]
    parts = []
    for no, (kind, _, group, least) in enumerate(KINDS):
        parts.append(f"""
  SELECT doc_id, source, lang, {no} AS kind_no, i, g[i] AS value, len(m[i]) AS n, len(g[i]) >= {least} AS ok,
         list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, source, lang, regexp_extract_all(text, '{quoted[no]}', 0) AS m, regexp_extract_all(text, '{quoted[no]}', {group}) AS g,
           string_split_regex(text, '{quoted[no]}') AS p FROM documents WHERE regexp_matches(text, '{quoted[no]}')))""")
    names = "['assign','access','hex','generic']"
    return f"""
WITH raw AS ({" UNION ALL ".join(parts)}),
hits AS (SELECT doc_id, coalesce(source, '') AS o, coalesce(source, '') || '/' || coalesce(lang, '') AS r, kind_no, value, s::BIGINT AS s, (s + n)::BIGINT AS e FROM raw WHERE ok),
cands AS (
  SELECT * FROM hits h WHERE kind_no < 3 OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = h.doc_id AND b.kind_no < 3 AND b.s < h.e AND h.s < b.e))),
owned AS (SELECT value, count(DISTINCT o) AS owners FROM cands GROUP BY value),
known AS (SELECT c.*, w.owners, {names}[kind_no + 1] || ':' || s || ':' || e AS label FROM cands c JOIN owned w USING (value)),
per AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(label, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(label, ',' ORDER BY s, kind_no) FILTER (kind_no < 3 OR owners = 1) AS spans,
         count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= {COPIED_OWNERS}) AS n_copied
  FROM known GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN per USING (doc_id)
"""


ORACLE_SQL = _oracle()
