"""Mix sources to target weights by nested hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, BITS = 5, 12  # 60 hash bits in five histograms of 4096 buckets
SOURCES_TO_BROADCAST = 50_000  # rows of three numbers and a name: a few MB


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the key, or of the text where there is no key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Water-filled targets: source, source_size, target.

    ``sizes`` has one row per source. Sources in code-point order (null last) get the weights in
    turn; a target stops at ``most`` times the source's size and its excess goes to the others by
    weight. Filling the sources in the order in which they reach their cap gives the common level
    as the largest of the levels met, so no iteration is needed.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    capped = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(named)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    )
    filled = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(capped), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(capped), F.lit(0.0)))
        .withColumn("_level", F.max(F.col("_budget") / F.col("_left")).over(whole))
    )
    return filled.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken. A source is taken whole as often as its
    target allows; the rest of its target is filled with the documents whose hash lies below a
    threshold. Histograms of sizes by source and hash bucket find the bucket in which the budget
    ends; only that bucket is looked into again with the next twelve bits, so nothing is sorted and
    each pass after the first keeps one row in 4096.

    Null text counts no words and takes none; a null source is a source of its own, after all
    others; a row without an id is told by its text. Rows with one id, or without one and with one
    text, share a hash and go in or out together. Documents of no words, sources of no words and empty tables give zeros or no rows.
    Other columns are ignored.
    """
    sized = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col), F.col(text_col)).alias("_hash")),
        "mix-sized",
    )
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    small = targets.count() <= SOURCES_TO_BROADCAST
    hint = F.broadcast if small else (lambda df: df)

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = plan.select(F.col("source").alias("s_source"), "need", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        upper, lower = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        bucket = F.shiftright("_hash", lower)
        if level:
            counted = sized.join(hint(state), F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("_hash", upper) == F.col("prefix")))
            counted = counted.groupBy("s_source", "need", "before", bucket.alias("bucket")).agg(F.sum("size").alias("here"))
        else:
            counted = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("here"))
            counted = counted.join(hint(state), F.col("source").eqNullSafe(F.col("s_source")))
        up_to = Window.partitionBy("s_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        state = (
            counted.withColumn("reached", F.col("before") + F.sum("here").over(up_to))
            .filter(F.col("reached") > F.col("need"))
            .groupBy("s_source", "need")
            .agg(F.min("bucket").alias("prefix"), F.min_by(F.col("reached") - F.col("here"), "bucket").alias("before"), F.min_by("reached", "bucket").alias("reached"))
        )
        if level < LEVELS - 1:
            state = state.drop("reached")
    # the last bucket is one hash: it comes in when that brings the sum nearer to the target
    nearer = (F.col("reached") - F.col("need")) < (F.col("need") - F.col("before"))
    cut = state.select(F.col("s_source").alias("c_source"), F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))
    plan = plan.join(hint(cut), F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "epochs", F.coalesce("cut", F.lit(0).cast("long")).alias("cut")
    )
    taken = F.col("size") * (F.col("epochs") + (F.col("_hash") < F.col("cut")).cast("long"))
    return sized.join(hint(plan), F.col("source").eqNullSafe(F.col("p_source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) AS rk,
         CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0)) AS lv
  FROM ranked
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(lv) OVER () * w) AS target FROM levels),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
cum AS (
  SELECT s.doc_id, s.size, s.h, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS reached,
         sum(s.size) OVER (PARTITION BY s.source, s.h)::BIGINT AS here
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN reached <= need OR (reached - here <= need AND reached - need < need - (reached - here)) THEN 1 ELSE 0 END) AS taken
FROM cum
"""
