"""Which messages say nothing new: rules on one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the token that says that all is well, and phrases that say nothing
OK = r"(?:\*\*)?HEARTBEAT_OK(?:\*\*)?[.!]?"
NO_ACTION = (r"\bno action needed\b", r"\bno alert needed\b", r"\bnothing to report\b", r"\bno (?:significant |notable )?change", r"\beverything (?:is |looks )?(?:fine|normal|good|ok)\b")
WINDOW_SECONDS = 24 * 3600


def judged(text: Column) -> Column:
    """struct(cleaned, reason) of a message by itself: empty, ok-token, no-action or none; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(trimmed, rf"(?i)^\s*{OK}\s*|\s*{OK}\s*$", ""), r"^\s+|\s+$", "")
    nothing = cleaned.rlike("(?i)" + "|".join(NO_ACTION))
    said = lambda clean, reason: F.struct(clean.alias("cleaned"), F.lit(reason).alias("reason"))
    none = F.lit("")
    return F.when(trimmed == "", said(none, "empty")).when(trimmed.rlike(rf"^{OK}\s*$") | (cleaned == ""), said(none, "ok-token")).when(nothing, said(cleaned, "no-action")).otherwise(said(cleaned, "none"))
