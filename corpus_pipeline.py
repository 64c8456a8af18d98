"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, mix of sources.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns
the columns of documents; the last returns the words that the mix takes of each document. Clean
documents pass: toxic ones, copies and leaked ones go, secrets are replaced where they stand.
"""

from __future__ import annotations

from quayline.llm import decontam, mixing, near_dup, secrets, toxicity
from quayline.storage import materialise, table

ORACLE_SQL = None  # the stages learn and hash; tests compare run() with a brute-force version


def drop_toxic(spark, docs, sf_dir):
    """Documents predicted toxic go; the field is fitted on the labelled rows that remain."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """One document of each near-duplicate class stays."""
    return near_dup.keep_one(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark, docs, sf_dir):
    """Secrets are replaced by their kind; widely copied examples stay."""
    return secrets.redact_secrets(docs)


def mix(spark, docs, sf_dir):
    """Words taken of each document for the sources' target weights."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("mix", mix),
]


def run(spark, sf_dir):
    """All stages over documents, each one's result kept before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
