import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, value string"


def prose(seed: int, words: int) -> str:
    """Sentences of invented words, no two seeds alike."""
    rng = random.Random(seed)
    out = []
    for k in range(words):
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if k % 11 == 0 else w)
        if k % 11 == 10:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """documents with extra columns whose names operators also use."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, 7, 3, "x") for i, t, lang, src in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def messy(make):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows."""
    rows = [
        (1, prose(1, 120), "en", "a"),
        (1, prose(1, 120), "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, "one two", "en", "b"),
        (6, prose(6, 30_000), "en", "c"),
        (None, prose(7, 60), "en", "c"),
        (8, "word " * 5000, "en", "a"),
        (9, "x" * 20_000, "en", None),
    ]
    return make(rows)
