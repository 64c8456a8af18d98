"""Cross-section: screening, ranking, first-wins de-duplication and score ladders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def screen(df: DataFrame, filters: Sequence[tuple[str, str, object]], limit: int = 10) -> DataFrame:
    """Rows that meet every (field, operator, value); strings compare without case; at most ten rows."""

    def test(field: str, op: str, value) -> Column:
        c = F.col(field)
        if op in OPERATORS:
            return getattr(c, OPERATORS[op])(value)
        values = value if op == "in" else [value]
        if op not in ("eq", "in"):
            raise ValueError(f"unknown operator {op}")
        return F.lower(c).isin([v.lower() for v in values]) if all(isinstance(v, str) for v in values) else c.isin(list(values))

    return df.filter(reduce(lambda a, b: a & b, (test(*f) for f in filters), F.lit(True))).limit(min(limit, 10))


def first_by_key(df: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def ladder(value: Column, steps: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Points of the first step whose bound the value reaches; steps go from the highest bound down."""
    out = None
    for bound, points in steps:
        out = F.when(value >= bound, points) if out is None else out.when(value >= bound, points)
    return out.otherwise(otherwise)
