"""Line differences of pairs of texts, by longest common subsequences in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LOT = 1 << 19  # characters of texts whose differences are held at once
FOUND = "removed int, added int, first_changed int, diff string"


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with every beginning of b: one row at a time."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (in a, in b) of one longest common subsequence; a is halved where the halves' lengths sum highest, so memory is that of two rows."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            at = np.flatnonzero(b[b0:b1] == a[a0])
            out += [(a0, b0 + int(at[0]))] if len(at) else []
            continue
        mid = (a0 + a1) // 2
        ahead, behind = _common(a[a0:mid], b[b0:b1]), _common(a[mid:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int((ahead + behind[::-1]).argmax())
        work += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def changes(old: str, new: str) -> list[tuple[str, int, int, str]]:
    """Every line as (mark, number in old, number in new, line): '-' removed, '+' added, ' ' kept; removed lines come before added ones."""
    lines = [x.splitlines(keepends=True) if "\r" not in x else [y + "\n" for y in x.split("\n")[:-1]] + [x.split("\n")[-1]] * (not x.endswith("\n")) for x in (old, new)]
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in lines)
    out, i, j = [], 0, 0
    for p, q in [*matched(a, b), (len(a), len(b))]:
        out += [("-", k + 1, j + 1, lines[0][k]) for k in range(i, p)] + [("+", p + 1, k + 1, lines[1][k]) for k in range(j, q)]
        if p < len(a):
            out.append((" ", p + 1, q + 1, lines[0][p]))
        i, j = p + 1, q + 1
    return out


def rendered(old: str, new: str, context: int = 4) -> tuple[int, int, int | None, str]:
    """Numbers of removed and added lines, the first changed one (in new), and the diff as text.

    Kept lines between two changes are shown whole, others up to ``context`` of them beside a change; dots stand for the rest.
    """
    rows = changes(old, new)
    width = len(str(max(old.count("\n"), new.count("\n")) + 1))
    show = lambda r: f"{r[0]}{r[2] if r[0] == '+' else r[1]:>{width}} {r[3].removesuffix(chr(10))}"
    dots = " " + " " * width + " ..."
    blocks = [(kept, list(part)) for kept, part in groupby(rows, lambda r: r[0] == " ")]
    out: list[str] = []
    for k, (kept, part) in enumerate(blocks):
        if not kept:
            out += map(show, part)
            continue
        after, before = k > 0, k + 1 < len(blocks)
        if after and not before and len(part) > context:
            out += [*map(show, part[:context]), dots]
        elif before and not after and len(part) > context:
            out += [dots, *map(show, part[-context:])]
        elif after or before:
            out += map(show, part)
    marks = [r[0] for r in rows]
    first = next((r[2] for r in rows if r[0] != " "), None)
    return marks.count("-"), marks.count("+"), first, "\n".join(out)


def _found(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[pa.RecordBatch]:
    """The differences of batches of key, old and new, in lots; of the batch itself one row at a time becomes Python's."""
    for batch in batches:
        key = batch.schema.field(0)
        kinds = pa.schema([key, *((c, pa.int32()) for c in ("removed", "added", "first_changed")), ("diff", pa.string())])
        begin, size, found = 0, 0, []
        for i in range(batch.num_rows):
            a, b = (batch.column(c)[i].as_py() or "" for c in (1, 2))
            found.append(rendered(a, b, context))
            size += len(a) + len(b)
            if size > LOT or i + 1 == batch.num_rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds.types[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), *columns], schema=kinds)
                begin, size, found = i + 1, 0, []


def line_diffs(pairs: DataFrame, key: str, old: str, new: str, context: int = 4) -> DataFrame:
    """key, removed, added, first_changed, diff of every pair of texts; null counts as empty."""
    return pairs.select(key, old, new).mapInArrow(partial(_found, context=context), f"{key} {pairs.schema[key].dataType.simpleString()}, {FOUND}")
