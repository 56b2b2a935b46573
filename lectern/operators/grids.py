"""Tables and formulas on the page, step by step within a page or a document."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def letters(texts: list[str]) -> Counter:
    """Multiset of letters; rewriting a table must not change it."""
    return Counter(c for t in texts for c in t if not c.isspace())


def connected(boxes: list[tuple[float, float, float, float]], slack: float = 2.0) -> list[int]:
    """Group of each box: boxes (l, t, r, b) that touch within `slack` are one group, named by its first box."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(boxes)), key=lambda i: boxes[i][0])
    active: list[int] = []
    for i in order:
        l, t, r, b = boxes[i]
        active = [j for j in active if boxes[j][2] + slack >= l]
        for j in active:
            if boxes[j][1] <= b + slack and t <= boxes[j][3] + slack:
                x, y = sorted((find(i), find(j)))
                root[y] = x
        active.append(i)
    return [find(i) for i in range(len(boxes))]


def row_starts(first: list[tuple[float, float]], right: float, space: float = 3.0) -> list[bool]:
    """Whether each line of a cell opens a row: its first word would have fitted on the line before.

    first: for each line the width of its first word and where the line ends.
    """
    out = [True]
    for (_, end), (width, _) in zip(first, first[1:], strict=False):
        out.append(end + space + width <= right)
    return out


def split_rows(columns: list[list[str]], starts: list[list[bool]]) -> list[list[str]] | None:
    """Rows of a collapsed table, or None where its columns disagree on how many there are.

    columns: the lines of each column; starts: where a line opens a row.  The
    letters of the result are those of the input, or it is refused.
    """
    found = []
    for lines, opens in zip(columns, starts, strict=True):
        rows: list[list[str]] = []
        for line, new in zip(lines, opens, strict=True):
            if new or not rows:
                rows.append([])
            rows[-1].append(line)
        found.append([" ".join(r) for r in rows])
    full = [f for f in found if f]
    if len({len(f) for f in full}) != 1 or len(full[0]) < 2:
        return None
    rows = [[f[k] if f else "" for f in found] for k in range(len(full[0]))]
    same = letters([c for r in rows for c in r]) == letters([x for lines in columns for x in lines])
    return rows if same else None


def regions(items: DataFrame, slack: float = 2.0) -> DataFrame:
    """connected for every page of a table of boxes (doc_id, page, unit, l, t, r, b): adds region, the first unit of the group."""

    @F.pandas_udf("array<int>")
    def run(boxes: pd.Series) -> pd.Series:
        return pd.Series([connected([(b["l"], b["t"], b["r"], b["b"]) for b in page], slack) for page in boxes], dtype=object)

    g = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("unit", "l", "t", "r", "b"))).alias("u"))
    named = g.withColumn("first", run("u")).withColumn("region", F.transform("first", lambda k: F.get("u", k)["unit"]))
    return named.select("doc_id", "page", F.explode(F.arrays_zip("u", "region")).alias("p")).select("doc_id", "page", "p.u.unit", "p.region")
