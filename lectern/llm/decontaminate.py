"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, written

#: Characters of benchmark items that one block holds; larger sets run block by block.
BLOCK_CHARS = 8_000_000
#: Characters of windows whose distances a worker remembers; it forgets all beyond that.
REMEMBERED = 16_000_000
#: Share of an item's characters that may differ, and the shortest item that may lie inside words; shorter ones match whole words only.
EDIT_RATE, LEAST_CHARS = 0.05, 20
LEAKS = "array<struct<item_id:bigint,distance:int,end:int>>"
_WORD = re.compile(r"\w+")


def normalize(text: str | None) -> str:
    """Words in lower case, joined by single spaces."""
    return " ".join(_WORD.findall(text.lower())) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """Cut an item into errors + 1 pieces of near equal length: (offset, piece).

    An occurrence with at most `errors` edits leaves one piece untouched.
    """
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text, and where the first best one ends.

    Myers' bit-parallel algorithm on whole-pattern integers.
    """
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vert = eq | minus
        horiz = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(horiz | plus) & full, plus & horiz
        score += (up & top != 0) - (down & top != 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vert | up) & full, up & vert
        if score < best[0]:
            best = (score, j)
    return best


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a part of a normalised text begins and ends with words."""
    return (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


class Distances(dict):
    """Myers' distances by item and window, remembered up to a bound on the characters held."""

    def __init__(self, items: list[tuple[int, str, int]]):
        super().__init__()
        self.items, self.held = items, 0

    def __missing__(self, key: tuple[int, str]) -> tuple[int, int]:
        k, window = key
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        self.held += len(window) + 100
        self[key] = found = myers(self.items[k][1], window)
        return found


class Matcher:
    """Finds items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE, least: int = LEAST_CHARS):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= least else 0) for i, text in items if (t := normalize(text))]
        self.least = least
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for offset, piece in pieces(t, errors):
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()
        self.distances = Distances(self.items)

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of every item found, its best and then first place, in item order."""
        if not self.items or not (t := normalize(text)):
            return []
        spots: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for k, offset in where:
                spots.setdefault(k, []).append(end + 1 - size - offset)
        found = []
        for k, starts in spots.items():
            item, words, errors = self.items[k]
            if len(words) < self.least:
                end = next((s + len(words) for s in starts if _whole(t, s, s + len(words))), None)
                if end is not None:
                    found.append((item, 0, end))
                continue
            exact = t.find(words)
            best = (0, exact + len(words)) if exact >= 0 else self._search(k, t, starts)
            if best[0] <= errors:
                found.append((item, *best))
        return sorted(found)

    def _search(self, k: int, t: str, starts: list[int]) -> tuple[int, int]:
        """Verify the windows about the hits, overlapping ones as one."""
        _, words, errors = self.items[k]
        best, low, high = (len(words), 0), None, None
        for s in [*sorted(set(starts)), None]:
            if s is not None and high is not None and s - errors <= high:
                high = s + len(words) + errors
                continue
            if high is not None:
                a = max(low, 0)
                d, end = self.distances[k, t[a : max(high, 0)]]
                best = min(best, (d, a + end))
            if s is not None:
                low, high = s - errors, s + len(words) + errors
        return best


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of bounded size that the items are dealt into, and the blocks; one comes to the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    n = int((rows.agg(F.sum(F.length("t"))).first()[0] or 0) // most) + 1
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, r.t) for r in p.orderBy("i").toLocalIterator()] for p in parts)


def _finder(held: Broadcast):  # noqa: ANN202
    @F.pandas_udf(LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(held.value)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.leaks(t)] for t in texts], dtype=object)

    return find


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, distance, end_at.

    A leak is an item (normalised to lower-case words) within EDIT_RATE of its
    length in edit distance to some part of the normalised whole text.  Each
    item is cut into its error budget plus one pieces; an automaton finds exact
    hits of pieces, and Myers' distance verifies the windows about them, so no
    occurrence is missed.  Of several places the best and then the first
    counts.  Items below LEAST_CHARS characters match whole words without
    edits.  Items without words, null texts and null items match nothing; equal
    items all match; repeated rows are answered one by one; an empty table on
    either side gives no rows; further columns are not read.  Blocks of items
    (`block` characters) run one after another: the hits of one are written and
    its broadcast is freed before the next one comes.  Texts never shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items in _blocks(benchmark, item_id, item_text, block)[1]:
        held = docs.sparkSession.sparkContext.broadcast(items)
        hits = rows.select("doc_id", F.explode(_finder(held)(F.col("text"))).alias("l")).select("doc_id", "l.item_id", "l.distance", F.col("l.end").alias("end_at"))
        hits = materialize(hits, "leaks")
        held.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of docs that hold no benchmark item, by the rules of find_leaks.

    All columns stay, whatever their names.  With several blocks of items the
    rows that are left after one are written before the next one looks at
    them, and the step before is deleted.
    """
    left, step = docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), None
    n, blocks = _blocks(benchmark, item_id, item_text, block)
    for items in blocks:
        held = docs.sparkSession.sparkContext.broadcast(items)
        left = left.withColumn("n", F.size(_finder(held)(F.col("text")))).where("n = 0").select("row", "text")
        if n > 1:
            before = step
            left, step = written(left, "clean")
            held.unpersist()
            if before is not None:
                discard(docs.sparkSession, before)
    return left.select("row.*")
