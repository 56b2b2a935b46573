"""Numbering, levels and regions of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import STRICT_ROMAN, heading_key

#: Numbers before headings.
ARABIC = r"^([0-9]+(\.[0-9]+)*)\.?\)?\s+(.*)$"
ROMAN = r"^([IVXLCDM]+)[.)]\s+(.*)$"
LETTER = r"^([A-Z])(\.([0-9]+(\.[0-9]+)*)|[.)])\s+(.*)$"
#: Section names that need no number.
UNNUMBERED = (
    "abstract",
    "references",
    "reference",
    "bibliography",
    "acknowledgment",
    "acknowledgments",
    "acknowledgement",
    "acknowledgements",
    "appendix",
    "appendices",
    "index",
    "keywords",
    "author contributions",
    "conflict of interest",
    "conflicts of interest",
    "funding",
    "data availability",
    "supplementary material",
    "supplementary materials",
    "ethics statement",
)
SCHEMES = ("dotted-arabic", "roman", "letter", "unnumbered", "none")


def _dots(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """Add scheme, number, depth and title of a heading; numbers go before names."""
    t = F.trim(text)
    part = lambda p, k: F.regexp_extract(t, p, k)
    roman = t.rlike(ROMAN) & part(ROMAN, 1).rlike(STRICT_ROMAN)
    name = F.lower(F.trim(F.regexp_replace(t, r"[:\-–—]+\s*$", "")))
    known = name.isin(*UNNUMBERED) | name.rlike(r"^appendix(\s|$)")
    scheme = (
        F.when(t.rlike(ARABIC), "dotted-arabic").when(roman, "roman").when(t.rlike(LETTER), "letter").when(known, "unnumbered").otherwise("none")
    )
    below = part(LETTER, 3)
    df = df.withColumn("scheme", scheme)
    by = lambda a, r, l, o: F.when(F.col("scheme") == "dotted-arabic", a).when(F.col("scheme") == "roman", r).when(F.col("scheme") == "letter", l).otherwise(o)  # noqa: E731, E741
    letter = F.when(below != "", F.concat_ws(".", part(LETTER, 1), below)).otherwise(part(LETTER, 1))
    return df.withColumns(
        {
            "number": by(part(ARABIC, 1), part(ROMAN, 1), letter, F.lit("")),
            "depth": by(_dots(part(ARABIC, 1)) + 1, F.lit(1), F.when(below != "", _dots(below) + 2).otherwise(1), F.lit(1)).cast("int"),
            "title": by(F.trim(part(ARABIC, 3)), F.trim(part(ROMAN, 2)), F.trim(part(LETTER, 5)), t),
        }
    )


def relevel(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classify, elect each document's mode, and add mode, level (1 to 6) and needs_review."""
    df, all_ = classify(df, text), Window.partitionBy(doc_id)
    has = lambda s: F.max((F.col("scheme") == s).cast("int")).over(all_) == 1
    df = df.withColumn("mode", F.when(has("roman") & (has("letter") | has("dotted-arabic")), "roman-mixed").otherwise("arabic"))
    mixed = F.col("mode") == "roman-mixed"
    level = (
        F.when(F.col("scheme").isin("unnumbered", "none"), 1)
        .when(mixed & (F.col("scheme") == "roman"), 1)
        .when(mixed & (F.col("scheme") == "letter"), F.least(F.col("depth") + 1, F.lit(6)))
        .when(mixed, F.least(F.col("depth") + 2, F.lit(6)))
        .otherwise(F.least(F.greatest(F.col("depth"), F.lit(1)), F.lit(6)))
    )
    return df.withColumns({"level": level.cast("int"), "needs_review": F.col("scheme") == "none"})


def level_groups(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document, scheme and depth: n, the first two titles, and the level if all share it."""
    titles = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title"))), 1, 2), lambda x: x["title"])
    return df.groupBy(doc_id, "scheme", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(titles, " | ").alias("examples"),
        F.when(F.min("level") == F.max("level"), F.min("level")).alias("level"),
    )


def parents(df: DataFrame, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Add parent: the nearest earlier heading of a smaller level.

    One running maximum a level, so nothing joins.
    """
    before = Window.partitionBy(doc_id).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col(pos))).over(before) for k in range(1, 6)]
    nearest = lambda k: F.greatest(*last[: k - 1]) if k > 2 else last[0]
    parent = F.lit(None)
    for k in range(2, 7):
        parent = F.when(F.col("level") == k, nearest(k)).otherwise(parent)
    return df.withColumn("parent", parent)


def regions(df: DataFrame, total: Column, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Add `until`: where the next heading starts, at the end of the document `total`."""
    return df.withColumn("until", F.coalesce(F.lead(pos).over(Window.partitionBy(doc_id).orderBy(pos)), total))


def looks_like_title(text: Column) -> Column:
    return (F.length(text) <= 140) & ~text.rlike(r"[.;]\s*$") & ~F.lower(F.trim(text)).isin(*UNNUMBERED)


def guess_title(df: DataFrame, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """A document's title: first plausible heading of level 1, else first plausible one, else the first."""
    first = lambda cond: F.min_by(F.when(cond, F.col("text")), F.when(cond, F.col(pos)))
    ok = looks_like_title(F.col("text"))
    return df.groupBy(doc_id).agg(F.coalesce(first(ok & (F.col("level") == 1)), first(ok), F.min_by("text", pos)).alias("title"))


def run_in_levels(df: DataFrame, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Level of headings without one (level null): one below the last that has one, 6 at most, 1 at the start."""
    before = Window.partitionBy(doc_id).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("level", F.coalesce("level", F.least(F.last("level", ignorenulls=True).over(before) + 1, F.lit(6)), F.lit(1)))


def inherit(new: DataFrame, old: DataFrame, text: str = "text") -> DataFrame:
    """Carry real corrections over: where the first old heading of the same key had level <> auto_level, take its level."""
    first = old.withColumn("_k", heading_key(F.col(text))).groupBy("doc_id", "_k").agg(F.min_by(F.struct("level", "auto_level"), "pos").alias("o"))
    j = new.withColumn("_k", heading_key(F.col(text))).join(first, ["doc_id", "_k"], "left")
    return j.withColumn("level", F.when(F.col("o.level") != F.col("o.auto_level"), F.col("o.level")).otherwise(F.col("level"))).drop("_k", "o")


def learned_levels(df: DataFrame, learned: DataFrame, text: str = "text") -> DataFrame:
    """Add level: what a heading of the same key was given before, null where none was.

    learned: text and level; of several levels of a key the smallest counts.
    """
    table = learned.groupBy(heading_key(F.col("text")).alias("_k")).agg(F.min("level").alias("level"))
    return df.withColumn("_k", heading_key(F.col(text))).join(table, "_k", "left").drop("_k")
