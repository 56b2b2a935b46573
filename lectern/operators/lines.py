"""Documents as ordered lines, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"^\s*(```|~~~)"
HEADING = r"^\s*(#{1,6})\s+(.*)$"


def in_order(*by: str, pos: str = "i") -> Window:
    return Window.partitionBy(*by).orderBy(pos)


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i (from 0) and line; exactly one trailing empty line is dropped, null texts have no lines."""
    ends = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n\z", "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(ends, "\n")).alias("i", "line"))


def fences(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Add in_fence: the line lies between code fences or is one."""
    mark = F.col("line").rlike(FENCE).cast("int")
    seen = F.sum(mark).over(in_order(by))
    return rows.withColumn("in_fence", (seen % 2 == 1) | (mark == 1))


def headings(rows: DataFrame) -> DataFrame:
    """ATX headings outside fences: doc_id, i, marks and text."""
    found = fences(rows).where(~F.col("in_fence") & F.col("line").rlike(HEADING))
    return found.select("doc_id", "i", F.length(F.regexp_extract("line", HEADING, 1)).alias("marks"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("text"))


def group_by_starts(rows: DataFrame, start: Column, by: str = "doc_id", name: str = "block") -> DataFrame:
    """Number the blocks that open where `start` holds; rows before the first are block 0."""
    return rows.withColumn(name, F.sum(start.cast("int")).over(in_order(by)))


def paragraphs(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Blocks of lines between blank ones, code fences kept whole: doc_id, block, first line and text."""
    f = fences(rows, by)
    blank = (F.trim("line") == "") & ~F.col("in_fence")
    before = F.lag(blank, 1, True).over(in_order(by))
    f = group_by_starts(f.withColumns({"_blank": blank, "_new": ~blank & before}), F.col("_new"), by).where(~F.col("_blank"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return f.groupBy(by, "block").agg(F.min("i").alias("first"), joined.alias("text"))


def sections(rows: DataFrame) -> DataFrame:
    """Sections that open at headings outside fences: doc_id, section, first line, heading and text."""
    f = fences(rows).withColumn("_head", ~F.col("in_fence") & F.col("line").rlike(HEADING))
    f = group_by_starts(f, F.col("_head"), name="section")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("_head"), F.trim(F.regexp_extract("line", HEADING, 2))))
    return f.groupBy("doc_id", "section").agg(F.min("i").alias("first"), head.alias("heading"), whole.alias("text"))


def carry_forward(rows: DataFrame, value: Column, name: str, by: str = "doc_id", pos: str = "i") -> DataFrame:
    """As-of assignment: the nearest value at or before each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(in_order(by, pos=pos).rowsBetween(Window.unboundedPreceding, 0)))


def snippet(rows: DataFrame, words: int = 10) -> DataFrame:
    """Add the first `words` words of the next line with text, with an ellipsis where more follow."""
    after = in_order("doc_id").rowsBetween(1, Window.unboundedFollowing)
    body = F.first(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(after)
    parts = F.split(body, r"\s+")
    cut = F.array_join(F.slice(parts, 1, words), " ")
    return rows.withColumn("snippet", F.when(F.size(parts) > words, F.concat(cut, F.lit("…"))).otherwise(cut))


def running_heads(rows: DataFrame, signature: Column, group: str, page: str, least_pages: int = 3) -> DataFrame:
    """Signatures that stand on at least `least_pages` pages of a group: group, sig, pages and rows; 8 to 200 characters."""
    marked = rows.withColumn("sig", signature).where(F.length("sig").between(8, 200))
    return marked.groupBy(group, "sig").agg(F.countDistinct(page).alias("pages"), F.count(F.lit(1)).alias("n")).where(F.col("pages") >= least_pages)


def drop_running_heads(rows: DataFrame, signature: Column, group: str, page: str, least_pages: int = 3) -> DataFrame:
    heads = running_heads(rows, signature, group, page, least_pages).select(group, "sig")
    return rows.withColumn("sig", signature).join(heads, [group, "sig"], "left_anti")


def search_chunks(rows: DataFrame) -> DataFrame:
    """Sections as search rows: doc_id, row, heading carried forward, text, and whether there is a body to search."""
    s = carry_forward(sections(rows), F.col("heading"), "near", pos="section")
    order = F.row_number().over(in_order("doc_id", pos="section")) - 1
    body = F.regexp_replace("text", r"(?m)^\s*#{1,6}\s+.*$", "")
    return s.select("doc_id", order.alias("row"), F.coalesce("near", F.lit("")).alias("heading"), "text", body.rlike(r"\S").alias("searchable"))


def align(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Pair the k-th section of an original with the k-th of its translation; null where a document's counts differ.

    Both: doc_id, section, text.
    """
    number = lambda df, name: df.select("doc_id", F.row_number().over(in_order("doc_id", pos="section")).alias("k"), F.col("text").alias(name))
    a, b = number(original, "original"), number(translated, "translation")
    n = a.groupBy("doc_id").agg(F.max("k").alias("na")).join(b.groupBy("doc_id").agg(F.max("k").alias("nb")), "doc_id", "left")
    same = n.where("na = nb").select("doc_id", F.lit(True).alias("same"))
    return a.join(b, ["doc_id", "k"], "left").join(same, "doc_id", "left").select("doc_id", "k", "original", F.when(F.col("same"), F.col("translation")).alias("translation"))


def zip_same(a: DataFrame, b: DataFrame, by: list[str], key: str, pos: str) -> DataFrame:
    """Pair the n-th equal key of one side with the n-th of the other: by, key, n, left_pos, right_pos."""
    w = Window.partitionBy(*by, key).orderBy(pos)
    left = a.select(*by, key, F.col(pos).alias("left_pos"), F.row_number().over(w).alias("n"))
    right = b.select(*by, key, F.col(pos).alias("right_pos"), F.row_number().over(w).alias("n"))
    return left.join(right, [*by, key, "n"])


def shift_anchors(anchors: DataFrame, edits: DataFrame) -> DataFrame:
    """Move line anchors past inserted or deleted lines: anchors (doc_id, id, line), edits (doc_id, at, delta)."""
    moved = anchors.join(edits, "doc_id", "left").groupBy("doc_id", "id", "line").agg(
        F.coalesce(F.sum(F.when(F.col("at") <= F.col("line"), F.col("delta"))), F.lit(0)).alias("by")
    )
    return moved.select("doc_id", "id", "line", (F.col("line") + F.col("by")).alias("now"))
