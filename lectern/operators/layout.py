"""Page geometry: items are rows (doc_id, page, unit, label, l, t, r, b, text), y downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(p: str) -> Column:
    c = lambda x: F.col(f"{p}.{x}")
    return F.greatest(c("r") - c("l"), F.lit(0.0)) * F.greatest(c("b") - c("t"), F.lit(0.0))


def overlap(p: str, q: str) -> Column:
    """Area common to two rectangles."""
    c = lambda s, x: F.col(f"{s}.{x}")
    w = F.least(c(p, "r"), c(q, "r")) - F.greatest(c(p, "l"), c(q, "l"))
    h = F.least(c(p, "b"), c(q, "b")) - F.greatest(c(p, "t"), c(q, "t"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def pair_descriptions(descriptions: DataFrame, figures: DataFrame, share: float = 0.6) -> DataFrame:
    """Give each description a figure: doc_id, did, fid, how.

    On its page the figure that covers at least `share` of the description, the
    same number first, then the largest overlap; others go to the first figure
    of their number.  Both: doc_id, page, num, rectangle, did or fid.
    """
    j = descriptions.alias("d").join(figures.alias("f"), ["doc_id", "page"]).where(overlap("d", "f") >= share * area("d"))
    w = Window.partitionBy("doc_id", "did").orderBy((F.col("d.num") == F.col("f.num")).desc_nulls_last(), overlap("d", "f").desc(), "fid")
    near = j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "did", "fid", F.lit("place").alias("how"))
    rest = descriptions.join(near, ["doc_id", "did"], "left_anti").where("num is not null")
    first = figures.where("num is not null").groupBy("doc_id", "num").agg(F.min("fid").alias("fid"))
    return near.unionByName(rest.join(first, ["doc_id", "num"]).select("doc_id", "did", "fid", F.lit("number").alias("how")))


def outside_pictures(items: DataFrame, pictures: DataFrame) -> DataFrame:
    """Items whose centre lies in no picture of their page."""
    i, p = items.alias("i"), pictures.alias("p")
    x, y = (F.col("i.l") + F.col("i.r")) / 2, (F.col("i.t") + F.col("i.b")) / 2
    inside = (F.col("i.doc_id") == F.col("p.doc_id")) & (F.col("i.page") == F.col("p.page")) & x.between(F.col("p.l"), F.col("p.r")) & y.between(F.col("p.t"), F.col("p.b"))
    return i.join(p, inside, "left_anti")


def gutters(items: DataFrame, tolerance: float = 6.0, least: int = 6, pages: int = 2) -> DataFrame:
    """Columns of line numbers: doc_id and band.

    Integers whose left edges agree within `tolerance`, at least `least` on a
    page and strictly increasing downwards, on at least `pages` pages.  Bands
    open where the next edge is further away (gaps and islands).
    """
    n = items.where(F.trim("text").rlike("^[0-9]{1,5}$")).withColumn("v", F.trim("text").cast("int"))
    edge = Window.partitionBy("doc_id", "page").orderBy("l")
    n = n.withColumn("_new", (F.col("l") - F.lag("l").over(edge) > tolerance).cast("int"))
    n = n.withColumn("g", F.sum(F.coalesce("_new", F.lit(0))).over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy("doc_id", "page", "g").orderBy("t")
    n = n.withColumn("up", F.coalesce(F.col("v") > F.lag("v").over(down), F.lit(True)))
    found = n.groupBy("doc_id", "page", "g").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up"), F.min("l").alias("l")).where((F.col("n") >= least) & F.col("up"))
    band = F.floor(F.col("l") / tolerance)
    return found.groupBy("doc_id", band.alias("band")).agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)


def columns(items: DataFrame, gap: float = 8.0) -> DataFrame:
    """Column of each item: horizontal intervals that touch within `gap` are one column (interval merge)."""
    w = Window.partitionBy("doc_id", "page").orderBy("l", "r")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce((F.col("l") > reach + gap).cast("int"), F.lit(1))
    return items.withColumn("_new", opened).withColumn("col", F.sum("_new").over(w) - 1).drop("_new")


def reading_order(items: DataFrame, gap: float = 8.0) -> DataFrame:
    """Place of each item by column, top and left, and whether the given order (unit) breaks there."""
    w = Window.partitionBy("doc_id", "page")
    c = columns(items, gap).withColumn("place", F.row_number().over(w.orderBy("col", "t", "l", "unit")))
    before = F.lag("place").over(w.orderBy("unit"))
    return c.withColumn("breaks", F.coalesce(F.col("place") < before, F.lit(False)))


def join_broken(items: DataFrame) -> DataFrame:
    """Rejoin paragraphs: an item without an end mark takes a following one of its label that starts in lower case (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("page", "unit")
    open_ = ~F.lag(F.trim("text")).over(w).rlike(r"[.!?:;]$")
    goes_on = open_ & (F.lag("label").over(w) == F.col("label")) & F.trim("text").rlike("^[a-zà-ÿ]")
    g = items.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("para", F.sum("_new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("page", "unit", "text")))
    return g.groupBy("doc_id", "para").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(ordered, lambda x: F.trim(x["text"])), " ").alias("text"))


def assign_lines(lines: DataFrame, marker: str = r"^\[?([0-9]{1,3})[\].]") -> DataFrame:
    """Lines of a reference list go to the last marker at or above them: doc_id, marker, text; markers must count up by one."""
    w = Window.partitionBy("doc_id").orderBy("page", "t", "l").rowsBetween(Window.unboundedPreceding, 0)
    m = F.regexp_extract(F.trim("text"), marker, 1).try_cast("int")
    owned = lines.withColumn("marker", F.last(m, ignorenulls=True).over(w)).where("marker is not null")
    ordered = F.array_sort(F.collect_list(F.struct("page", "t", "l", "text")))
    return owned.groupBy("doc_id", "marker").agg(F.array_join(F.transform(ordered, lambda x: F.trim(x["text"])), " ").alias("text"))


def lower_percentile(values: Column, q: float) -> Column:
    """Lower nearest-rank percentile of an array."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.floor(F.size(s) * q), F.size(s) - 1).cast("int"))


#: What foot notes of authors and of publishers start with or hold.
AUTHOR_NOTE = r"(?i)^[*∗†‡§¶]|corresponding author|equal contribution|contributed equally|e-?mail:"
PUBLISHER_NOTE = r"(?i)permission to make|copyright held|©|\(c\) [0-9]{4}|all rights reserved|licensed under|acm isbn|https?://doi\.org/10\.1145|publication rights|this work is licensed"


def footnote_kind(text: Column) -> Column:
    """Whose foot note a text is: boilerplate of a publisher, author, or body."""
    return F.when(text.rlike(PUBLISHER_NOTE), "boilerplate").when(text.rlike(AUTHOR_NOTE), "author").otherwise("body")


def relocate_footers(items: DataFrame, pictures: DataFrame, least_logo: float = 120.0, most_notice: int = 400) -> DataFrame:
    """Items of a page without what is no text of it: items' columns and kind.

    items: doc_id, page, unit, label, l, t, r, b, text; pictures: doc_id, page,
    l, t, r, b, captioned.  Foot notes are sorted into body, author and
    boilerplate; short boilerplate goes, so do uncaptioned pictures of less
    than `least_logo` points on the first page, and text that is no caption
    and whose centre lies inside a picture.
    """
    i = items.withColumn("kind", F.when(F.col("label") == "footnote", footnote_kind(F.col("text"))).otherwise(F.col("label")))
    notice = (F.col("label") == "text") & F.col("text").rlike(PUBLISHER_NOTE) & (F.length("text") < most_notice)
    logo = (F.col("label") == "picture") & (F.col("page") == 1) & (F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t")) < least_logo) & ~F.coalesce("captioned", F.lit(False)) if "captioned" in items.columns else F.lit(False)
    i = i.where(~notice & ~logo)
    p = pictures.select("doc_id", "page", F.col("l").alias("pl"), F.col("t").alias("pt"), F.col("r").alias("pr"), F.col("b").alias("pb"))
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    inside = i.where("label = 'text'").join(p, ["doc_id", "page"]).where((x > F.col("pl")) & (x < F.col("pr")) & (y > F.col("pt")) & (y < F.col("pb")))
    return i.join(inside.select("doc_id", "page", "unit").distinct(), ["doc_id", "page", "unit"], "left_anti")


def unwrapped_references(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables that are really lists of references, as entries: doc_id, table, marker, text.

    cells: doc_id, table, row, col, l, text, spans, under (stands below a
    heading of references); lines: doc_id, table, base, l, text.  Such a table
    has two filled columns and no spans, its markers count up by one, and its
    text is right of them.  Each line goes to the last marker at or above it;
    markers' own lines give the base.  Tables grow with the documents, however
    small their rows compress, so they are merged with the lines and never broadcast.
    """
    marker = F.regexp_extract("text", r"^\[?([0-9]{1,3})[\].]?$", 1).try_cast("int")
    w = Window.partitionBy("doc_id", "table").orderBy("col", "row")
    c = cells.withColumn("marker", F.when(F.col("col") == 0, marker)).withColumn("step", F.col("marker") - F.lag("marker").over(w))
    first = lambda x: F.when(F.col("col") == 0, x)
    shape = c.groupBy("doc_id", "table").agg(
        F.bool_and(first(F.col("marker").isNotNull())).alias("m"), F.bool_and(first(F.coalesce(F.col("step") == 1, F.lit(True)))).alias("s"), F.max(first(F.col("l"))).alias("left"),
        F.count(first(F.lit(1))).alias("n"), F.max("col").alias("cols"), F.bool_and(~F.col("spans")).alias("flat"), F.bool_and("under").alias("under"), F.bool_and(F.trim("text") != "").alias("filled"),
        F.min(F.when(F.col("col") == 1, F.col("l"))).alias("body"),
    )
    good = shape.where("m and s and n >= 2 and cols = 1 and flat and under and filled and body > left").select("doc_id", "table", "left").hint("merge")
    own = F.regexp_extract("text", r"^\[?([0-9]{1,3})[\].]?$", 1).try_cast("int")
    rows = lines.join(good, ["doc_id", "table"]).withColumn("marker", F.when(F.col("l") <= F.col("left"), own))
    order = Window.partitionBy("doc_id", "table").orderBy("base", F.col("marker").isNull(), "l")
    to = rows.withColumns({"entry": F.last("marker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(order)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("marker").isNull(), F.struct("n", "text")))), lambda x: x["text"]), " ")
    return to.where("entry is not null").groupBy("doc_id", "table", F.col("entry").alias("marker")).agg(text.alias("text"))
