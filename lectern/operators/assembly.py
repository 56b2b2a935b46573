"""From approved sections and raw lines to a rendered document and its section map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import front_label_parts, is_front_label, replace_each, squeeze
from lectern.operators.lines import FENCE, in_order

#: Headings of reference lists, and where an entry starts.
REFERENCES = ("references", "reference", "bibliography")
ENTRY = r"(?=\[[0-9]{1,3}\]\s)"
BARE_IMAGE = r"!\[[^\]]*\]\((?!https?://|images/|/)[^)/]+\)"


def anchored(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections as stored, with defaults for what is missing and the line of their block: -1 without one.

    sections: doc_id, id, text, level (string, may be null), auto_level,
    marker_level, translate, runin, body; blocks: doc_id, id, line.  A front
    label that was stored as a heading by rule becomes italic.
    """
    level = F.coalesce("level", F.lit("2"))
    old = is_front_label(F.col("text")) & level.rlike("^[1-6]$") & (F.coalesce("auto_level", level) == level)
    j = sections.join(blocks.select("doc_id", "id", "line"), ["doc_id", "id"], "left")
    return j.select(
        "doc_id", "id", "text", F.coalesce("line", F.lit(-1)).alias("line"), F.when(old, "italic").otherwise(level).alias("level"),
        F.when(old, "italic").otherwise(F.coalesce("auto_level", level)).alias("auto_level"), F.coalesce("marker_level", F.lit(2)).alias("marker_level"),
        F.coalesce("translate", F.lit(True)).alias("translate"), F.coalesce("runin", F.lit(False)).alias("runin"), "body",
    )


def stored(sections: DataFrame) -> DataFrame:
    """One JSON text a document of its sections in line order, without fields that have their defaults: doc_id, manifest."""
    keep = F.struct(
        "line", "id", "text", "level", "marker_level", F.when(F.col("auto_level") != F.col("level"), F.col("auto_level")).alias("auto_level"),
        F.when(~F.col("translate"), F.lit(False)).alias("translate"), F.when(F.col("runin"), F.lit(True)).alias("runin"), F.when(F.col("runin"), F.coalesce("body", F.lit(""))).alias("body"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(keep)), lambda s: s.dropFields("line"))
    return sections.groupBy("doc_id").agg(F.to_json(ordered).alias("manifest"))


def loaded(manifests: DataFrame) -> DataFrame:
    """The sections of stored manifests, one row each, in the columns that `anchored` takes."""
    kind = "array<struct<id:string,text:string,level:string,marker_level:int,auto_level:string,translate:boolean,runin:boolean,body:string>>"
    return manifests.select("doc_id", F.explode(F.from_json("manifest", kind)).alias("s")).select("doc_id", "s.*")


def run_in_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Levels of candidates after a model's decisions: doc_id, pos, level (null: not a heading).

    candidates: doc_id, pos, level by rule, open (whether to decide);
    decisions: doc_id, pos, is_heading, level.  A decision on what is not open,
    or with a level outside 2 to 6, does not count.
    """
    d = decisions.where(~F.col("is_heading") | F.col("level").between(2, 6)).select("doc_id", "pos", "is_heading", F.col("level").alias("to"))
    j = candidates.join(d, ["doc_id", "pos"], "left")
    return j.select("doc_id", "pos", F.when(F.col("open") & F.col("is_heading").isNotNull(), F.when(F.col("is_heading"), F.col("to"))).otherwise(F.col("level")).alias("level"))


def heading_pages(sections: DataFrame, found: DataFrame) -> DataFrame:
    """The page of each section whose squeezed, lower-cased text the extractor saw, the last one of equals: all columns and page.

    found: doc_id, pos, text, page.
    """
    key = lambda c: F.lower(squeeze(c))
    last = found.where(F.col("text") != "").groupBy("doc_id", key(F.col("text")).alias("_k")).agg(F.max_by("page", "pos").alias("page"))
    return sections.withColumn("_k", key(F.col("text"))).join(last, ["doc_id", "_k"], "left").drop("_k")


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of all sections: those without one look for their title between the pages of their neighbours: doc_id, pos, page.

    sections: doc_id, pos, text, page; pages: doc_id, page, text.  The first
    page from the last one known or found on, up to the next known one, whose
    letters and digits hold the title's (four or more).  Sections are taken in
    order within their document.
    """
    flat = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "<[^>]+>", "")), "[^0-9a-z]+", "")
    high = F.first("page", ignorenulls=True).over(in_order("doc_id", pos="pos").rowsBetween(1, Window.unboundedFollowing))
    s = sections.select("doc_id", "pos", F.col("page").cast("int").alias("page"), flat(F.col("text")).alias("title"), high.cast("int").alias("high"))
    s = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "title", "high"))).alias("s"))
    p = pages.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), flat(F.col("text")).alias("flat"))).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        here = F.filter("p", lambda g: (g["page"] >= acc["low"]) & (x["high"].isNull() | (g["page"] <= x["high"])) & F.contains(g["flat"], x["title"]))
        hit = F.coalesce(x["page"], F.when(F.length(x["title"]) >= 4, F.array_min(F.transform(here, lambda g: g["page"]))))
        out = F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), hit.alias("page"))))
        return F.struct(F.coalesce(hit, acc["low"]).alias("low"), out.alias("out"))

    pos = dict(sections.dtypes)["pos"]
    start = F.struct(F.lit(1).alias("low"), F.array().cast(f"array<struct<pos:{pos},page:int>>").alias("out"))
    j = s.join(p, "doc_id", "left").withColumn("p", F.coalesce("p", F.array()))
    return j.select("doc_id", F.explode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("o")).select("doc_id", "o.*")


def _rendered(level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "), F.col("text"))


def render(rows: DataFrame, sections: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Rendered lines of each document: doc_id, out_line (from 0), line, and id and level of the heading that a line is.

    rows: doc_id, i, line; sections: doc_id, i, id, text, level, runin, body;
    figures: doc_id, i and out, the lines in the place of a line (none: it
    goes).  A level is 1 to 6, `drop` (the section goes up to the next one),
    `merge-up` (only the heading goes), `italic` or `skip` (a paragraph).  A
    run-in heading is split from its paragraph, or stays in it for merge-up
    and skip.  Lists of references are split into an entry a paragraph.
    """
    j = rows.join(sections, ["doc_id", "i"], "left")
    if figures is not None:
        j = j.join(figures, ["doc_id", "i"], "left")
    else:
        j = j.withColumn("out", F.lit(None).cast("array<string>"))
    near = F.last(F.when(F.col("id").isNotNull(), F.col("level")), ignorenulls=True).over(in_order("doc_id"))
    j = j.withColumn("near", near).where(F.coalesce(F.col("near") != "drop", F.lit(True)))
    label = front_label_parts(F.col("text"))
    italic = F.when(label["rest"] != "", F.concat(F.lit("*"), label["label"], F.lit("* "), label["rest"])).otherwise(F.concat(F.lit("*"), F.col("text"), F.lit("*")))
    body, head = F.coalesce("body", F.lit("")), _rendered(F.col("level"))
    heading = F.col("id").isNotNull() & F.col("level").rlike("^[1-6]$") & ~F.col("line").rlike(FENCE) & F.col("out").isNull()
    lines = (
        F.when(F.col("out").isNotNull(), F.col("out"))
        .when(F.col("id").isNull() | F.col("line").rlike(FENCE), F.array("line"))
        .when(F.col("runin") & F.col("level").isin("merge-up", "skip"), F.array("line"))
        .when(F.col("runin") & (F.col("level") == "italic"), F.array(F.concat(F.lit("*"), F.col("text"), F.lit(".* "), body)))
        .when(F.col("runin"), F.array(head, F.lit(""), body))
        .when(F.col("level") == "merge-up", F.array().cast("array<string>")).when(F.col("level") == "italic", F.array(italic)).when(F.col("level") == "skip", F.array("text"))
        .otherwise(F.array(head))
    )
    shown = j.select("doc_id", "i", F.when(heading, F.col("id")).alias("id"), F.when(heading, F.col("level")).alias("level"), "text", F.posexplode(lines).alias("sub", "line"))
    first = F.col("sub") == 0
    shown = shown.select("doc_id", "i", "sub", "line", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("level")).alias("level"), F.when(first, F.col("text")).alias("text"))
    return numbered(split_references(shown))


def split_references(rows: DataFrame) -> DataFrame:
    """The body of the first list of references as one entry a paragraph, without tags, if it has two entries or more.

    rows: doc_id, i, sub, line, id, level, text of a heading.
    """
    w = Window.partitionBy("doc_id").orderBy("i", "sub")
    is_list = F.col("id").isNotNull() & F.lower(squeeze(F.col("text"))).isin(*REFERENCES)
    lists = F.sum(is_list.cast("int")).over(w)
    r = rows.withColumns({"lists": lists, "own": F.last(F.when(F.col("id").isNotNull(), is_list), ignorenulls=True).over(w)})
    inside = F.coalesce((F.col("lists") == 1) & F.col("own"), F.lit(False)) & F.col("id").isNull()
    r = r.withColumn("inside", inside).drop("lists", "own")
    parts = r.where("inside").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "sub", F.trim("line").alias("line")))).alias("l"), F.min("i").alias("i"))
    flat = squeeze(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), "<[^>]+>", ""))
    entries = F.filter(F.transform(F.split(flat, ENTRY), F.trim), lambda e: e != "")
    parts = parts.select("doc_id", "i", entries.alias("e")).where(F.size("e") >= 2)
    new = F.concat(F.array(F.lit("")), F.flatten(F.transform("e", lambda e: F.array(e, F.lit("")))))
    none = F.lit(None).cast("string")
    added = parts.select("doc_id", "i", F.posexplode(new).alias("sub", "line"), none.alias("id"), none.alias("level"), none.alias("text"))
    left = r.join(parts.select("doc_id", F.lit(True).alias("split")), "doc_id", "left").where("not (inside and coalesce(split, false))")
    return left.select("doc_id", "i", "sub", "line", "id", "level", "text").unionByName(added)


def numbered(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "sub")) - 1
    def move(found: Column) -> Column:
        return F.regexp_replace(found, r"\]\(", "](images/")
    return rows.select("doc_id", place.alias("out_line"), replace_each(F.col("line"), BARE_IMAGE, move).alias("line"), "id", "level")


def documents(rendered: DataFrame) -> DataFrame:
    """Whole texts of rendered lines: doc_id and text, with a line end after each line."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_line", "line"))), lambda x: x["line"]), "\n")
    return rendered.groupBy("doc_id").agg(F.concat(whole, F.lit("\n")).alias("text"))


def section_map(rendered: DataFrame) -> DataFrame:
    """Where the headings of rendered lines stand: doc_id, id, level, text, out_line."""
    text = F.regexp_replace("line", r"^#{1,6} ", "")
    return rendered.where("id is not null").select("doc_id", "id", F.col("level").cast("int").alias("level"), text.alias("text"), "out_line")


def write(rendered: DataFrame, path: str) -> None:
    """Texts and section maps of rendered documents below a folder, each replaced as a whole."""
    documents(rendered).write.mode("overwrite").parquet(f"{path}/texts")
    section_map(rendered).write.mode("overwrite").parquet(f"{path}/sections")


def linked(rows: DataFrame, regions: DataFrame, links: DataFrame, lists: DataFrame) -> DataFrame:
    """Lines with their citations linked and their reference lists replaced: doc_id, i, sub, line.

    rows: doc_id, i, line; regions: doc_id, start, until, the lines of the list
    of references; links: doc_id, label, url; lists: doc_id, pos, line, the new
    list.  Markers `[n]` outside the region whose label is known become links;
    the region's lines give way to the list.
    """
    known = links.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "url"))).alias("urls"))
    j = rows.join(regions, "doc_id", "left").join(known, "doc_id", "left")
    inside = F.coalesce((F.col("i") >= F.col("start")) & (F.col("i") < F.col("until")), F.lit(False))

    def to(found: Column) -> Column:
        label = F.regexp_extract(found, r"^\[([0-9]+)\]", 1)
        url = F.element_at(F.col("urls"), label)
        return F.when(url.isNull(), found).otherwise(F.concat(F.lit("[["), label, F.lit("]]("), url, F.lit(")")))

    text = F.when(F.col("urls").isNull(), F.col("line")).otherwise(replace_each(F.col("line"), r"(?<![!^\[])\[[0-9]{1,3}\](?![(\]])", to))
    body = j.where(~inside).select("doc_id", "i", F.lit(0).alias("sub"), text.alias("line"))
    new = lists.join(regions, "doc_id").select("doc_id", F.col("start").alias("i"), F.col("pos").alias("sub"), F.col("line").alias("line"))
    return body.unionByName(new)
