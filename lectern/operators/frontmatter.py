"""Blocks of front matter, abstracts and export dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_front_label
from lectern.operators.lines import fences

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
INSTITUTIONS = r"(?i)(university|institute|department|college|school|laborator|inc\.|ltd|gmbh|research center)"
LEAST_ABSTRACT, LEAST_MARKED = 150, 40


def block_class(text: Column) -> Column:
    """What a block of front matter is: label, contact, affiliation, person, heading or prose."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    named = F.trim(text).rlike(r"^([A-ZÀ-Þ][A-Za-zÀ-ÿ'’.\-]*[ ,]*){2,6}$")
    return (
        F.when(is_front_label(text), "label").when(text.rlike(EMAIL), "contact").when(text.rlike(r"^\s*#{1,6}\s"), "heading")
        .when(text.rlike(INSTITUTIONS) & (words <= 25), "affiliation").when(named & (words <= 6), "person").otherwise("prose")
    )


def grounded_names(names: Column, source: Column) -> Column:
    """All names occur in the source."""
    return F.forall(names, lambda n: F.contains(source, n))


def abstract(blocks: DataFrame, by: str = "doc_id", pos: str = "block") -> DataFrame:
    """Abstract of each document: what follows its marker, else the longest prose before the first numbered heading.

    blocks: by, pos, text.  A marked one needs LEAST_MARKED characters, another
    LEAST_ABSTRACT.
    """
    w = Window.partitionBy(by).orderBy(pos)
    t = F.trim("text")
    mark = t.rlike(r"(?i)^(#{1,6}\s*)?\**abstract\b")
    inline = F.trim(F.regexp_replace(t, r"(?i)^(#{1,6}\s*)?\**abstract\**[\s:.\-–—]*", ""))
    stop = t.rlike(r"^#{1,6}\s") & ~mark
    b = blocks.withColumns({"_m": mark, "_own": F.when(mark, inline), "_stops": F.coalesce(F.sum(stop.cast("int")).over(w), F.lit(0))})
    b = b.withColumn("_after", F.coalesce(F.lag("_m").over(w), F.lit(False)) & (F.coalesce(F.lag("_own").over(w), F.lit("x")) == ""))
    marked = F.when(mark & (F.length("_own") >= LEAST_MARKED), F.col("_own")).when(F.col("_after") & (F.length(t) >= LEAST_MARKED), t)
    plain = F.when((F.col("_stops") <= 1) & ~stop & ~mark & (F.length(t) >= LEAST_ABSTRACT) & (block_class(F.col("text")) == "prose"), t)
    found = b.withColumns({"_marked": marked, "_plain": plain}).groupBy(by).agg(
        F.min_by("_marked", F.when(F.col("_marked").isNotNull(), F.col(pos))).alias("m"), F.max_by("_plain", F.struct(F.length("_plain"), -F.col(pos))).alias("p")
    )
    return found.select(by, F.coalesce("m", "p").alias("abstract"))


def caption_line(label: Column, caption: Column, style: str) -> Column:
    """A rendered caption: bold-italic, blockquote or italic."""
    has = F.coalesce(caption, F.lit("")) != ""
    if style == "blockquote":
        return F.concat(F.lit("> **"), label, F.lit(":**"), F.when(has, F.concat(F.lit(" "), caption)).otherwise(""))
    mark = "***" if style == "bold-italic" else "*"
    return F.concat(F.lit(mark), label, F.when(has, F.concat(F.lit(": "), caption)).otherwise(""), F.lit(mark))


def export_lines(rows: DataFrame, urls: DataFrame, target: str) -> DataFrame:
    """Rewrite citation anchors outside code fences for an export target: doc_id, i, line.

    rows: doc_id, i, line; urls: doc_id, label, url.  `links` turns
    `[text](#ref-3)` into the reference's address where it has one, `blocks`
    into a link to the block `^ref-3`.
    """
    f = fences(rows)
    if target == "blocks":
        new = F.regexp_replace("line", r"\]\(#ref-([0-9]+)\)", "](#^ref-$1)")
        return f.select("doc_id", "i", F.when(F.col("in_fence"), F.col("line")).otherwise(new).alias("line"))
    table = urls.where("url is not null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "url"))).alias("urls"))
    labels = F.regexp_extract_all("line", F.lit(r"\]\(#ref-([0-9]+)\)"), F.lit(1))
    new = F.aggregate(
        labels, F.col("line"),
        lambda acc, x: F.when(F.element_at("urls", x).isNull(), acc).otherwise(F.replace(acc, F.concat(F.lit("](#ref-"), x, F.lit(")")), F.concat(F.lit("]("), F.element_at("urls", x), F.lit(")")))),
    )
    j = f.join(table, "doc_id", "left")
    return j.select("doc_id", "i", F.when(F.col("in_fence") | F.col("urls").isNull(), F.col("line")).otherwise(new).alias("line"))


def text_share(pages: DataFrame, by: str, least: int = 40) -> DataFrame:
    """Share of pages that have text, at least `least` characters apart from blanks: by, share."""
    ok = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) >= least
    return pages.groupBy(by).agg(F.round(F.avg(ok.cast("int")), 6).alias("share"))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def author_name(name: Column) -> Column:
    """A name without the marks of notes and affiliations behind it."""
    bare = F.trim(F.regexp_replace(name, r"[\s,]*([*∗＊†‡§¶‖¹²³⁴⁵⁶⁷⁸⁹⁰0-9]+[\s,]*)+$", ""))
    return F.when(bare == "", F.trim(name)).otherwise(bare)


def grounded_authors(rows: DataFrame, trust_order: bool = True) -> DataFrame:
    """Author lists whose names, addresses and affiliations all occur in the source: rows' columns and authors, null where one does not.

    rows: entries, an array of (name, emails, affiliations), and source.  Names
    and affiliations are compared by letters and digits; with `trust_order`
    authors stand in the source's order.
    """
    flat, low = _letters(F.col("source")), F.lower("source")
    filled = lambda xs: F.filter(xs, lambda x: F.trim(x) != "")
    ok = (F.size("entries") > 0) & F.forall("entries", lambda e: (F.trim(e["name"]) != "") & F.contains(flat, _letters(e["name"]))
        & F.forall(filled(e["emails"]), lambda m: F.contains(low, F.lower(F.trim(m)))) & F.forall(filled(e["affiliations"]), lambda a: F.contains(flat, _letters(a))))
    at = lambda e, i: F.struct((F.instr(flat, _letters(author_name(e["name"]))) if trust_order else F.lit(0)).alias("at"), i.alias("i"))
    order = F.array_sort(F.transform("entries", lambda e, i: F.struct(at(e, i).alias("at"), author_name(e["name"]).alias("name"), filled(e["emails"]).alias("emails"), filled(e["affiliations"]).alias("affiliations"))))
    return rows.withColumn("authors", F.when(ok, F.transform(order, lambda x: x.dropFields("at"))))
