"""Captions of figures and tables in ordered lines (doc_id, i, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.similarity import ratio
from lectern.functions.text import plain_entities, replace_each
from lectern.operators.lines import in_order

#: What a caption starts with, and with its number and separator.
WORDS = r"(Figure|Fig\.?|Table|Tab\.?)"
CAPTION = r"(?i)^\**\s*" + WORDS + r"\s+([0-9]+|[IVXLC]+)\**[.:]?\s*(.*)$"
SEPARATED = r"(?i)" + WORDS + r"\s+([0-9]+|[IVXLC]+)\s*[.:]"
NUMBERED = r"(?i)^(>\s*)?(\*\*|__)?\s*(Figure|Fig\.?|Table|Tab\.?|그림|표)\s*([0-9]+)(\*\*|__)?\s*[.:]"
IMAGE = r"^!\[[^\]]*\]\(([^)]+)\)\s*$"
GRID = r"^\s*\|.*\|\s*$"
SUBFIGURE = r"^\s*([-*+]\s+)?\(?[a-z]\)(\s|$)"
HEADED_CAPTION = r"(?i)^#{1,6}\s+(<[^>]+>\s*)?" + WORDS + r"\s+([0-9]+|[IVXLC]+)\s*[:.]?\s*(.*)$"
BULLET_HEADING = r"^#{1,6}\s+[•·‣●▪◦∙・]\s+(\S.*)$"
NUMBERED_HEADING = r"(?i)^\s*([0-9]|Part\b|Appendix\b|Chapter\b|Section\b)"
ESCAPED = r"\\([\\`*_{}\[\]()#+\-.!|<>~&$])"
#: Headings that are sections, however close to a figure.
SECTIONS = (
    "abstract", "references", "introduction", "acknowledgments", "acknowledgements", "conclusion", "conclusions", "keywords", "ccs concepts", "related work", "background",
    "appendix", "discussion", "methods", "method", "results", "limitations", "footnotes",
)
TITLE_CHARS, SAME, KEY_CHARS = 60, 0.9, 400


def untagged(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"<[^>]+>", ""))


def caption_key(line: Column) -> Column:
    """A caption without tags, character entities, escapes and double blanks."""
    text = plain_entities(F.regexp_replace(line, r"<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, ESCAPED, "$1"), r"\s+", " "))


def match_key(line: Column) -> Column:
    """Letters and digits of a caption in lower case, which survive spacing and formula marks."""
    return F.lower(F.regexp_replace(caption_key(line), r"[^0-9A-Za-zÀ-ɏͰ-ӿ가-힣]+", ""))


def same_caption(a: Column, b: Column) -> Column:
    """Whether two captions are one text: matching blocks of their keys cover nine tenths."""
    x, y = F.substring(match_key(a), 1, KEY_CHARS), F.substring(match_key(b), 1, KEY_CHARS)
    return (x != "") & (ratio(x, y) >= SAME)


def caption_label(line: Column) -> Column:
    """`Figure 3` or `Table 3` of a caption; null for any other line."""
    t = untagged(line)
    word = F.when(F.lower(F.regexp_extract(t, CAPTION, 1)).startswith("tab"), "Table").otherwise("Figure")
    return F.when(t.rlike(CAPTION), F.concat_ws(" ", word, F.regexp_extract(t, CAPTION, 2)))


def plain_headings(line: Column) -> Column:
    """Headings that are bullets become list items, those that are captions become plain captions."""
    label = F.concat_ws(" ", F.regexp_extract(line, HEADED_CAPTION, 2), F.regexp_extract(line, HEADED_CAPTION, 3))
    rest = F.trim(F.regexp_extract(line, HEADED_CAPTION, 4))
    return (
        F.when(line.rlike(BULLET_HEADING), F.concat(F.lit("- "), F.trim(F.regexp_extract(line, BULLET_HEADING, 1))))
        .when(line.rlike(HEADED_CAPTION), F.when(rest == "", label).otherwise(F.concat_ws(": ", label, rest)))
        .otherwise(line)
    )


def near_text(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Add above and below: the nearest lines with text."""
    text = F.when(F.trim("line") != "", F.col("line"))
    w = in_order(by)
    return rows.withColumns(
        {
            "above": F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "below": F.first(text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )


def table_captions(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Captions that no image has taken, with a separator or next to a grid of cells: doc_id, i, label, caption.

    taken: doc_id, i.
    """
    t = untagged(F.col("line"))
    beside = F.coalesce(F.col("above").rlike(GRID), F.lit(False)) | F.coalesce(F.col("below").rlike(GRID), F.lit(False))
    free = near_text(rows).where(t.rlike(CAPTION) & (t.rlike(SEPARATED) | beside)).join(taken, ["doc_id", "i"], "left_anti")
    return free.select("doc_id", "i", caption_label(F.col("line")).alias("label"), F.nullif(F.trim(F.regexp_extract(t, CAPTION, 3)), F.lit("")).alias("caption"))


def duplicate_captions(rows: DataFrame, same_text: bool = True) -> DataFrame:
    """Captions that stand before and again after their image; the earlier ones go: doc_id, first, lines, image.

    The caption before must be a paragraph of one line, at most one blank line
    may lie on either side of the image, and both must have one number; with
    `same_text` their texts must be the same as well.
    """
    at = lambda k: F.lag("line", -k).over(in_order("doc_id")) if k > 0 else F.lag("line", k * -1).over(in_order("doc_id"))
    near = rows.select("doc_id", "i", "line", *[at(k).alias(n) for k, n in ((-3, "u3"), (-2, "u2"), (-1, "u1"), (1, "d1"), (2, "d2"))])
    blank = lambda c: F.trim(c) == ""
    gap = F.coalesce(blank(F.col("u1")), F.lit(False))
    before = F.when(gap, F.col("u2")).otherwise(F.col("u1"))
    over = F.when(gap, F.col("u3")).otherwise(F.col("u2"))
    after = F.when(F.coalesce(blank(F.col("d1")), F.lit(False)), F.col("d2")).otherwise(F.col("d1"))
    number = lambda c: F.nullif(F.regexp_extract(untagged(c), NUMBERED, 4), F.lit(""))
    found = near.where(F.trim("line").rlike(IMAGE)).select(
        "doc_id", (F.col("i") - 1 - gap.cast("int")).alias("first"), (1 + gap.cast("int")).alias("lines"),
        F.element_at(F.split(F.regexp_extract(F.trim("line"), IMAGE, 1), "/"), -1).alias("image"), before.alias("_b"), over.alias("_o"), after.alias("_a"),
    ).where((F.col("_o").isNull() | blank(F.col("_o"))) & (number(F.col("_b")) == number(F.col("_a"))))
    found = found.where(same_caption(F.col("_b"), F.col("_a"))) if same_text else found
    return found.select("doc_id", "first", "lines", "image")


def drop_lines(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows outside the ranges (doc_id, first, lines)."""
    gone = ranges.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("lines") - 1)).alias("i"))
    return rows.join(gone, ["doc_id", "i"], "left_anti")


def figure_text(rows: DataFrame) -> DataFrame:
    """Short unnumbered headings that are words inside a figure: doc_id, i.

    A run of such headings goes whole if a figure's line comes before it, since
    what is dropped is looked through; else only its last one goes if one
    comes after it.
    """
    title = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1))
    maybe = (
        F.col("line").rlike(r"^#{1,6}\s+") & ~title.rlike(NUMBERED_HEADING) & (F.length(title) <= TITLE_CHARS)
        & ~F.lower(F.trim(F.regexp_replace(title, r":+$", ""))).isin(*SECTIONS)
    )
    t = untagged(F.col("line"))
    figure = F.trim("line").rlike(r"^\s*!\[") | (t.rlike(r"(?i)^(Figure|Fig\.?)\s+[0-9]")) | F.trim("line").rlike(SUBFIGURE)
    w = in_order("doc_id")
    full = rows.where(F.trim("line") != "").select("doc_id", "i", maybe.alias("maybe"), figure.alias("figure"))
    full = full.withColumn("run", F.sum((~F.col("maybe")).cast("int")).over(w))
    before = F.last(F.when(~F.col("maybe"), F.col("figure")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumns({"before": before, "next_maybe": F.lead("maybe").over(w), "next_figure": F.lead("figure").over(w)})
    last = ~F.coalesce("next_maybe", F.lit(False)) & F.coalesce("next_figure", F.lit(False))
    return full.where(F.col("maybe") & (F.coalesce("before", F.lit(False)) | last)).select("doc_id", "i")


def rename_images(line: Column, names: Column) -> Column:
    """Image references of a line as bare file names, by a map of paths or file names; unknown ones keep their own."""
    def new(found: Column) -> Column:
        path = F.trim(F.regexp_extract(found, r"^!\[[^\]]*\]\(([^)]+)\)$", 1))
        base = F.element_at(F.split(path, "/"), -1)
        name = F.coalesce(F.element_at(names, path), F.element_at(names, base), base)
        return F.concat(F.regexp_extract(found, r"^(!\[[^\]]*\]\()", 1), name, F.lit(")"))

    return replace_each(line, r"!\[[^\]]*\]\([^)]+\)", new)
