"""Translation context, first use of terms, guarded writes, figures and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import kept_parts, number_value

TAIL = 400
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"


def context_tail(units: DataFrame, by: str = "doc_id", pos: str = "pos", most: int = TAIL) -> DataFrame:
    """Add tail: the end of the unit before, at most `most` characters, from a sentence's start where one begins there."""
    before = F.lag("text").over(Window.partitionBy(by).orderBy(pos))
    cut = F.substring(before, F.greatest(F.length(before) - most + 1, F.lit(1)), F.lit(most))
    start = F.regexp_extract(cut, r"(?s)[.!?]\s+(.*)$", 1)
    return units.withColumn("tail", F.when(F.length(before) <= most, before).when(start != "", start).otherwise(cut))


def first_use(units: DataFrame, terms: DataFrame, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Where each gloss of a document stands first: by, term, pos; later ones lose their gloss.

    terms: by, term, gloss, the text `rendering (term)` that a unit may hold.
    Units meet the terms of their own document only.
    """
    hit = units.join(terms, by).where(F.contains("text", F.col("gloss")))
    return hit.groupBy(by, "term", "gloss").agg(F.min(pos).alias("first"))


def drop_later_glosses(units: DataFrame, firsts: DataFrame, plain: Column, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Replace glosses by their plain rendering in all units after the first that holds them."""
    per = firsts.select(by, F.struct("gloss", plain.alias("plain"), "first").alias("g")).groupBy(by).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    text = F.aggregate(
        F.coalesce("gs", F.array()), F.col("text"), lambda t, g: F.when(F.col(pos) > g["first"], F.replace(t, g["gloss"], g["plain"])).otherwise(t)
    )
    return units.join(per, by, "left").withColumn("text", F.when(F.col("gs").isNull(), F.col("text")).otherwise(text)).drop("gs")


def compare_and_set(stored: DataFrame, writes: DataFrame, key: str = "id") -> DataFrame:
    """Guarded writes: key, text and outcome (written, conflict, trashed for a text that shrinks below a fifth, deleted for an empty one).

    stored: key, text, stamp; writes: key, text, expect.  A write lands only on
    the stamp it expects; null expects that nothing is there.
    """
    s = stored.select(key, F.col("text").alias("old"), "stamp")
    j = writes.join(s, key, "left")
    shrinks = F.length("text") * 5 < F.length("old")
    outcome = (
        F.when(~F.col("expect").eqNullSafe(F.col("stamp")), "conflict").when(F.coalesce("text", F.lit("")) == "", "deleted")
        .when(F.coalesce(shrinks, F.lit(False)), "trashed").otherwise("written")
    )
    return j.select(key, F.when(outcome == "conflict", F.col("old")).otherwise(F.col("text")).alias("text"), outcome.alias("outcome"))


def attach_figures(chunks: DataFrame, described: DataFrame) -> DataFrame:
    """Descriptions of the images that each chunk shows, each once: doc_id, row, figures.

    described: doc_id, name, text.
    """
    names = F.transform(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1)), lambda p: F.element_at(F.split(F.regexp_replace(p, r"[#?].*$", ""), "/"), -1))
    shown = chunks.select("doc_id", "row", F.posexplode_outer(names).alias("k", "name"))
    j = shown.join(described.select("doc_id", "name", F.col("text").alias("d")), ["doc_id", "name"])
    first = j.groupBy("doc_id", "row", "d").agg(F.min("k").alias("k"))
    return first.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]).alias("figures"))


def figure_references(rows: DataFrame) -> DataFrame:
    """Mentions of figures, tables and sections with their numbers: doc_id, i, kind, number (arabic or roman)."""
    words = F.lit(r"(?:Figure|Fig\.|Table|Section)\s+([0-9]+|[IVXLC]+)\b")
    kinds = F.lit(r"(Figure|Fig\.|Table|Section)\s+(?:[0-9]+|[IVXLC]+)\b")
    both = F.arrays_zip(F.regexp_extract_all("line", kinds, F.lit(1)).alias("kind"), F.regexp_extract_all("line", words, F.lit(1)).alias("token"))
    found = rows.select("doc_id", "i", F.explode(both).alias("m")).select("doc_id", "i", "m.kind", "m.token")
    kind = F.when(F.col("kind") == "Table", "tab").when(F.col("kind") == "Section", "sec").otherwise("fig")
    return found.select("doc_id", "i", kind.alias("kind"), number_value(F.col("token")).alias("number")).where("number is not null")


def citation_label(label: Column, author_year: Column, short: Column, parts: list[str]) -> Column:
    """A citation's text from the chosen parts; a missing short name falls back on author and year, an empty result on the label."""
    filled = F.nullif(short, F.lit(""))
    chosen = []
    if "number" in parts:
        chosen.append(label)
    if "authoryear" in parts:
        chosen.append(author_year)
    if "short" in parts:
        chosen.append(filled if "authoryear" in parts else F.coalesce(filled, author_year))
    out = kept_parts(chosen, ", ") if chosen else F.lit("")
    return F.when(out == "", label).otherwise(out)


def folder_name(template: str, fields: dict[str, Column]) -> Column:
    """Fill `{name}` places of a template; an empty one swallows the marks before it, and none stay at the ends."""
    out = F.lit(template)
    for name, c in fields.items():
        c = F.trim(F.coalesce(c.cast("string"), F.lit("")))
        gone = F.regexp_replace(out, r"[_ \-]*\{" + name + r"\}", "")
        out = F.when(c == "", gone).otherwise(F.replace(out, F.lit("{" + name + "}"), c))
    return F.regexp_replace(out, r"^[_ \-]+|[_ \-]+$", "")


def language_code(code: Column) -> Column:
    """Normal form of a language tag: language lower, script capitalised, region upper, joined by hyphens."""
    parts = F.split(F.regexp_replace(F.trim(code), "_", "-"), "-")
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 4, F.initcap(p)).when(F.length(p) == 2, F.upper(p)).otherwise(F.lower(p))), "-"
    )


def join_lines(lines: Column) -> Column:
    """Join lines of one paragraph: a hyphen at an end glues, an address that breaks glues, else a space."""
    return F.aggregate(
        lines, F.lit(""),
        lambda a, x: F.when(a == "", x).when(a.rlike("[A-Za-zÀ-ÿ]-$") & x.rlike("^[a-zà-ÿ]"), F.concat(F.regexp_replace(a, "-$", ""), x))
        .when(a.rlike(r"https?://\S*[/.]$"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)),
    )
