"""Citation markers, author-year references and reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import expand_range, kept_parts, norm_key, surname

MARKER = r"\[([0-9]{1,3}(?:\s*[,–—-]\s*[0-9]{1,3})*)\]"


def markers(rows: DataFrame, text: str = "text") -> DataFrame:
    """Numbered markers of each row, in order: all columns, k, inner and labels (null where malformed).

    Markers before `(` or after `!` or `^` are links, images and notes.
    """
    found = F.regexp_extract_all(F.regexp_replace(F.col(text), r"`[^`]*`|\$\$[^$]*\$\$|\$[^$\n]*\$", " "), F.lit(r"(?<![!^])" + MARKER + r"(?!\()"), F.lit(1))
    return rows.select("*", F.posexplode(found).alias("k", "inner")).withColumn("labels", expand_range(F.col("inner")))


def numbered_links(found: DataFrame, refs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: markers that link, and those out of range.

    A marker links if all its labels lie in 1 to the largest label and exist.
    refs: doc_id and label (number); their sets meet the markers by document.
    """
    known = refs.groupBy(doc_id).agg(F.collect_set("label").alias("known"), F.max("label").alias("top"))
    j = found.join(known, doc_id, "left")
    bad = F.col("labels").isNull() | F.exists("labels", lambda i: (i < 1) | (i > F.coalesce("top", F.lit(0))))
    ok = ~bad & F.forall("labels", lambda i: F.array_contains("known", i))
    return j.groupBy(doc_id).agg(F.count_if(ok).alias("linked"), F.count_if(bad).alias("out_of_range"))


def rank_references(refs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Author-year index: refs (label, author, year) with surname and rank in its bucket by label."""
    keyed = refs.withColumn("surname", surname(F.col("author")))
    order = Window.partitionBy(doc_id, "surname", "year").orderBy("label")
    return keyed.withColumn("rank", F.row_number().over(order) - 1)


def match_author_year(cites: DataFrame, refs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Link (surname, year, suffix) to a reference: suffix a, b, ... takes the k-th of its bucket, else the first."""
    ranked = rank_references(refs, doc_id).select(doc_id, "surname", "year", "rank", F.col("label").alias("_l"))
    size = ranked.groupBy(doc_id, "surname", "year").agg(F.count(F.lit(1)).alias("size"))
    c = cites.join(size, [doc_id, "surname", "year"], "left")
    asked = F.ascii("suffix") - 97
    c = c.withColumn("rank", F.when((F.col("suffix") != "") & (asked < F.col("size")), asked).otherwise(0))
    return c.join(ranked, [doc_id, "surname", "year", "rank"], "left").withColumnRenamed("_l", "label").drop("rank", "size")


def elect_style(numbered: DataFrame, author_year: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The style with strictly more links, numbered on a tie."""
    j = numbered.select(doc_id, "linked").join(author_year.select(doc_id, F.col("linked").alias("ay")), doc_id, "full")
    n, a = F.coalesce("linked", F.lit(0)), F.coalesce("ay", F.lit(0))
    return j.select(doc_id, F.when(a > n, "author-year").otherwise("numbered").alias("style"), F.greatest(n, a).alias("links"))


def author_year(authors: Column, year: Column) -> Column:
    """`A, 2020`, `A & B, 2020` or `A et al., 2020`, by family names as written."""
    last = lambda a: F.element_at(F.split(a, r"\s+"), -1)
    names = F.when(F.size(authors) == 0, "").when(F.size(authors) == 1, last(F.get(authors, F.lit(0)))).when(
        F.size(authors) == 2, F.concat(last(F.get(authors, F.lit(0))), F.lit(" & "), last(F.get(authors, F.lit(1))))
    ).otherwise(F.concat(last(F.get(authors, F.lit(0))), F.lit(" et al.")))
    return kept_parts([names, year.cast("string")], ", ")


def reference_url(doi: Column, arxiv: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(filled(doi), F.concat(F.lit("https://doi.org/"), doi)).when(filled(arxiv), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))


def reference_line(label: Column, raw: Column, url: Column) -> Column:
    """A line of a reference list with its anchor and link."""
    line = F.concat(F.lit('<a id="ref-'), label, F.lit('"></a>['), label, F.lit("] "), raw)
    return F.when(url.isNull(), line).otherwise(F.concat(line, F.lit(" [link]("), url, F.lit(")")))


def grounded(raw: Column, body: Column, year: Column, author: Column) -> Column:
    """The entry's own text occurs in the body, and holds its year and first family name; short ones never count."""
    r = norm_key(raw)
    first = surname(author)
    return (
        (F.length(r) >= 10) & F.contains(norm_key(body), r)
        & (year.isNull() | F.contains(raw, year.cast("string"))) & ((first == "") | F.contains(norm_key(raw), first))
    )


def first_labels(refs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One entry a label, the first; place in the list by number, labels that are none last."""
    first = refs.groupBy(doc_id, "label").agg(F.min_by(F.struct(*[c for c in refs.columns if c not in (doc_id, "label")]), "pos").alias("r"))
    number = F.col("label").try_cast("int")
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(number.asc_nulls_last(), "label"))
    return first.select(doc_id, "label", "r.*", place.alias("place"))


def allowed_citations(texts: DataFrame, allowed: DataFrame, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """Markers in a text that are in the allowed set, each once, by first appearance."""
    found = texts.select(doc_id, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("k", "token"))
    kept = found.join(allowed, [doc_id, "token"], "left_semi").groupBy(doc_id, "token").agg(F.min("k").alias("k"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(doc_id).orderBy("k"))).drop("k")
