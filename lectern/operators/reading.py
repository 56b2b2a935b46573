"""Reading tools over documents in rows: outline, ranges, composed search, citations of answers, notes and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import locate, note_tag, replace_each, row_label, squeeze
from lectern.operators import search
from lectern.operators.writing import attach_figures

#: A marker of a row (with or without a document's token) or of a note, and the most rows of one range.
MARKER = r"\[\[\s*(?:(?:[0-9a-f]{12}\s*:\s*)?[rR]\s*[0-9]+|[aA][A-Za-z0-9_.\-]*)\s*\]\]"
ROW_PART = r"^\[\[\s*(?:([0-9a-f]{12})\s*:\s*)?[rR]\s*([0-9]+)\s*\]\]$"
NOTE_PART = r"^\[\[\s*([aA][A-Za-z0-9_.\-]*)\s*\]\]$"
MOST_ROWS, RESULT_CHARS = 30, 12_000


def outline(sections: DataFrame, by: str = "doc_id", pos: str = "pos") -> DataFrame:
    """One text a document: its headings in order, indented by level, each with its row and id.

    sections: by, pos, id, level, text.
    """
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level"), F.lit(1)) - 1), F.lit("- [r"), F.col(pos).cast("string"), F.lit("] "), F.col("id"), F.lit(" "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("line")))), lambda x: x["line"])
    return sections.groupBy(by).agg(F.array_join(lines, "\n").alias("outline"))


def section_ids(heads: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each heading row: doc_id, row, id.

    heads: doc_id, row, text; sections: doc_id, pos, id, text.  Equal numbers
    pair in order; else the n-th heading of a text pairs with the n-th section
    of it.
    """
    place = lambda df, *by, pos: F.row_number().over(Window.partitionBy("doc_id", *by).orderBy(pos))
    key = lambda c: F.lower(squeeze(c))
    whole = Window.partitionBy("doc_id")
    h = heads.withColumns({"k": key(F.col("text")), "n": F.count(F.lit(1)).over(whole)})
    s = sections.withColumns({"k": key(F.col("text")), "m": F.count(F.lit(1)).over(whole)})
    h = h.withColumns({"place": place(h, pos="row"), "nth": place(h, "k", pos="row")}).select("doc_id", "row", "k", "n", "place", "nth")
    s = s.withColumns({"place": place(s, pos="pos"), "nth": place(s, "k", pos="pos")})
    s = s.select("doc_id", "id", F.col("k").alias("k2"), "m", F.col("place").alias("place2"), F.col("nth").alias("nth2"))
    same = (F.col("n") == F.col("m")) & (F.col("place") == F.col("place2"))
    other = (F.col("n") != F.col("m")) & (F.col("k") == F.col("k2")) & (F.col("nth") == F.col("nth2"))
    return h.join(s, "doc_id").where(same | other).select("doc_id", "row", "id")


def read_range(rows: DataFrame, asked: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Rows of the ranges asked for, at most `most` of each: rows' columns with the range's `ask`.

    rows: doc_id, row, ...; asked: ask, doc_id, start, until (null: one row); a range may be given backwards.
    """
    until = F.coalesce("until", "start")
    low, high = F.greatest(F.least("start", until), F.lit(0)), F.greatest("start", until)
    a = asked.select("ask", "doc_id", low.alias("low"), F.least(high, low + most - 1).alias("high"))
    return rows.join(a, "doc_id").where(F.col("row").between(F.col("low"), F.col("high"))).drop("low", "high")


def pack(rows: DataFrame, by: list[str], pos: str, text: str = "text", budget: int = RESULT_CHARS, clip: int = 1200) -> DataFrame:
    """Leading rows of each answer within a budget of characters, each cut to `clip`; the first one always: all columns, shown, used."""
    shown = F.when(F.length(text) > clip, F.concat(F.substring(text, 1, clip), F.lit("…"))).otherwise(F.col(text))
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("shown", shown).withColumns({"used": F.sum(F.length("shown") + 2).over(w), "_n": F.row_number().over(w)})
    return r.where((F.col("_n") == 1) | (F.col("used") <= budget)).drop("_n")


def search_paper(
    chunks: DataFrame, questions: DataFrame, notes: DataFrame, figures: DataFrame | None = None, k: int = search.TOP, budget: int = RESULT_CHARS, digits: int | None = None
) -> DataFrame:
    """Rows that answer each question, best first and within a budget: question, place, row, shown, notes.

    chunks: row, text; questions: question, text; notes: id, row, text; figures:
    row, described.  A row is searched with its notes and the descriptions of
    its figures.  Questions about notes take rows with notes first.  The index
    is built once for all questions.
    """
    tagged = notes.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("notes"))
    full = chunks.join(tagged.select("row", "notes"), "row", "left")
    full = full.join(figures, "row", "left") if figures is not None else full.withColumn("described", F.lit(None).cast("string"))
    own = F.array_join(F.transform("notes", lambda n: n["text"]), " ")
    index = search.build_index(full.select("row", F.concat_ws("\n", "text", "described", own).alias("text")), "row")
    asked = search.query_terms(questions.select("question", "text"), "question")
    wants = questions.select("question", F.col("text").rlike(search.NOTE_HINT).alias("wants"))
    scores = search.bm25(index["posts"].select("row", "len", "term", "tf"), asked, index, "question")
    scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    noted = tagged.select("row", F.lit(True).alias("noted"))
    ranked = scores.join(noted, "row", "left").join(wants, "question")
    first = F.coalesce(F.col("wants") & F.col("noted"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(first), F.desc("score"), "row"))
    best = ranked.withColumn("place", place).where(F.col("place") <= k).select("question", "place", "row")
    return pack(best.join(full.select("row", "text", "notes"), "row"), ["question"], "place", budget=budget).select(
        "question", "place", "row", "shown", F.transform(F.coalesce("notes", F.array()), lambda n: note_tag(n["id"])).alias("notes")
    )


def _reference(marker: Column, current: Column) -> Column:
    """What a marker refers to, as `token:row` or a note's tag; null for a row of no document."""
    token = F.coalesce(F.nullif(F.regexp_extract(marker, ROW_PART, 1), F.lit("")), current)
    row = F.regexp_extract(marker, ROW_PART, 2).cast("bigint").cast("string")
    return F.when(marker.rlike(ROW_PART), F.concat(token, F.lit(":"), row)).otherwise(F.regexp_extract(marker, NOTE_PART, 1))


def resolve_citations(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Answers with only allowed markers, in their short form, and what they cite by first appearance: id, text, cited.

    answers: id, text, current (token of the open document); allowed: id, ref
    (`token:row` or a note's tag), a few a document.
    """
    sets = allowed.groupBy("id").agg(F.collect_set("ref").alias("refs"))
    j = answers.join(sets, "id", "left").withColumn("refs", F.coalesce("refs", F.array()))
    known = lambda m: F.coalesce(F.array_contains("refs", _reference(m, F.col("current"))), F.lit(False))

    def short(m: Column) -> Column:
        ref = _reference(m, F.col("current"))
        token, row = F.split_part(ref, F.lit(":"), F.lit(1)), F.split_part(ref, F.lit(":"), F.lit(2))
        inner = F.when(m.rlike(ROW_PART), row_label(token, row, F.col("current"))).otherwise(ref)
        return F.when(known(m), F.concat(F.lit("[["), inner, F.lit("]]")))

    text = F.regexp_replace(replace_each(F.coalesce("text", F.lit("")), MARKER, short), r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, r"[ \t]+([.,;:!?)])", "$1")
    found = F.filter(F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)), known)
    return j.select("id", F.trim(text).alias("text"), F.array_distinct(F.transform(found, lambda m: _reference(m, F.col("current")))).alias("cited"))


def combined_notes(tabs: DataFrame, by: str = "doc_id") -> DataFrame:
    """One text of all notes: a single tab with text as it is, several ones below their names in order: by, text, tabs.

    tabs: by, pos, name, text.
    """
    full = F.trim("text") != ""
    t = F.array_sort(F.collect_list(F.when(full, F.struct("pos", "name", F.trim("text").alias("text")))))
    g = tabs.groupBy(by).agg(t.alias("t"), F.count(F.lit(1)).alias("tabs"))
    many = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["name"], F.lit("\n\n"), x["text"])), "\n\n")
    return g.select(by, F.when(F.size("t") == 1, F.get("t", F.lit(0))["text"]).otherwise(many).alias("text"), "tabs")


def highlights_text(items: DataFrame, by: str = "doc_id") -> DataFrame:
    """Highlights as one markdown text a document, by row and start: quotes with their notes below: by, text, n.

    items: by, id, row, start, quote, note.
    """
    note = F.when(F.coalesce(F.trim("note"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.trim("note"))).otherwise("")
    line = F.concat(F.lit("> "), F.replace(F.trim("quote"), F.lit("\n"), F.lit("\n> ")), note)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "start", "id", line.alias("line")))), lambda x: x["line"])
    return items.groupBy(by).agg(F.array_join(ordered, "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


def tooltips(refs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Display text and address of each label, as one map a document: by, tips.

    refs: by, label, authors, title, venue, year, url; the first of a label counts.
    """
    shown = F.concat_ws(
        ". ", F.nullif(F.array_join("authors", ", "), F.lit("")), F.nullif(F.trim("title"), F.lit("")),
        F.nullif(F.concat_ws(", ", F.nullif(F.trim("venue"), F.lit("")), F.col("year").cast("string")), F.lit("")),
    )
    first = refs.groupBy(by, "label").agg(F.min_by(F.struct(shown.alias("text"), F.coalesce("url", F.lit("")).alias("url")), "pos").alias("tip"))
    return first.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "tip")))).alias("tips"))


def bundle(rows: DataFrame, heads: DataFrame, refs: DataFrame) -> DataFrame:
    """Everything that a reader of one document needs: doc_id, rows, toc, cites, bytes.

    rows: doc_id, row, original, translation; heads: doc_id, row, level, text;
    refs: doc_id, label, text.
    """
    r = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "original", "translation"))).alias("rows"))
    t = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "level", "text"))).alias("toc"))
    c = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "text"))).alias("cites"))
    j = r.join(t, "doc_id", "left").join(c, "doc_id", "left")
    return j.withColumn("bytes", F.octet_length(F.to_json(F.struct("rows", "toc", "cites"))))


def quote_rows(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """Where each quote stands in its row: id, start, end; none if it does not.

    rows: doc_id, row, text; quotes: id, doc_id, row, quote.
    """
    j = quotes.join(rows, ["doc_id", "row"]).select("id", locate(F.col("text"), F.col("quote")).alias("at"))
    return j.where("at is not null").select("id", "at.start", "at.end")


def describe_figures(chunks: DataFrame, described: DataFrame) -> DataFrame:
    """Descriptions of the figures that each row shows, as one text: row, described."""
    return attach_figures(chunks.select(F.lit(0).alias("doc_id"), "row", "text"), described.select(F.lit(0).alias("doc_id"), "name", "text")).select(
        "row", F.array_join("figures", " ").alias("described")
    )
