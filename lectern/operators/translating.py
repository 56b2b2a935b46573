"""Translation of sections and figures: term lines, kept terms, prompts, links, repaired layouts and merged edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import hash_text, outside, replace_each, squeeze
from lectern.operators.lines import fences, in_order, lines, sections
from lectern.operators.sequences import kept_content, merge3, split_for_model, violations

#: Spans that no rewriting of terms touches: code, formulas, images and links, addresses.
PROTECTED = r"```[\s\S]*?```|\$\$[\s\S]*?\$\$|`[^`\n]*`|\$[^$\n]+\$|!?\[[^\]]*\]\([^)]*\)|https?://[^\s)>\]]+"
DENSE_SECTIONS = r"(?i)^[0-9.\s]*(abstract|introduction)\b"
SOURCE_CHARS, ABSTRACT_CHARS = 16_000, 1000
#: References of images below a folder, and names of translated figures.
IMAGE_REFERENCE = r"(\]\(|\[\[|src=[\"'])images/([^\s)\"'\]|#?]+)"
TRANSLATED = r"\.[a-z]{2,3}(-[A-Za-z0-9]{2,8})*\.png$"


def term_line(term: Column, rendering: Column, policy: Column) -> Column:
    """A line of a prompt for one term, by its policy: kept as it is, transliterated, glossed at first use, or translated."""
    to = F.concat(F.lit("- "), term, F.lit(" → "), rendering)
    return (
        F.when(policy == "keep", F.concat(F.lit("- "), term, F.lit(" → keep the original spelling")))
        .when(policy == "transliterate", F.concat(to, F.lit(" (by sound)"))).when(policy == "gloss-first-use", F.concat(to, F.lit(" (with the original at first use)")))
        .otherwise(F.concat(to, F.lit(" (as given)")))
    )


def term_block(terms: DataFrame, by: str = "paper") -> DataFrame:
    """All term lines of a table in order: by, block."""
    line = term_line(F.col("term"), F.col("rendering"), F.col("policy"))
    return terms.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def keep_terms(units: DataFrame, terms: DataFrame, by: str = "doc_id") -> DataFrame:
    """Units with kept terms in their original spelling again, outside protected spans.

    units: by, pos, text; terms: by, pos, term, rendering, policy.  A gloss
    `rendering (term)` becomes the term, then every rendering does.
    """
    kept = terms.where((F.col("policy") == "keep") & (F.trim("rendering") != "") & (F.trim("term") != ""))
    per = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("term").alias("term"), F.trim("rendering").alias("rendering")))).alias("_k"))
    j = units.join(per, by, "left")

    def fix(part: Column) -> Column:
        def one(t: Column, k: Column) -> Column:
            escaped = lambda c: F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
            gloss = F.concat(F.lit("(?i)"), escaped(k["rendering"]), F.lit(r"\s*[(（]\s*"), escaped(k["term"]), F.lit(r"\s*[)）]"))
            plain = F.regexp_replace(t, gloss, F.regexp_replace(k["term"], r"([\\$])", r"\\$1"))
            return F.replace(plain, k["rendering"], k["term"])

        return F.aggregate("_k", part, one)

    return j.withColumn("text", F.when(F.col("_k").isNull(), F.col("text")).otherwise(outside(F.col("text"), PROTECTED, fix))).drop("_k")


def split_by_headings(units: DataFrame, unit: str = "doc_id") -> DataFrame:
    """A translated unit back as its sections, if it has as many headings as sections and starts with one: unit, k, text.

    units: unit, text, n (sections).
    """
    rows = lines(units, unit).withColumnRenamed("doc_id", unit)
    f = fences(rows, unit)
    head = ~F.col("in_fence") & F.col("line").rlike(r"^#{1,6}\s")
    f = f.withColumn("k", F.sum(head.cast("int")).over(in_order(unit)) - 1)
    fit = f.groupBy(unit).agg(F.max("k").alias("last"), F.min("k").alias("first")).join(units.select(unit, "n"), unit).where("last + 1 = n and first = 0").select(unit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return f.join(fit, unit, "left_semi").groupBy(unit, "k").agg(text.alias("text"))


def term_source(docs: DataFrame) -> DataFrame:
    """What terms are looked for in: abstract and introduction whole, other sections by their title: doc_id, source.

    docs: doc_id, text.  Without headings it is the start of the text.
    """
    s = sections(lines(docs))
    title = F.concat(F.lit("## "), F.col("heading"))
    body = F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    part = F.when(F.col("heading").isNull(), F.lit(None)).when(F.col("heading").rlike(DENSE_SECTIONS), F.concat(title, F.lit("\n"), body)).otherwise(title)
    g = s.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("section", part.alias("p"))))), lambda x: x["p"]), "\n\n").alias("p"),
        F.min_by("text", "section").alias("start"), F.count("heading").alias("n"),
    )
    return g.select("doc_id", F.substring(F.trim(F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("start"))), 1, SOURCE_CHARS).alias("source"))


def title_abstract(docs: DataFrame) -> DataFrame:
    """Context of a translation: the first heading, and the abstract's section or the text's start: doc_id, title, abstract."""
    s = sections(lines(docs))
    body = F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    marked = F.col("heading").rlike(r"(?i)^[0-9.\s]*abstract\b") & (body != "")
    g = s.groupBy("doc_id").agg(F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("section"))).alias("title"), F.min_by(body, F.when(marked, F.col("section"))).alias("own"))
    j = docs.select("doc_id", "text").join(g, "doc_id", "left")
    return j.select("doc_id", "title", F.coalesce("own", F.substring(F.trim("text"), 1, ABSTRACT_CHARS)).alias("abstract"))


def is_figure(name: Column) -> Column:
    """Whether an image may be translated: a plain file name that is neither a formula's crop nor a translation."""
    return (F.coalesce(name, F.lit("")) != "") & ~F.contains(name, F.lit("/")) & ~name.startswith("formula-") & ~name.rlike(TRANSLATED)


def figures_to_translate(rows: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Figures of each document by first reference, and whether they wait: doc_id, name, place, todo.

    rows: doc_id, i, line; files: doc_id, name, digest; records: doc_id, name,
    src_digest of finished translations.  One whose bytes have changed since
    waits again.
    """
    names = F.transform(F.regexp_extract_all("line", F.lit(IMAGE_REFERENCE), F.lit(2)), lambda n: n)
    seen = rows.select("doc_id", "i", F.posexplode(names).alias("k", "name")).where(is_figure(F.col("name")))
    first = seen.groupBy("doc_id", "name").agg(F.min(F.struct("i", "k")).alias("at")).join(files, ["doc_id", "name"])
    done = records.select("doc_id", "name", F.col("src_digest").alias("digest"), F.lit(True).alias("done"))
    j = first.join(done, ["doc_id", "name", "digest"], "left")
    return j.select("doc_id", "name", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("place"), F.col("done").isNull().alias("todo"))


def link_figures(rows: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Image references of a translation lead to translated figures that are valid, else to the originals: rows' columns.

    records: doc_id, name, translated, src_digest.
    """
    valid = records.join(files.select("doc_id", "name", F.col("digest").alias("src_digest")), ["doc_id", "name", "src_digest"], "left_semi")
    ok = valid.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "translated"))).alias("ok"))
    back = records.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("translated", "name"))).alias("back"))
    j = rows.join(ok, "doc_id", "left").join(back, "doc_id", "left")

    def to(found: Column) -> Column:
        name = F.regexp_extract(found, IMAGE_REFERENCE, 2)
        plain = F.concat(F.regexp_replace(name, TRANSLATED, ""), F.lit(".png"))
        original = F.when(name.rlike(TRANSLATED), F.coalesce(F.element_at(F.col("back"), name), plain)).otherwise(name)
        return F.concat(F.regexp_extract(found, IMAGE_REFERENCE, 1), F.lit("images/"), F.coalesce(F.element_at(F.col("ok"), original), original))

    return j.withColumn("line", replace_each(F.col("line"), IMAGE_REFERENCE, to)).select(rows.columns)


def retranslation_plan(units: DataFrame, asked: DataFrame, done: DataFrame) -> DataFrame:
    """What a job on chosen sections has to do: doc_id, unit, sections, action (translate, keep).

    units: doc_id, unit, section, text; asked: doc_id, section; done: doc_id,
    hash of finished units.  A unit runs if one of its sections was asked for
    or its text was never translated.
    """
    a = asked.select("doc_id", "section", F.lit(True).alias("asked"))
    j = units.join(a, ["doc_id", "section"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n")
    g = j.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("sections"), F.coalesce(F.bool_or("asked"), F.lit(False)).alias("asked"), hash_text(text).alias("hash"))
    g = g.join(done.select("doc_id", "hash", F.lit(True).alias("done")), ["doc_id", "hash"], "left")
    return g.select("doc_id", "unit", "sections", F.when(F.col("asked") | F.col("done").isNull(), "translate").otherwise("keep").alias("action"))


def fix_layout(docs: DataFrame, call: Callable[[str], str], most: int = 4000, tries: int = 2) -> DataFrame:
    """Documents with a layout that a callable (text) -> text has repaired piece by piece: doc_id, text, fixed, kept, problems.

    A piece that loses content, grows or breaks structure, and one whose call
    fails, is tried again and then stays as it was.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                parts, fixed, kept, said = [], 0, 0, []
                for piece in split_for_model(text or "", most):
                    answer, wrong = piece, ["failed"]
                    for _ in range(tries if piece.strip() else 0):
                        try:
                            answer = call(piece)
                        except Exception:  # noqa: BLE001 - a model's failure is data
                            continue
                        wrong = kept_content(piece, answer) + [v for v in violations(piece, answer) if v != "headings"]
                        if not wrong:
                            break
                    good = not wrong or not piece.strip()
                    fixed += bool(good and answer != piece)
                    kept += not good
                    said += [] if good else wrong
                    parts.append(answer if good else piece)
                out.append((doc, "\n".join(parts), fixed, kept, said))
            yield pd.DataFrame(out, columns=["doc_id", "text", "fixed", "kept", "problems"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string, fixed int, kept int, problems array<string>")


def reassemble(docs: DataFrame) -> DataFrame:
    """New assemblies with a person's edits carried over: doc_id, text, edited, conflicts, dropped.

    docs: doc_id, base (assembled before), mine (as edited; null: no edit),
    theirs (assembled now).
    """

    @F.pandas_udf("struct<text:string,conflicts:int,dropped:int>")
    def merge(base: pd.Series, mine: pd.Series, theirs: pd.Series) -> pd.DataFrame:
        out = [(t, 0, 0) if m is None else merge3(b or "", m, t or "") for b, m, t in zip(base, mine, theirs, strict=True)]
        return pd.DataFrame(out, columns=["text", "conflicts", "dropped"])

    j = docs.withColumn("_m", merge("base", "mine", "theirs"))
    return j.select("doc_id", "_m.text", (F.col("_m.text") != F.col("theirs")).alias("edited"), "_m.conflicts", "_m.dropped")


def cached_results(inputs: DataFrame, cache: DataFrame, version: int, key: str = "doc_id") -> DataFrame:
    """Which results still hold: key, signature, value (null: to compute again).

    inputs: key, mtime, size; cache: key, signature, value.  A result that a
    person wrote (signature `user`) always holds.
    """
    sign = F.concat_ws(":", F.col("mtime").cast("string"), F.col("size").cast("string"), F.lit(f"v{version}"))
    j = inputs.withColumn("now", sign).join(cache, key, "left")
    ok = (F.col("signature") == "user") | F.col("signature").eqNullSafe(F.col("now"))
    return j.select(key, F.when(F.col("signature") == "user", "user").otherwise(F.col("now")).alias("signature"), F.when(ok, F.col("value")).alias("value"))


def refreshed(inputs: DataFrame, stored: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """Stored results brought up to date: key, hash, value; only rows whose input hash has changed are built again.

    inputs: key, hash, ...; stored: key, hash, value; build: rows of inputs to key and value.
    """
    same = inputs.select(key, "hash").join(stored, [key, "hash"])
    rest = inputs.join(same.select(key), key, "left_anti")
    new = rest.select(key, "hash").join(build(rest), key)
    return same.select(key, "hash", "value").unionByName(new.select(key, "hash", "value"))


def fill_references(refs: DataFrame, pool: DataFrame, most: int = 60) -> DataFrame:
    """References with blank fields filled from records: refs' columns, status (linked, bulk, single, skipped, none) and place among lookups.

    refs: doc_id, label, title, doi, arxiv, year, venue; pool: doc_id, key (a
    squeezed lower-case title), bulk, doi, arxiv, year, venue.  What has a
    link is left; records fetched in bulk go first; of the rest the first
    `most` a document may be looked up one by one.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    key = F.lower(squeeze(F.col("title")))
    r = refs.withColumns({"_linked": ~(blank("doi") & blank("arxiv")), "_key": key})
    fields = ("doi", "arxiv", "year", "venue")
    best = pool.groupBy("doc_id", F.col("key").alias("_key"), "bulk").agg(F.min(F.struct(*fields)).alias("f"))
    both = best.groupBy("doc_id", "_key").agg(F.max(F.when(F.col("bulk"), F.col("f"))).alias("_bulk"), F.max(F.when(~F.col("bulk"), F.col("f"))).alias("_single"))
    j = r.join(both, ["doc_id", "_key"], "left")
    adds = lambda f: F.lit(False) if f is None else F.coalesce(F.reduce(F.array(*[blank(c) & (F.coalesce(F.col(f"{f}.{c}").cast("string"), F.lit("")) != "") for c in fields]), F.lit(False), lambda a, b: a | b), F.lit(False))  # noqa: E731, E501
    j = j.withColumn("_open", ~F.col("_linked") & ~adds("_bulk"))
    place = F.when(F.col("_open"), F.sum(F.col("_open").cast("int")).over(Window.partitionBy("doc_id").orderBy("label")))
    j = j.withColumn("place", place)
    status = (
        F.when(F.col("_linked"), "linked").when(~F.col("_open"), "bulk").when(F.col("place") > most, "skipped").when(adds("_single"), "single").otherwise("none")
    )
    j = j.withColumn("status", status)
    got = lambda c: F.when(F.col("status") == "bulk", F.col(f"_bulk.{c}")).when(F.col("status") == "single", F.col(f"_single.{c}"))
    return j.select(*[F.when(blank(c), F.coalesce(got(c), F.col(c))).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in refs.columns], "status", "place")


