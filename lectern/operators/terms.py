"""Term tables of papers and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import hash_text, sentences, squeeze, term_key

CHARS_PER_TOKEN, OUT_RATIO = 3.5, 1.3


def dedupe(terms: DataFrame, by: str = "paper") -> DataFrame:
    """One entry a key, the first by pos; an empty rendering takes rendering and policy of the first later one that has some."""
    t = terms.withColumn("key", term_key(F.col("term"))).where("key <> ''")
    filled = F.trim("rendering") != ""
    g = t.groupBy(by, "key").agg(
        F.min_by(F.struct("pos", "term", "rendering", "policy"), "pos").alias("a"),
        F.min_by(F.when(filled, F.struct("rendering", "policy")), F.when(filled, F.col("pos"))).alias("b"),
    )
    use = (F.trim("a.rendering") == "") & F.col("b").isNotNull()
    pick = lambda c: F.when(use, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return g.select(by, "key", "a.pos", "a.term", pick("rendering"), pick("policy"))


def variants(terms: DataFrame, by: str = "paper") -> DataFrame:
    """key, rendering, policy and the number of papers that use it so; each paper votes with its first entry of a key."""
    v = terms.withColumn("key", term_key(F.col("term"))).where("key <> ''")
    first = v.groupBy(by, "key").agg(F.min_by(F.struct("term", "rendering", "policy"), "pos").alias("f"))
    return first.groupBy("key", F.trim("f.rendering").alias("rendering"), F.col("f.policy").alias("policy")).agg(
        F.count(F.lit(1)).alias("papers"), F.min(by).alias("first_paper")
    )


def conflicts(terms: DataFrame, by: str = "paper") -> DataFrame:
    """Keys used in two ways or more: key, n_variants, papers and the most used rendering and policy."""
    best = F.max_by(F.struct("rendering", "policy"), F.struct("papers", -F.col("first_paper")))
    g = variants(terms, by).groupBy("key").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("papers").alias("papers"), best.alias("b"))
    return g.where("n_variants >= 2").select("key", "n_variants", "papers", "b.rendering", "b.policy")


def shared(terms: DataFrame, least_papers: int = 2, by: str = "paper") -> DataFrame:
    """Keys that at least `least_papers` papers use in one and the same way."""
    g = variants(terms, by).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("rendering").alias("rendering"), F.first("policy").alias("policy"), F.sum("papers").alias("papers"))
    return g.where((F.col("n") == 1) & (F.col("papers") >= least_papers)).drop("n")


def effective(paper: DataFrame, collection: DataFrame) -> DataFrame:
    """The paper's entries with the collection's in their places, then the collection's others: key, term, rendering, policy, origin, place.

    Both: key, pos, term, rendering, policy, keys distinct.
    """
    p = paper.select("key", F.col("pos").alias("pp"), F.struct("term", "rendering", "policy").alias("p"))
    c = collection.select("key", F.col("pos").alias("cp"), F.struct("term", "rendering", "policy").alias("c"))
    j = p.join(c, "key", "full").withColumn("e", F.coalesce("c", "p"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("pp").asc_nulls_last(), F.col("cp")))
    return j.select("key", "e.*", F.when(F.col("c").isNull(), "paper").otherwise("collection").alias("origin"), place.alias("place"))


def extend(existing: DataFrame, found: DataFrame) -> DataFrame:
    """New terms whose keys are not there yet, each once."""
    new = found.withColumn("key", term_key(F.col("term"))).where("key <> ''").groupBy("key").agg(F.min("term").alias("term"))
    return new.join(existing.select(term_key(F.col("term")).alias("key")).distinct(), "key", "left_anti")


def occurring(units: DataFrame, terms: DataFrame) -> DataFrame:
    """Term lines that occur in each unit, sorted: unit, lines, hash of text and lines.

    units: unit and text; terms: term and line.  Words of the unit meet the
    first word of each term by equality; only those pairs test the whole term.
    """
    word = lambda c: F.regexp_extract(F.lower(c), r"^([0-9a-zA-ZÀ-ÿ]+)", 1)
    t = terms.select("line", F.lower(squeeze(F.col("term"))).alias("needle"), word(F.col("term")).alias("w")).where("w <> ''")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([0-9a-zA-ZÀ-ÿ]+)"), F.lit(1)))
    u = units.select("unit", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("flat"), F.explode(words).alias("w"))
    hit = u.join(t, "w").where(F.contains(F.concat(F.lit(" "), "flat"), F.concat(F.lit(" "), "needle")))
    lines = F.array_sort(F.collect_set("line"))
    return units.join(hit.groupBy("unit").agg(lines.alias("lines")), "unit", "left").select(
        "unit", F.array_join("lines", "\n").alias("lines"), hash_text(F.concat("text", F.coalesce(F.array_join("lines", "\n"), F.lit("")))).alias("hash")
    )


def concordance(rows: DataFrame, term: str, limit: int = 4, by: str = "doc_id") -> DataFrame:
    """The first sentence of each row that holds the term, exact spelling first, `limit` a document."""
    s = rows.select(by, "row", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    low, exact = F.contains(F.lower("sentence"), F.lit(term.lower())), F.contains(F.col("sentence"), F.lit(term))
    s = s.where(low).withColumn("exact", exact)
    first = s.groupBy(by, "row").agg(F.min_by(F.struct("k", "sentence", "exact"), F.struct(~F.col("exact"), F.col("k"))).alias("f")).select(by, "row", "f.*")
    w = Window.partitionBy(by).orderBy(F.desc("exact"), "row")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def impact(stale: DataFrame, prices: DataFrame, by: str = "paper") -> DataFrame:
    """Work of translating stale units again: units, chars, tokens in and out, cost.

    stale: paper, model, text; prices: model, usd_in and usd_out a million tokens; an unknown model costs nothing.
    """
    g = stale.groupBy(by, "model").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("chars"))
    g = g.withColumn("tokens_in", F.floor(F.col("chars") / CHARS_PER_TOKEN)).withColumn("tokens_out", F.floor(F.col("tokens_in") * OUT_RATIO))
    cost = (F.col("tokens_in") * F.col("usd_in") + F.col("tokens_out") * F.col("usd_out")) / 1e6
    return g.join(prices, "model", "left").select(by, "model", "units", "chars", "tokens_in", "tokens_out", F.coalesce(cost, F.lit(0.0)).alias("cost"))
