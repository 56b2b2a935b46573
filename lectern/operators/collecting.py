"""Edits of collections, memberships, flags and stored tables, as new versions of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import squeeze
from lectern.operators.library import closure
from lectern.operators.terms import dedupe

MOST_NAME = 80
#: What is no words of a page: linked citations, formulas, addresses of links, tags.
NO_WORDS = r"\[\[[^\]]*\]\([^)]*\)\]|\$[^$]*\$|\]\([^)]*\)|<[^>]+>"


def clean_name(name: Column) -> Column:
    return F.substring(squeeze(F.coalesce(name, F.lit(""))), 1, MOST_NAME)


def create(collections: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with new ones after them: id, name, parent, ord.

    new: id, name, parent, ord.  An empty name becomes `Collection n` by the
    number of collections there then are; an unknown parent is none.
    """
    n = collections.agg(F.count(F.lit(1)).alias("n"))
    known = collections.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    w = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ord"))
    name = F.when(clean_name(F.col("name")) == "", F.concat(F.lit("Collection "), F.col("n") + F.col("place"))).otherwise(clean_name(F.col("name")))
    added = new.withColumn("place", w).join(F.broadcast(n)).join(known, "parent", "left")
    added = added.select("id", name.alias("name"), F.when(F.col("known"), F.col("parent")).alias("parent"), "ord")
    return collections.select("id", "name", "parent", "ord").unionByName(added)


def rename(collections: DataFrame, names: DataFrame) -> DataFrame:
    """Collections with new names (id, to); blank ones change nothing."""
    to = names.select("id", clean_name(F.col("to")).alias("to")).where("to <> ''")
    return collections.join(to, "id", "left").withColumn("name", F.coalesce("to", "name")).drop("to")


def delete(collections: DataFrame, gone: DataFrame) -> DataFrame:
    """Collections without those of `gone` (id); their children move up to the nearest ancestor that stays."""
    mark = gone.select("id").distinct()
    stays = closure(collections).where("depth > 0").join(mark.withColumnRenamed("id", "ancestor"), "ancestor", "left_anti")
    up = stays.groupBy("id").agg(F.min_by("ancestor", "depth").alias("up"))
    left = collections.join(mark, "id", "left_anti")
    orphan = mark.select(F.col("id").alias("parent"), F.lit(True).alias("orphan"))
    j = left.join(orphan, "parent", "left").join(up, "id", "left")
    return j.withColumn("parent", F.when(F.col("orphan"), F.col("up")).otherwise(F.col("parent"))).select(collections.columns)


def leave(memberships: DataFrame, gone: DataFrame) -> DataFrame:
    """Lists of collections of each document without deleted ones: doc_id, projects (array)."""
    per = memberships.select("doc_id", F.posexplode_outer("projects").alias("pos", "id"))
    kept = per.join(gone.select("id").distinct(), "id", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("p"))
    names = F.filter(F.transform("p", lambda x: x["id"]), lambda x: x.isNotNull())
    return memberships.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce(names, F.array()).alias("projects"))


def move(collections: DataFrame, moves: DataFrame) -> DataFrame:
    """Which moves (id, to) may be made: id, to, allowed.

    A collection may move to the top (null), or below a known one that is
    neither itself nor below it.
    """
    below = closure(collections).select(F.col("id").alias("to"), F.col("ancestor").alias("id"), F.lit(True).alias("below"))
    known = collections.select(F.col("id").alias("to"), F.lit(True).alias("known"))
    own = collections.select("id", F.lit(True).alias("own"))
    j = moves.join(below, ["id", "to"], "left").join(known, "to", "left").join(own, "id", "left")
    ok = F.col("own").isNotNull() & (F.col("to").isNull() | (F.col("known").isNotNull() & F.col("below").isNull()))
    return j.select("id", "to", ok.alias("allowed"))


def apply_moves(collections: DataFrame, moves: DataFrame) -> DataFrame:
    to = move(collections, moves).where("allowed").select("id", "to", F.lit(True).alias("moved"))
    j = collections.join(to, "id", "left")
    return j.withColumn("parent", F.when(F.col("moved"), F.col("to")).otherwise(F.col("parent"))).select(collections.columns)


def set_settings(collections: DataFrame, changes: DataFrame, allowed: list[str]) -> DataFrame:
    """Settings (a map) after changes: id, settings.

    changes: id, key, value; a null value unsets, keys that are not allowed
    change nothing, of several changes of a key the one with the last `pos`.
    """
    last = changes.where(F.col("key").isin(allowed)).groupBy("id", "key").agg(F.max_by("value", "pos").alias("value"))
    new = last.groupBy("id").agg(F.collect_list(F.struct("key", "value")).alias("new"))
    keys = F.transform(F.coalesce("new", F.array()), lambda x: x["key"])
    kept = F.map_filter(F.coalesce("settings", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(keys, k))
    added = F.map_from_entries(F.filter("new", lambda x: x["value"].isNotNull()))
    return collections.join(new, "id", "left").select("id", F.when(F.col("new").isNull(), F.col("settings")).otherwise(F.map_concat(kept, added)).alias("settings"))


def find(collections: DataFrame, asked: DataFrame) -> DataFrame:
    """One collection for each text asked: ask, id, matches.

    An exact id goes before exact names, those before names that hold the text
    in any case; id is null unless exactly one matches.  Parts of names are met
    by their first letters, so names and texts are never all paired.
    """
    key = F.trim(F.coalesce("text", F.lit("")))
    a = asked.select("ask", key.alias("key"))
    c = collections.select("id", "name")
    gram = 3
    grams = F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.array(*[F.substring(F.lower("name"), i, F.lit(k)) for k in range(1, gram + 1)])))
    )
    parts = c.select("id", "name", F.explode(grams).alias("gram"))
    by_id = a.join(c, F.col("key") == F.col("id")).select("ask", "id", F.lit(0).alias("rank"))
    by_name = a.join(c, F.col("key") == F.col("name")).select("ask", "id", F.lit(1).alias("rank"))
    probe = a.where("key <> ''").withColumn("gram", F.substring(F.lower("key"), 1, gram))
    by_part = probe.join(parts, "gram").where(F.contains(F.lower("name"), F.lower("key"))).select("ask", "id", F.lit(2).alias("rank"))
    hits = by_id.unionByName(by_name).unionByName(by_part)
    best = hits.groupBy("ask").agg(F.min("rank").alias("best"))
    n = hits.join(best, "ask").where("rank = best").groupBy("ask").agg(F.countDistinct("id").alias("matches"), F.min("id").alias("id"))
    return a.select("ask").join(n, "ask", "left").select("ask", F.when(F.col("matches") == 1, F.col("id")).alias("id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def set_flags(docs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Documents with changed flags: doc_id, hidden, pinned_at, lang.

    changes: doc_id, hidden, pin, lang (null: as it is).  A pin stores when it
    was set, an unpin clears it, a pin of what is pinned keeps its time.
    """
    c = changes.select("doc_id", F.col("hidden").alias("h"), F.col("pin").alias("p"), F.col("lang").alias("l"))
    j = docs.join(c, "doc_id", "left")
    pinned = F.when(F.col("p"), F.coalesce("pinned_at", now)).when(~F.col("p"), F.lit(None)).otherwise(F.col("pinned_at"))
    return j.select("doc_id", F.coalesce("h", "hidden").alias("hidden"), pinned.alias("pinned_at"), F.coalesce("l", "lang").alias("lang"))


def language(own: Column, stage: Column, common: Column) -> Column:
    """A document's language: its own, else that of its last stage, else the common one."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(own), filled(stage), common)


def read_terms(stored: DataFrame, by: str = "paper") -> DataFrame:
    """Stored term tables (by, terms as JSON) as rows, with defaults and each key once: by, pos, term, rendering, policy."""
    kind = "array<struct<term:string,rendering:string,policy:string>>"
    rows = stored.select(by, F.posexplode(F.from_json("terms", kind)).alias("pos", "t")).select(
        by, "pos", F.coalesce("t.term", F.lit("")).alias("term"), F.coalesce("t.rendering", F.lit("")).alias("rendering"), F.coalesce(F.nullif("t.policy", F.lit("")), F.lit("translate")).alias("policy")
    )
    return dedupe(rows, by).drop("key")


def write_terms(terms: DataFrame, by: str = "paper") -> DataFrame:
    """Term rows as one JSON text a table, in order: by, terms."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "rendering", "policy"))), lambda x: x.dropFields("pos"))
    return terms.groupBy(by).agg(F.to_json(ordered).alias("terms"))


def replace_tables(old: DataFrame, new: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Stored tables with new ones in their places and those of `gone` deleted, in all their languages.

    old and new: key and payload; gone: the first column of key.
    """
    left = old.join(new.select(key), key, "left_anti").unionByName(new.select(old.columns))
    return left.join(gone.select(key[0]).distinct(), key[0], "left_anti")


def changed_copies(source: DataFrame, target: DataFrame, used: DataFrame, prefix: str) -> DataFrame:
    """Files to copy: name, to; only those that are referenced and differ in bytes from what is there.

    source: name, digest; target: name (with its prefix), digest; used: name.
    """
    s = source.join(used.select("name").distinct(), "name", "left_semi").select("name", "digest", F.concat(F.lit(prefix), "name").alias("to"))
    t = target.select(F.col("name").alias("to"), F.col("digest").alias("there"))
    return s.join(t, "to", "left").where(~F.col("digest").eqNullSafe(F.col("there"))).select("name", "to")


def batch(docs: DataFrame, memberships: DataFrame, collections: DataFrame, scope: str | None, paper: int | None = None) -> DataFrame:
    """Documents that a library command runs over: one, those of a collection and below, or all that are not hidden: doc_id."""
    if paper is not None:
        return docs.where(F.col("doc_id") == paper).select("doc_id")
    shown = docs.where(~F.coalesce("hidden", F.lit(False))).select("doc_id")
    if scope is None:
        return shown
    inside = closure(collections).where(F.col("ancestor") == scope).select("id")
    return shown.join(memberships.join(inside, "id", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")


def attach_jobs(turns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Turns with the jobs that they started, in order: session, turn, jobs (array of id and kind)."""
    per = jobs.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "kind"))).alias("j"))
    j = turns.join(per, ["session", "turn"], "left")
    return j.select("session", "turn", F.coalesce(F.transform("j", lambda x: x.dropFields("pos")), F.array()).alias("jobs"))


def reread_entry(written: Column, fields: dict[str, Column]) -> Column:
    """Whether a written reference gives its fields again when it is read: every non-blank value stands braced behind its name."""
    ok = F.lit(True)
    for name, value in fields.items():
        v = F.coalesce(F.trim(value.cast("string")), F.lit(""))
        back = F.regexp_extract(written, rf"(?m)^\s*{name}\s*=\s*\{{(.*)\}},?$", 1)
        ok = ok & F.when(v == "", back == "").otherwise(squeeze(back) == squeeze(v))
    return ok


def reference_entry(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    """A reference as text: kind, key and the fields that are not blank, in order."""
    lines = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"  {n} = {{"), squeeze(v.cast("string")), F.lit("}"))) for n, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), ",\n"), F.lit("\n}\n"))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with a block replaced that stands in it once, on lines of its own; null if it stands there never or several times."""
    padded, block = F.concat(F.lit("\n"), text, F.lit("\n")), F.concat(F.lit("\n"), old, F.lit("\n"))
    first = F.instr(padded, block)
    again = F.position(block, padded, first + 1)
    whole = F.concat(F.substring(padded, F.lit(1), first), new, F.substring(padded, first + F.length(old) + 1, F.length(padded)))
    return F.when((F.coalesce(old, F.lit("")) != "") & (first > 0) & (again == 0), F.substring(whole, F.lit(2), F.length(whole) - 2))


def guess_page(places: DataFrame, pages: DataFrame, sizes: tuple[int, ...] = (8, 5, 3), least: int = 12) -> DataFrame:
    """The page of each place by the words before and after it: id, page; none where no probe is on one page only.

    places: id, doc_id, before, after; pages: doc_id, page, text.  The longest
    probe that a single page of the document holds decides, the words before
    it first.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.regexp_replace(c, NO_WORDS, " ")), F.lit("[0-9a-zà-ÿ]+"), F.lit(0))
    flat = pages.select("doc_id", "page", F.array_join(words(F.col("text")), "").alias("flat"))
    pre = words(F.element_at(F.split("before", "\n\n"), -1))
    post = words(F.get(F.split("after", "\n\n"), F.lit(0)))
    probes = []
    for r, k in enumerate(sizes):
        probes.append(F.when(F.size(pre) >= k, F.struct(F.lit(2 * r).alias("rank"), F.array_join(F.slice(pre, F.size(pre) - k + 1, F.lit(k)), "").alias("probe"))))
        probes.append(F.when(F.size(post) >= k, F.struct(F.lit(2 * r + 1).alias("rank"), F.array_join(F.slice(post, F.lit(1), F.lit(k)), "").alias("probe"))))
    p = places.select("id", "doc_id", F.explode(F.filter(F.array(*probes), lambda x: x.isNotNull())).alias("p")).select("id", "doc_id", "p.*").where(F.length("probe") >= least)
    hits = p.join(flat, "doc_id").where(F.contains("flat", F.col("probe"))).groupBy("id", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"))
    return hits.where("n = 1").groupBy("id").agg(F.min_by("page", "rank").alias("page"))


