"""Libraries: collections as forests, memberships, listings, incremental publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize


def closure(collections: DataFrame) -> DataFrame:
    """Every collection with itself and all its ancestors: id, ancestor, depth (0 itself).

    collections: id and parent.  Unknown parents and cycles read as top level.
    Each round doubles the distance, so the rounds grow with the logarithm of
    the depth.
    """
    known = collections.select(F.col("id").alias("parent"))
    up = collections.where("parent is not null and parent <> id").join(known, "parent", "left_semi").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out, step = up, up
    while not step.isEmpty():
        a, b = out.alias("a"), step.alias("b")
        far = a.join(b, F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        more = materialize(out.unionByName(far).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        step = more.join(out, ["id", "ancestor"], "left_anti")
        out = more
    loops = out.where("id = ancestor").select("id")
    # A member of a cycle is cut from its parent; others keep what lies below the cut.
    cut = out.join(loops, "id", "left_anti")
    inside = cut.join(loops.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").groupBy("id").agg(F.min("depth").alias("d"))
    cut = cut.join(inside, "id", "left").where("d is null or depth <= d").drop("d")
    return collections.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(cut)


def inherited(collections: DataFrame, value: str) -> DataFrame:
    """Nearest set value of a collection or its ancestors: id, value; unset stays null, false is set."""
    v = closure(collections).join(collections.select(F.col("id").alias("ancestor"), F.col(value).alias("v")), "ancestor")
    set_ = F.col("v").isNotNull()
    return v.groupBy("id").agg(F.min_by(F.when(set_, F.col("v")), F.when(set_, F.col("depth"))).alias("value"))


def depth_first(collections: DataFrame) -> DataFrame:
    """Order of a tree view: id, depth, place; children below their parent in order of creation (`ord`)."""
    path = closure(collections).join(collections.select(F.col("id").alias("ancestor"), "ord"), "ancestor")
    keys = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("depth"), F.lpad(F.col("ord").cast("string"), 12, "0")))), lambda x: x["col2"])
    tree = path.groupBy("id").agg(F.max("depth").alias("depth"), F.array_join(keys, "/").alias("path"))
    return tree.select("id", "depth", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path")).alias("place"))


def path_names(collections: DataFrame, sep: str = " / ") -> DataFrame:
    """Names from the top down: id, path."""
    p = closure(collections).join(collections.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    names = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("depth"), F.col("name")))), lambda x: x["name"])
    return p.groupBy("id").agg(F.array_join(names, sep).alias("path"))


def subtree_counts(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """Distinct documents in each collection and everything below it: id, n."""
    inside = memberships.join(closure(collections), "id").select("doc_id", F.col("ancestor").alias("id"))
    n = inside.groupBy("id").agg(F.countDistinct("doc_id").alias("n"))
    return collections.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def counts(docs: DataFrame, memberships: str = "projects") -> DataFrame:
    """Documents in each collection, those in none, and all: project, n."""
    per = docs.select("doc_id", F.explode_outer(F.array_distinct(memberships)).alias("project"))
    named = F.when(F.grouping("project") == 1, "(all)").otherwise(F.coalesce("project", F.lit("(none)")))
    return per.rollup("project").agg(named.alias("name"), F.countDistinct("doc_id").alias("n")).select(F.col("name").alias("project"), "n")


def listing(docs: DataFrame, query: str, fields: list[str], scope: DataFrame | None = None, hidden: bool = False) -> DataFrame:
    """Documents whose fields hold the query text, in a scope of ids, without hidden ones."""
    out = docs if hidden else docs.where(~F.coalesce("hidden", F.lit(False)))
    out = out if scope is None else out.join(scope, "doc_id", "left_semi")
    return out.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.lower())))


def page(docs: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Pinned documents first, newest pin first, then the given order; the first `limit` with their place."""
    by = [F.col("pinned_at").desc_nulls_last(), *order]
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by))
    return docs.orderBy(*by).limit(limit).withColumn("place", place)


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of old with those of new over them: key, fields and change (insert, update, same, keep)."""
    o, n = old.select(key, F.struct(*fields).alias("o")), new.select(key, F.struct(*fields).alias("n"))
    j = o.join(n, key, "full")
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "keep").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("update")
    return j.select(key, change.alias("change"), F.coalesce("n", "o").alias("r")).select(key, "change", "r.*")


def publish_plan(published: DataFrame, current: DataFrame, prune: bool = False) -> DataFrame:
    """What an incremental publish does with each key: upload, skip, keep or delete.  Both: key, hash."""
    j = published.select("key", F.col("hash").alias("p")).join(current.select("key", F.col("hash").alias("c")), "key", "full")
    gone = F.lit("delete" if prune else "keep")
    return j.select("key", F.when(F.col("c").isNull(), gone).when(F.col("c").eqNullSafe(F.col("p")), "skip").otherwise("upload").alias("action"))


def membership_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Places to write and to remove when memberships change.  Both: doc_id, place."""
    gone = old.distinct().join(new, ["doc_id", "place"], "left_anti").withColumn("action", F.lit("remove"))
    return gone.unionByName(new.distinct().join(old, ["doc_id", "place"], "left_anti").withColumn("action", F.lit("write")))


def export_targets(memberships: DataFrame, folders: DataFrame, common: str) -> DataFrame:
    """Distinct folders of each document's collections, in order; the common one where none has a folder."""
    j = memberships.join(folders.where("folder <> ''"), "id", "left")
    per = j.groupBy("doc_id", "folder").agg(F.min("pos").alias("pos"))
    any_ = F.count("folder").over(Window.partitionBy("doc_id"))
    per = per.withColumn("_n", any_).where("folder is not null or _n = 0").withColumn("folder", F.coalesce("folder", F.lit(common)))
    return per.select("doc_id", "folder", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("place"))


def known_memberships(ids: Column, known: Column) -> Column:
    """Ordered distinct ids that are known."""
    return F.filter(F.array_distinct(ids), lambda x: F.array_contains(known, x))


def one_per_identity(tabs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tabs, one a document: the first place, a path inside the workspace rather than the latest."""
    return tabs.groupBy(key).agg(F.min("pos").alias("pos"), F.max_by("path", F.struct("inside", "pos")).alias("path"))


def suffixed(names: DataFrame, by: str = "name", pos: str = "pos") -> DataFrame:
    """Make names unique: the second of a name gets `-2`, the third `-3`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    return names.withColumn("unique", F.when(n == 1, F.col(by)).otherwise(F.concat(F.col(by), F.lit("-"), n)))


def copies(originals: DataFrame, everything: DataFrame) -> DataFrame:
    """Other files with the bytes of an original: name, copy.  Both: name, digest; a digest that all share pairs originals only."""
    other = everything.select(F.col("name").alias("copy"), "digest")
    return originals.select("name", "digest").join(other, "digest").where("name <> copy").select("name", "copy")
