"""Incremental computation by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Units whose hash the cache lacks; both have doc_id and hash."""
    return units.join(cache.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_anti")


def lookup(units: DataFrame, pieces: DataFrame, cache: DataFrame) -> DataFrame:
    """Answer a unit from the cache, by its own hash or by all of its pieces: doc_id, unit, text (null on a miss).

    units: doc_id, unit, hash; pieces: doc_id, unit, pos, hash; cache: doc_id, hash, text.
    """
    c = cache.groupBy("doc_id", "hash").agg(F.max("text").alias("text"))
    whole = units.join(c, ["doc_id", "hash"], "left").select("doc_id", "unit", "text")
    p = pieces.join(c, ["doc_id", "hash"], "left")
    parts = p.groupBy("doc_id", "unit").agg(
        F.every(F.col("text").isNotNull()).alias("full"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("joined")
    )
    j = whole.join(parts, ["doc_id", "unit"], "left")
    return j.select("doc_id", "unit", F.coalesce("text", F.when(F.col("full"), F.col("joined"))).alias("text"))


def live(cache: DataFrame, fresh: DataFrame, units: DataFrame) -> DataFrame:
    """The next cache: fresh texts over cached ones, only hashes that units still have."""
    both = cache.select("doc_id", "hash", "text", F.lit(0).alias("age")).unionByName(fresh.select("doc_id", "hash", "text", F.lit(1).alias("age")))
    newest = both.groupBy("doc_id", "hash").agg(F.max_by("text", "age").alias("text"))
    return newest.join(units.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_semi")


def stages(inputs: DataFrame, status: DataFrame) -> DataFrame:
    """Stages to run: doc_id, k and fresh; a stage is fresh if it is done with the same input and all before it are.

    inputs: doc_id, k, hash; status: doc_id, k, hash, done.
    """
    from pyspark.sql import Window

    s = status.select("doc_id", "k", F.col("hash").alias("h"), "done")
    j = inputs.join(s, ["doc_id", "k"], "left")
    own = F.coalesce(F.col("hash").eqNullSafe(F.col("h")) & F.col("done"), F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("doc_id", "k", F.every(own).over(w).alias("fresh"))


def complete(status: DataFrame, done: DataFrame) -> DataFrame:
    """Record finished stages; records of later stages of the same document go."""
    cut = done.groupBy("doc_id").agg(F.min("k").alias("cut"))
    rest = status.join(cut, "doc_id", "left").where("cut is null or k < cut").drop("cut")
    return rest.unionByName(done.select(status.columns))


def batch_plan(docs: DataFrame) -> DataFrame:
    """How many documents, units and characters each kind of work holds.

    docs: doc_id, excluded, translated, units, stale, chars: skipped if
    excluded, fresh if nothing is translated yet, full if all is stale, stale
    if some is, else current.
    """
    kind = (
        F.when(F.col("excluded"), "skipped").when(~F.col("translated"), "fresh").when(F.col("stale") == F.col("units"), "full")
        .when(F.col("stale") > 0, "stale").otherwise("current")
    )
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("docs"), F.sum("units").alias("units"), F.sum("chars").alias("chars"))
