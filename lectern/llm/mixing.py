"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, words

#: Items folded in one block, and blocks' rows that one sort holds together.
BLOCK, BUCKET = 64, 1024
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, n, target.

    Sources in code-point order, null last, take the weights in turn.  Targets
    fill like water: `share` of all sizes by weight, each at most `most` times
    its source, the excess to the others by weight.  Windows run over sources,
    not documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(1))
    turn = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))
    by = by.withColumns({"_w": weight, "_cap": most * F.col("source_size")})
    by = by.withColumns({"_all": share * F.sum("source_size").over(one), "_fill": F.col("_cap") / F.col("_w")})
    before = one.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped, passed = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    by = by.withColumn("_level", (F.col("_all") - capped) / (F.sum("_w").over(one) - passed))
    return by.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(one) * F.col("_w"))).select("source", "source_size", "n", "target")


def _item(x: Column, mass: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), mass.alias("mass"))


def _done(x: Column, extra: int | Column) -> Column:
    extra = F.lit(extra) if isinstance(extra, int) else extra
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), extra.cast("int").alias("extra"))


def _settled(x: Column) -> Column:
    return (x["mass"] <= TINY) | (x["mass"] >= x["size"] - TINY)


def _fold(items: Column, level: int, seed: int) -> Column:
    """Fold a block of items into decisions and one residual: struct (carry, out).

    An item's mass is its size times its probability of one more copy.  A pair
    exchanges mass at random, expectations unchanged, until one of the two is
    empty or full; the other goes on.  So a block's mass is kept exactly.
    """
    none = F.lit(None).cast("struct<doc_id:bigint,size:bigint,mass:double>")
    empty = F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>")

    def step(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        mc, mx, room_c, room_x = c["mass"], x["mass"], c["size"] - c["mass"], x["size"] - x["mass"]
        up, down = F.least(room_c, mx), F.least(mc, room_x)
        u = F.pmod(F.xxhash64(c["doc_id"], x["doc_id"], F.lit(level), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
        rises = u * (up + down) < down

        def state(carry: Column, done: Column) -> Column:
            return F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(done)).alias("out"))

        return (
            F.when(_settled(x), state(c, _done(x, (x["mass"] > x["size"] / 2) & (x["size"] > 0))))
            .when(c.isNull(), F.struct(_item(x, mx).alias("carry"), acc["out"].alias("out")))
            .when(_settled(c), state(_item(x, mx), _done(c, mc > c["size"] / 2)))
            .when(rises & (room_c <= mx), state(_item(x, mx - room_c), _done(c, 1)))
            .when(rises, state(_item(c, mc + mx), _done(x, 0)))
            .when(mc <= room_x, state(_item(x, mx + mc), _done(c, 0)))
            .otherwise(state(_item(c, mc - room_x), _done(x, 1)))
        )

    return F.aggregate(items, F.struct(none.alias("carry"), empty.alias("out")), step)


def pivotal_rounding(items: DataFrame, seed: int = 7) -> DataFrame:
    """Round fractional copies within each group: items (source, doc_id, size, mass) to source, doc_id, size, extra (0 or 1).

    A reduction tree: blocks of at most BLOCK items fold to one residual each,
    residuals meet again in blocks, until one a group is left, which goes to
    the nearer side.  So a group's total differs from its mass by at most half
    of one item.  Larger items fold first, which leaves a small one last.
    Random numbers come from hashes, so reruns agree.  Groups are dealt over
    buckets by hash, so a group with a third of all rows is spread.
    """
    out, level = [], 0
    while True:
        level += 1
        counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s_")
        counts = materialize(counts, "mix-counts")
        last = (counts.agg(F.max("n")).first()[0] or 0) <= BLOCK
        if last:
            dealt = items.withColumns({"_bucket": F.lit(0), "_block": F.lit(0)})
        else:
            buckets = F.ceil(F.col("n") / BUCKET)
            dealt = join_small(items, counts, F.col("source").eqNullSafe(F.col("s_")), "inner").withColumn(
                "_bucket", F.pmod(F.xxhash64("doc_id", F.lit(level), F.lit(seed)), buckets)
            )
            place = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy(F.desc("size"), "doc_id"))
            dealt = dealt.withColumn("_block", F.floor((place - 1) / BLOCK))
        order = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "mass")
        folded = dealt.groupBy("source", "_bucket", "_block").agg(F.sort_array(F.collect_list(order)).alias("items"))
        folded = materialize(folded.select("source", _fold(F.col("items"), level, seed).alias("f")), "mix-level")
        out.append(folded.select("source", F.explode("f.out").alias("d")).select("source", "d.*"))
        left = folded.where("f.carry is not null").select("source", "f.carry.*")
        if last:
            return_ = left.select("source", "doc_id", "size", (F.col("mass") > F.col("size") / 2).cast("int").alias("extra"))
            for o in out:
                return_ = return_.unionByName(o)
            return return_
        items = left


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Copies of every row of docs so that sources meet their targets.

    Returns doc_id, source, size (words), source_size, target (of the source),
    copies and taken (size times copies).  A null or empty text has size zero
    and is taken zero words; a text of any length is one item; a null source is
    a source of its own; equal rows are rounded one by one, ties of size go by
    doc_id; without rows the result is empty; further columns are not read.  No
    document gets more than `most` copies.
    """
    sizes = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"))
    sizes = materialize(sizes, "sizes")
    by = materialize(source_targets(sizes, weights, share, most), "targets")
    by = by.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    by = by.select(F.col("source").alias("s_"), "source_size", "target", F.floor("_rate").alias("_whole"), (F.col("_rate") - F.floor("_rate")).alias("_part"))
    same = F.col("source").eqNullSafe(F.col("s_"))
    items = join_small(sizes, by, same, "inner").select("source", "doc_id", "size", (F.col("size") * F.col("_part")).alias("mass"))
    copies = join_small(pivotal_rounding(materialize(items, "mix-items"), seed), by, same, "inner").withColumn("copies", F.col("_whole") + F.col("extra"))
    return copies.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
