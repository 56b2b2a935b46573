"""Annotations and operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import dice, script_ratio
from lectern.session import materialize

MOST_OPS = 5000


def latest_ops(ops: DataFrame, applied: Column | None = None, by: str = "doc_id") -> DataFrame:
    """Valid put and del operations newer than the high-water mark, of the last MOST_OPS of each log (by `pos`)."""
    w = Window.partitionBy(by).orderBy(F.desc("pos"))
    recent = ops.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_OPS).drop("_n")
    valid = F.col("op").isin("put", "del") & F.col("ts").isNotNull()
    return recent.where(valid if applied is None else valid & (F.col("ts") > applied))


def fold(ops: DataFrame, items: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """State after a log: (by), id, item, created, updated.

    Operations apply by ts, ties in log order.  The last one decides whether
    an id is there; `created` is that of the first put since the last del, or
    of the item that was there before.  ops: by, pos, ts, op, id, item;
    items: by, id, item, created.
    """
    o = ops.select(by, "id", "ts", "pos", "op", "item", F.col("ts").alias("made"))
    if items is not None:
        first = items.select(by, "id", F.lit(None).cast(dict(o.dtypes)["ts"]).alias("ts"), F.lit(-1).cast(dict(o.dtypes)["pos"]).alias("pos"), F.lit("put").alias("op"), "item", F.col("created").alias("made"))
        o = o.unionByName(first)
    key = F.struct(F.coalesce("ts", F.lit(None)), "pos")
    w = Window.partitionBy(by, "id")
    gone = F.max(F.when(F.col("op") == "del", key)).over(w)
    o = o.withColumn("_gone", gone).where((F.col("op") == "put") & (F.col("_gone").isNull() | (key > F.col("_gone"))))
    g = o.groupBy(by, "id").agg(F.max_by("item", key).alias("item"), F.min_by("made", key).alias("created"), F.max("ts").alias("updated"))
    return g


def document_order(anchors: Column) -> Column:
    """Row and start of the original's anchor, else of the first."""
    first = F.get(anchors, F.lit(0))
    original = F.coalesce(F.get(F.filter(anchors, lambda a: a["side"] == "en"), F.lit(0)), first)
    return F.struct(original["row"].alias("row"), original["start"].alias("start"))


def one_anchor_a_side(anchors: Column, most: int = 2) -> Column:
    """The first anchor of each side, at most two."""
    kept = F.filter(anchors, lambda a, i: ~F.exists(F.slice(anchors, F.lit(1), i), lambda b: b["side"] == a["side"]))
    return F.slice(kept, 1, most)


def window_turns(messages: DataFrame, turns: int = 8, full: int = 2, by: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Messages of the last `turns` user turns, with whether they are kept in full (the last `full` turns)."""
    w = Window.partitionBy(by).orderBy(pos)
    m = messages.withColumn("_t", F.sum((F.col("role") == "user").cast("int")).over(w))
    m = m.withColumn("back", F.max("_t").over(Window.partitionBy(by)) - F.col("_t"))
    return m.where(F.col("back") < turns).withColumn("in_full", F.col("back") < full).drop("_t")


def breaker(calls: DataFrame, trips: int = 3, by: str = "source", pos: str = "ts") -> DataFrame:
    """Add streak, the failures in a row up to each call, and whether the call trips the breaker.

    calls: by, ts, failed.  Runs of failures are islands between successes.
    """
    w = Window.partitionBy(by).orderBy(pos)
    c = calls.withColumn("_island", F.sum((~F.col("failed")).cast("int")).over(w))
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy(by, "_island").orderBy(pos))
    return c.withColumn("streak", streak).withColumn("trips", F.col("streak") == trips).drop("_island")


def plain_key(text: Column) -> Column:
    """Text without blanks, hyphens and dashes, quotes alike, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[\s\u00ad\u200b\-\u2010-\u2015\u2212]", ""), r"[\"'`‘’“”„′″]", "'"))


def reanchor(
    anchors: DataFrame, cells: DataFrame, spans: DataFrame | None = None, window: int | None = 25, least: float = 0.5, margin: float = 0.1, sure: float = 0.75, context: float = 0.25
) -> DataFrame:
    """Find lost quotes again: doc_id, id, row, start, end, score, sure; none where two places are too close.

    A cell that holds the normalised quote scores 1, nearest to the old row
    first.  Else spans of one to three sentences score by Dice of bigrams, a
    `context` part of it by what stands before and after where the anchor knows
    that.  Spans of a length or script unlike the quote's are none; the best
    must be `margin` above any that does not overlap it.  anchors: doc_id, id,
    quote, row, prefix, suffix; cells: doc_id, row, text; spans: doc_id, row, k,
    start, end of sentences (without them a cell is one).  Rows further than
    `window` are not looked at; None looks at the whole document.
    """
    blank = F.lit("")
    a = anchors.select(
        "doc_id", "id", F.col("row").alias("old"), plain_key(F.col("quote")).alias("q"),
        *[plain_key(F.coalesce(F.col(c), blank) if c in anchors.columns else blank).alias(n) for c, n in (("prefix", "pre"), ("suffix", "suf"))],
    ).where("length(q) >= 6")
    near = F.lit(True) if window is None else F.abs(F.col("row") - F.col("old")) <= window
    c = cells.select("doc_id", "row", "text", plain_key(F.col("text")).alias("t")).where("t <> ''")
    held = a.join(c, "doc_id").where(near & F.contains("t", F.col("q")))
    first = Window.partitionBy("doc_id", "id").orderBy(F.abs(F.col("row") - F.col("old")), "row")
    exact = held.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    none = F.lit(None).cast("int")
    exact = exact.select("doc_id", "id", "row", none.alias("start"), none.alias("end"), F.lit(1.0).alias("score"), F.lit(True).alias("sure"))

    rest = a.join(exact.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    if spans is None:
        spans = cells.select("doc_id", "row", F.lit(0).alias("k"), F.lit(0).alias("start"), F.length("text").alias("end"))
    after = Window.partitionBy("doc_id", "row").orderBy("k")
    ends = F.array(F.col("end"), F.lead("end", 1).over(after), F.lead("end", 2).over(after))
    runs = spans.select("doc_id", "row", "start", ends.alias("ends")).select("doc_id", "row", "start", F.explode("ends").alias("end")).where("end is not null")
    part = lambda x, y: plain_key(F.substring("text", x + 1, y - x))
    s, e = F.col("start"), F.col("end")
    runs = runs.join(cells.select("doc_id", "row", "text"), ["doc_id", "row"]).select(
        "doc_id", "row", "start", "end", part(s, e).alias("t"), part(F.greatest(s - 60, F.lit(0)), s).alias("before"), part(e, e + 60).alias("behind")
    )
    j = rest.join(runs, "doc_id").where(near & (F.length("t") <= F.length("q") * 2.5) & (F.length("t") * 2.5 >= F.length("q")))
    qs, ts = script_ratio(F.col("q")), script_ratio(F.col("t"))
    j = j.where((F.abs(qs - ts) <= 0.4) & ((qs > 0) == (ts > 0)))
    own, about = dice(F.col("q"), F.col("t")), dice(F.concat("pre", F.lit("\x00"), "suf"), F.concat("before", F.lit("\x00"), "behind"))
    score = F.when(F.length("pre") + F.length("suf") >= 6, (1 - context) * own + context * about).otherwise(own)
    j = materialize(j.select("doc_id", "id", "row", "start", "end", score.alias("score")), "anchors")
    best = j.groupBy("doc_id", "id").agg(F.min(F.struct(-F.col("score"), "row", "start", "end")).alias("b")).select("doc_id", "id", F.col("b.row").alias("r"), F.col("b.start").alias("s"), F.col("b.end").alias("e"), (-F.col("b.col1")).alias("top"))
    rival = j.join(best, ["doc_id", "id"]).where(~((F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))))
    second = rival.groupBy("doc_id", "id").agg(F.max("score").alias("second"))
    ok = best.join(second, ["doc_id", "id"], "left").where((F.col("top") >= least) & (F.col("top") - F.coalesce("second", F.lit(0.0)) >= margin))
    return exact.unionByName(ok.select("doc_id", "id", F.col("r").alias("row"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("top").alias("score"), (F.col("top") >= sure).alias("sure")))
