"""Lexical search: postings, BM25, retrieval."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import DENSE, bigrams, exploded_tokens, token_of_word, tokens
from lectern.session import materialize

K1, B, REPEAT, TOP = 1.5, 0.75, 0.15, 8
#: Fixed value: words of a question about notes.
NOTE_HINT = r"(?i)메모|코멘트|하이라이트|표시|note|comment|highlight|annotat"


def terms(chunks: DataFrame, row: str, text: str = "text") -> DataFrame:
    """Every search token of every chunk: row, term.

    Words are exploded first and stemmed by plain columns after, which
    generated code covers; only runs of dense scripts go through an array of
    bigrams.
    """
    words = chunks.select(F.col(row).alias("row"), F.explode_outer(exploded_tokens(F.col(text))).alias("w"))
    dense = F.col("w").rlike(f"^{DENSE}$")
    plain = words.select("row", "w", F.when(~dense, token_of_word(F.col("w"))).alias("term"), dense.alias("dense"))
    pair = F.when(F.length("w") == 1, F.array("w")).otherwise(bigrams(F.col("w")))
    return plain.select("row", F.explode_outer(F.when(F.col("dense"), pair).otherwise(F.array("term"))).alias("term")).where("term is not null")


def postings(chunks: DataFrame, row: str, text: str = "text") -> DataFrame:
    """row, term, tf; chunks without tokens have none."""
    return terms(chunks, row, text).groupBy("row", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_index(chunks: DataFrame, row: str, text: str = "text", buckets: int = 16) -> dict:
    """Postings of a corpus, written once for many searches: {posts, lengths, n, avgdl}.

    posts (term, row, tf, len, bucket) is partitioned by a bucket of its term,
    so that a search reads only the buckets of its terms.
    """
    posts = materialize(postings(chunks, row, text), "postings")
    lengths = posts.groupBy("row").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).first()
    whole = posts.join(lengths, "row").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    return {"posts": materialize(whole, "index", by="bucket"), "buckets": buckets, "n": stats.n, "avgdl": stats.avgdl}


def search_index(index: dict, queries: DataFrame, by: str, k: int = TOP, digits: int | None = None) -> DataFrame:
    """The k best rows of each query over a built index: by, row, score, rank.

    queries: by, term, qn.  Only the buckets that hold a term of a query are read.
    """
    n = index["buckets"]
    asked = [r.b for r in queries.select(F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("b")).distinct().limit(n).collect()]
    posts = index["posts"].where(F.col("bucket").isin(asked) if len(asked) < n else F.lit(True))
    scores = bm25(posts.select("row", "len", "term", "tf"), queries, index, by)
    return top(scores if digits is None else scores.withColumn("score", F.round("score", digits)), k, by)


def query_terms(queries: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, term and how often the query has it."""
    return terms(queries, by, text).groupBy(F.col("row").alias(by), "term").agg(F.count(F.lit(1)).alias("qn"))


def bm25(posts: DataFrame, query: DataFrame, stats: dict, by: str | None = None) -> DataFrame:
    """Scores of all chunks that share a term with the query: (by,) row, score.

    query: (by,) term and qn, how often the query has it.  Without `by` it is
    one question, whose few terms are broadcast; a table of queries joins as
    Spark sees fit.  Document frequencies count only the terms asked for.
    """
    small = F.broadcast if by is None else (lambda x: x)
    asked = posts.join(small(query.select("term").distinct()), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = stats["n"] or 0, stats["avgdl"] or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = query.join(df, "term").withColumn("w", idf * (1 + REPEAT * (F.col("qn") - 1)))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avgdl)))
    keys = ["row"] if by is None else [by, "row"]
    return asked.join(small(q), "term").groupBy(*keys).agg(F.sum(part).alias("score")).where("score > 0")


def top(scores: DataFrame, k: int = TOP, by: str | None = None) -> DataFrame:
    """The k best rows, by score and then row."""
    if by is None:
        return scores.orderBy(F.desc("score"), "row").limit(k)
    w = Window.partitionBy(by).orderBy(F.desc("score"), "row")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(chunks: DataFrame, question: list[str], row: str, text: str = "text", k: int = TOP, digits: int | None = None) -> DataFrame:
    """The k best chunks for the tokens of one question: row, score.

    The corpus is tokenised once: each chunk keeps how often it has the tokens
    asked for and how many others, from which document frequencies, the
    average length and the scores follow.
    """
    wanted = Counter(question)
    kept = F.when(F.col("term").isin(list(wanted)), F.col("term"))
    small = materialize(terms(chunks, row, text).groupBy("row", kept.alias("term")).agg(F.count(F.lit(1)).alias("tf")), "search")
    lengths = small.groupBy("row").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).first().asDict()
    posts = small.where("term is not null").join(lengths, "row")
    query = chunks.sparkSession.createDataFrame(list(wanted.items()), "term string, qn long")
    scores = bm25(posts, query, stats)
    return top(scores if digits is None else scores.withColumn("score", F.round("score", digits)), k)


def question_tokens(spark: SparkSession, question: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(question)).alias("t")).first().t


def retrieve(chunks: DataFrame, ranked: DataFrame, notes: DataFrame, question: str, k: int = TOP) -> DataFrame:
    """Rows for an answer, in order: rows with notes first if the question asks for notes, else by rank.

    Without any hit the first three searchable rows.  chunks: row, searchable;
    ranked: row, score; notes: row.  Only the best k and the rows with notes
    are ordered.
    """
    best = ranked.orderBy(F.desc("score"), "row").limit(k)
    hits = best.select("row", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "row")).alias("rank"))
    if search_notes(question):
        noted = notes.select("row").distinct()
        ranks = ranked.join(noted, "row", "left_semi").orderBy(F.desc("score"), "row").limit(k).select("row", "score")
        ranks = ranks.select("row", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "row")).alias("rank"), F.lit(0).alias("noted"))
        rest = noted.join(ranked.select("row"), "row", "left_anti").orderBy("row").limit(k).select("row", F.lit(None).cast("int").alias("rank"), F.lit(0).alias("noted"))
        others = hits.join(noted, "row", "left_anti").select("row", "rank", F.lit(1).alias("noted"))
        hits = ranks.unionByName(rest).unionByName(others)
    else:
        hits = hits.withColumn("noted", F.lit(1))
    spare = chunks.where("searchable").orderBy("row").limit(3).select("row", F.lit(2).alias("noted"), F.lit(None).cast("int").alias("rank"))
    both = hits.unionByName(spare.join(hits.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("noted", F.col("rank").asc_nulls_last(), "row"))
    return both.select("row", place.alias("place")).where(F.col("place") <= k)


def search_notes(question: str) -> bool:
    import re

    return bool(re.search(NOTE_HINT, question or ""))


def within_budget(rows: DataFrame, size: Column, budget: int, by: str, pos: str) -> DataFrame:
    """Leading rows whose running size stays within a budget."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def attach_notes(chunks: DataFrame, notes: DataFrame, probe: int = 40) -> DataFrame:
    """Give every note a row: its own if that exists, else the first whose text holds its quote, or the quote's start.

    chunks: doc_id, row, text; notes: doc_id, id, row, quote.  Only notes
    without their row look through their document's chunks.
    """
    flat = chunks.select("doc_id", F.col("row").alias("r"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("flat"))
    direct = notes.join(chunks.select("doc_id", "row"), ["doc_id", "row"], "left_semi").select("doc_id", "id", "row")
    lost = notes.join(direct.select("doc_id", "id"), ["doc_id", "id"], "left_anti").where("quote <> ''")
    near = lost.drop("row").join(flat, "doc_id").withColumn("rank", F.when(F.contains("flat", F.col("quote")), 0).when(F.contains("flat", F.substring("quote", 1, probe)), 1))
    found = near.where("rank is not null").groupBy("doc_id", "id").agg(F.min(F.struct("rank", "r")).alias("m")).select("doc_id", "id", F.col("m.r").alias("row"))
    return direct.unionByName(found)
