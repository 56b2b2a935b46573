"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import LETTERS, STOP_WORDS, consecutive
from lectern.operators import annotations, search
from lectern.sources.tables import load, relation

from . import query
from .fixtures import CALLS, OPS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(x: str) -> str:
    """The tokens of a text in DuckDB; the fixtures hold no script without blanks."""
    t = rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\[a-z]+', ' ', 'g'), '[*_#`>|~$\[\]()!{{}}\\/,;:\"''^=+<>&%@?]', ' ', 'g')"
    words = rf"list_transform(regexp_extract_all({t}, '[{LETTERS}][{LETTERS}\-.]*'), lambda w: regexp_replace(w, '^[.\-]+|[.\-]+$', '', 'g'))"
    return (
        f"list_transform(list_filter({words}, lambda w: w <> '' and w not in ({_STOP})), lambda w: "
        "case when length(w) > 5 and w like '%ing' then w[1:length(w) - 3] when length(w) > 4 and w like '%ed' then w[1:length(w) - 2] "
        "when length(w) > 3 and w like '%s' and w not like '%ss' then w[1:length(w) - 1] else w end)"
    )


_POSTS = f"""
toks as (select doc_id as row, {sql_tokens("text")} as t from documents),
posts as (select row, len(t) as len, unnest(t) as term from toks where len(t) > 0),
tf as (select row, len, term, count(*) as tf from posts group by all),
stats as (select count(*) as n, avg(len(t)) as avgdl from toks where len(t) > 0)
"""
_BM25 = f"""
with {_POSTS},
q as (select term, count(*) as qn from (select unnest({sql_tokens("text")}) as term from benchmark where item_id = 0) group by term),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
scored as (
  select row, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + 0.15 * (qn - 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 4) as score
  from tf join q using (term) join df using (term), stats group by row)
select row as doc_id, score from scored order by score desc, row limit 10
"""


@query("bm25_search", _BM25)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that fit the first benchmark item best (2.8.1, 2.6.6, 2.10.2)."""
    question = load(spark, sf_dir, "benchmark").where("item_id = 0").first().text
    found = search.search(load(spark, sf_dir, "documents"), search.question_tokens(spark, question), "doc_id", k=10, digits=4)
    return found.select(F.col("row").alias("doc_id"), "score")


@query("bm25_terms", f"with {_POSTS} select term, count(*) as df, sum(tf)::bigint as n from tf group by term")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and total frequencies of all terms (2.6.6)."""
    docs = load(spark, sf_dir, "documents")
    return search.postings(docs, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query("search_budget", """
with s as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as used from conversations)
select conv_id, turn, used::bigint as used from s where used <= 1500
""")
def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading turns of each conversation within a character budget (2.8.3, 2.14.16)."""
    return search.within_budget(load(spark, sf_dir, "conversations"), F.length("text"), 1500, "conv_id", "turn").select("conv_id", "turn", "used")


@query("retrieve", """
with r as (select doc_id as row, n_chars as score from documents),
noted as (select doc_id as row from labels where toxic = 1),
h as (select row_number() over (order by score desc, row) as rank, row from r),
j as (select coalesce(h.row, n.row) as row, case when n.row is null then 1 else 0 end as noted, rank from h full join noted n on h.row = n.row)
select row, row_number() over (order by noted, rank nulls last, row) as place from j qualify place <= 8
""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a question about notes: rows with notes come first (2.8.2, 2.4.14)."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    ranked = docs.select(F.col("doc_id").alias("row"), F.col("n_chars").alias("score"))
    notes = labels.where("toxic = 1").select(F.col("doc_id").alias("row"))
    chunks = docs.select(F.col("doc_id").alias("row"), F.lit(True).alias("searchable"))
    return search.retrieve(chunks, ranked, notes, "my notes, please")


_NOTES = """
select cast(floor(doc_id / 20) as bigint) as doc_id, doc_id as id, cast(case when doc_id % 3 = 0 then 100000000 else doc_id end as bigint) as row,
  trim(regexp_replace(substr(text, 5, 60), '[ \\t\\r\\n]+', ' ')) as quote
from documents
"""


@query("attach_notes", f"""
with c as (select cast(floor(doc_id / 20) as bigint) as doc_id, doc_id as row, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) as flat from documents),
notes as ({_NOTES.replace("' ')) as quote", "' ', 'g')) as quote")}),
direct as (select n.doc_id, n.id, n.row from notes n where exists (select 1 from c where c.doc_id = n.doc_id and c.row = n.row)),
lost as (select n.* from notes n where not exists (select 1 from c where c.doc_id = n.doc_id and c.row = n.row) and quote <> ''),
near as (select l.doc_id, l.id, case when contains(flat, quote) then 0 when contains(flat, substr(quote, 1, 40)) then 1 end as rank, c.row
         from lost l join c using (doc_id)),
best as (select doc_id, id, row from near where rank is not null qualify row_number() over (partition by doc_id, id order by rank, row) = 1)
select * from direct union all select * from best
""")
def attach_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes find their rows, by number or by quote (2.5.11)."""
    chunks = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("doc_id"), F.col("doc_id").alias("row"), "text")
    return search.attach_notes(chunks, relation(spark, sf_dir, _NOTES.replace("\\\\", "\\")))


@query("window_turns", """
with m as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as t from conversations),
b as (select conv_id, turn, max(t) over (partition by conv_id) - t as back from m)
select conv_id, turn, back::bigint as back, back < 1 as in_full from b where back < 2
""")
def window_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two user turns of each conversation, the last one in full (2.7.26, 2.6.19)."""
    return annotations.window_turns(load(spark, sf_dir, "conversations"), 2, 1).select("conv_id", "turn", "back", "in_full")


@query("op_log", f"""
with o as (select * from ({OPS}) where op in ('put', 'del')),
g as (select *, max(case when op = 'del' then struct_pack(ts := ts, pos := pos) end) over (partition by doc_id, id) as gone from o),
p as (select * from g where op = 'put' and (gone is null or struct_pack(ts := ts, pos := pos) > gone))
select doc_id, id, arg_max(item, struct_pack(ts := ts, pos := pos)) as item, count(*) as puts from p group by doc_id, id
""")
def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live items after a log of put and del operations (2.6.13, 2.12.1)."""
    ops = annotations.latest_ops(relation(spark, sf_dir, OPS))
    live = annotations.fold(ops)
    gone = ops.where("op = 'del'").groupBy("doc_id", "id").agg(F.max(F.struct("ts", "pos")).alias("g"))
    puts = ops.where("op = 'put'").join(gone, ["doc_id", "id"], "left").where(F.col("g").isNull() | (F.struct("ts", "pos") > F.col("g")))
    n = puts.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("puts"))
    return live.join(n, ["doc_id", "id"]).select("doc_id", "id", "item", "puts")


@query("circuit_breaker", f"""
with c as ({CALLS}),
i as (select *, sum((not failed)::int) over (partition by source order by ts) as island from c),
s as (select source, event_id, sum(failed::int) over (partition by source, island order by ts) as streak from i)
select source, event_id from s where streak = 3
""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that open a breaker: the third failure in a row (2.12.2)."""
    return annotations.breaker(relation(spark, sf_dir, CALLS)).where("trips and failed").select("source", "event_id")


@query("row_ranges", """
with r as (select distinct l_orderkey as doc_id, l_linenumber as row from lineitem),
g as (select *, row - row_number() over (partition by doc_id order by row) as island from r),
s as (select doc_id, island, min(row) as a, max(row) as b from g group by doc_id, island)
select doc_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as rows from s group by doc_id
""")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of each order as ranges (2.7.27)."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_linenumber").alias("r"))
    return rows.select("doc_id", consecutive(F.col("r")).alias("rows"))


@query("session_list", """
select conv_id, max(turn)::bigint as last_turn, count(*) as n, count(*) filter (role = 'user') as questions, arg_min(text, turn) as title from conversations group by conv_id
""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their size and first message (2.6.19)."""
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("questions"), F.min_by("text", "turn").alias("title")
    )
