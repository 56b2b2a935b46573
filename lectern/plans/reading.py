"""Queries on reading tools: outlines, ranges, composed search, answers, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clip, marked, note_tag, occurrences, script_ratio, token_of
from lectern.operators import reading, search
from lectern.sources.tables import load, relation

from . import query
from .assembling import SECTIONS
from .fixtures import MARKDOWN, REFS
from .search import sql_tokens

_LEVELS = f"select doc_id, i as pos, id, cast(level as int) as level, text from ({SECTIONS}) where level in ('1', '2', '3')"


@query("outlines", f"""
select doc_id, string_agg(repeat('  ', level - 1) || '- [r' || pos || '] ' || id || ' ' || text, chr(10) order by pos) as outline from ({_LEVELS}) group by doc_id
""")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each document as an indented list with rows and ids (2.15.7, 2.10.16)."""
    return reading.outline(relation(spark, sf_dir, _LEVELS))


_HEADS = f"select doc_id, i as row, text from ({SECTIONS}) where doc_id % 3 <> 0 or i % 2 = 0"


@query("section_ids", rf"""
with h as (select *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as k, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by row) as place from ({_HEADS})),
s as (select doc_id, i as pos, id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as k, count(*) over (partition by doc_id) as m, row_number() over (partition by doc_id order by i) as place from ({SECTIONS})),
h2 as (select *, row_number() over (partition by doc_id, k order by row) as nth from h), s2 as (select *, row_number() over (partition by doc_id, k order by pos) as nth from s)
select h2.doc_id, h2.row, s2.id from h2 join s2 on h2.doc_id = s2.doc_id and ((n = m and h2.place = s2.place) or (n <> m and h2.k = s2.k and h2.nth = s2.nth))
""")
def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the sections that heading rows start (2.15.7)."""
    return reading.section_ids(relation(spark, sf_dir, _HEADS), relation(spark, sf_dir, SECTIONS).select("doc_id", F.col("i").alias("pos"), "id", "text"))


@query("read_ranges", """
with a as (select distinct conv_id as ask, conv_id as doc_id, (conv_id % 5)::int as start, case when conv_id % 4 <> 0 then (conv_id % 7)::int end as until from conversations),
b as (select *, least(start, coalesce(until, start)) as low, greatest(start, coalesce(until, start)) as high from a)
select b.ask, c.turn as row, length(c.text) as n from b join conversations c on c.conv_id = b.doc_id and c.turn between low and least(high, low + 2)
""")
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of rows, three at most (2.15.7)."""
    c = load(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("ask"), F.col("conv_id").alias("doc_id")).distinct()
    a = a.select("ask", "doc_id", (F.col("ask") % 5).alias("start"), F.when(F.col("ask") % 4 != 0, F.col("ask") % 7).alias("until"))
    found = reading.read_range(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("row"), "text"), a, 3)
    return found.select("ask", "row", F.length("text").cast("bigint").alias("n"))


_QUESTIONS = "select item_id as question, case when item_id % 40 = 0 then 'my notes: ' || text else text end as text from benchmark where item_id % 20 = 0"
_NOTED = "select doc_id as row, doc_id as id, 'noted ' || text as text from labels join (select item_id, text from benchmark where item_id = 0) on true where toxic = 1"


@query("bm25_batch", f"""
with toks as (select doc_id as row, {sql_tokens("text")} as t from documents),
posts as (select row, len(t) as len, unnest(t) as term from toks where len(t) > 0),
tf as (select row, len, term, count(*) as tf from posts group by all),
stats as (select count(*) as n, avg(len(t)) as avgdl from toks where len(t) > 0),
q as (select question, term, count(*) as qn from (select item_id as question, unnest({sql_tokens("text")}) as term from benchmark where item_id % 20 = 0) group by all),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
scored as (select question, row, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + 0.15 * (qn - 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 4) as score
  from tf join q using (term) join df using (term), stats group by question, row)
select question, row, score, row_number() over (partition by question order by score desc, row)::int as rank from scored qualify rank <= 10
""")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every twentieth benchmark item, over one stored index (2.8.1, 2.6.6)."""
    index = search.build_index(load(spark, sf_dir, "documents"), "doc_id")
    asked = search.query_terms(load(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), "item_id").withColumnRenamed("item_id", "question")
    return search.search_index(index, asked, "question", 10, 4)


@query("search_paper", f"""
with notes as ({_NOTED}),
whole as (select d.doc_id as row, d.text as body, case when n.id is null then d.text else d.text || chr(10) || n.text end as text, case when n.id is null then [] else ['a' || n.id] end as notes from documents d left join notes n on n.row = d.doc_id),
toks as (select row, {sql_tokens("text")} as t from whole),
posts as (select row, len(t) as len, unnest(t) as term from toks where len(t) > 0),
tf as (select row, len, term, count(*) as tf from posts group by all),
stats as (select count(*) as n, avg(len(t)) as avgdl from toks where len(t) > 0),
qs as ({_QUESTIONS}),
q as (select question, term, count(*) as qn from (select question, unnest({sql_tokens("text")}) as term from qs) group by all),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
scored as (select question, row, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + 0.15 * (qn - 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 4) as score
  from tf join q using (term) join df using (term), stats group by question, row),
best as (select question, row, row_number() over (partition by question order by (question % 40 = 0 and len(notes) > 0) desc, score desc, row) as place, case when length(body) > 1200 then substr(body, 1, 1200) || '…' else body end as shown, notes from scored join whole using (row)
  qualify place <= 8),
used as (select *, sum(length(shown) + 2) over (partition by question order by place) as used from best)
select question, place::int as place, row, shown, array_to_string(notes, ' ') as notes from used where place = 1 or used <= 12000
""")
def search_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that answer every twentieth benchmark item, with their notes, in a budget (2.15.7, 2.8.2, 2.8.3)."""
    chunks = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text")
    first = load(spark, sf_dir, "benchmark").where("item_id = 0").select(F.concat(F.lit("noted "), "text").alias("text"))
    noted = load(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id")).join(F.broadcast(first))
    found = reading.search_paper(chunks, relation(spark, sf_dir, _QUESTIONS), noted, digits=4)
    return found.withColumn("notes", F.array_join("notes", " "))


@query("answer_citations", r"""
with o as (select o_orderkey as id from orders),
t as (select id, 'see [[r1]] and ' || case when id % 2 = 0 then '[[r2]]' else '' end || ' but , ' || case when id % 3 = 0 then '[[abcdef012345:r3]]' else '' end || ' ' || case when id % 5 = 0 then '[[a7]]' else '' end || ' . again [[r1]]' as text from o)
select id, trim(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,;:!?)])', '\1', 'g')) as text,
  '000000000000:1' || case when id % 2 = 0 then ' 000000000000:2' else '' end || case when id % 3 = 0 then ' abcdef012345:3' else '' end || case when id % 5 = 0 then ' a7' else '' end as cited from t
""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the markers that they may have, in order of first appearance (2.5.32)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    text = "see [[r1]] and [[ R2 ]] but [[r9]] , [[abcdef012345:r3]] [[a7]] [[anote]] . again [[000000000000 : r01]]"
    kinds = ((1, "000000000000:1"), (2, "000000000000:2"), (3, "abcdef012345:3"), (5, "a7"))
    refs = F.filter(F.array(*[F.when(F.col("id") % k == 0, F.lit(r)) for k, r in kinds]), lambda r: r.isNotNull())
    found = reading.resolve_citations(o.select("id", F.lit(text).alias("text"), F.lit("000000000000").alias("current")), o.select("id", F.explode(refs).alias("ref")))
    return found.withColumn("cited", F.array_join("cited", " "))


@query("note_tags", r"""
with p as (select p_partkey, case when p_partkey % 2 = 0 then 'n/' || p_brand else 'A ' || p_name end as id from part),
t as (select *, substr(regexp_replace(id, '[^A-Za-z0-9_.\-]', '', 'g'), 1, 64) as s from p)
select p_partkey, case when regexp_matches(s, '^[aA]') then s else 'a' || s end as tag, substr(sha1(id), 1, 12) as token from t
""")
def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of notes and documents (2.10.10)."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("n/"), "p_brand")).otherwise(F.concat(F.lit("A "), "p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", note_tag(name).alias("tag"), token_of(name).alias("token"))


_QUOTES = "select doc_id as id, doc_id, 0 as row, case when doc_id % 3 = 0 then 'never there' when doc_id % 3 = 1 then substr(text, 7, 40) else replace(substr(text, 7, 40), ' ', '   ') end as quote from documents"


@query("located_quotes", r"""
with q as (select doc_id as id, text, trim(substr(text, 7, 40), ' ') as f from documents where doc_id % 3 <> 0 and trim(substr(text, 7, 40), ' ') <> ''),
p as (select *, trim(regexp_replace(f, '\s+', ' ', 'g')) as flat from q),
l as (select *, regexp_extract(text, replace(regexp_replace(flat, '([\\^$.|?*+()\[\]{}])', '\\\1', 'g'), ' ', '\s+')) as loose from p)
select id, case when id % 3 = 1 then instr(text, f) - 1 else instr(text, loose) - 1 end::int as start, case when id % 3 = 1 then instr(text, f) - 1 + length(f) else instr(text, loose) - 1 + length(loose) end::int as "end"
from l where id % 3 = 1 or loose <> ''
""")
def located_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes found as they stand, or with any blanks between their words (2.10.11)."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("row"), "text")
    return reading.quote_rows(rows, relation(spark, sf_dir, _QUOTES))


@query("clipped_texts", r"""
with t as (select doc_id, text, length(text) as n, (length(text) * 2 // 3) as mid from documents),
a as (select *, greatest(0, least(mid - 130, n - 260)) as start from t),
b as (select *, least(n, start + 260) as stop, instr(substr(text, start + 1), ' ') as sp from a),
c as (select *, case when start > 0 and sp > 0 and sp - 1 < 20 then start + sp else start end as first from b),
d as (select *, substr(text, first + 1, stop - first) as tail from c),
e as (select *, case when stop < n and contains(tail, ' ') and first + length(tail) - instr(reverse(tail), ' ') > stop - 20 then first + length(tail) - instr(reverse(tail), ' ') else stop end as last from d)
select doc_id, case when n <= 260 then text else case when first > 0 then '…' else '' end || rtrim(substr(text, first + 1, last - first), ' ') || case when last < n then '…' else '' end end as text from e
""")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each text about a place in it (2.3.25)."""
    at = F.floor(F.length("text") * 2 / 3).cast("int")
    return load(spark, sf_dir, "documents").select("doc_id", clip(F.col("text"), at).alias("text"))


@query("marked_terms", """
select p_partkey, case when p_partkey % 2 = 0 then '«' || substr(p_name, 1, 2) || '»' || substr(p_name, 3, 2) || '«' || substr(p_name, 5, 1) || '»' || substr(p_name, 6) else p_name end as text from part where length(p_name) >= 6
""")
def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans marked in a text, overlapping ones left out (2.3.25)."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.when(F.col("p_partkey") % 2 == 0, F.array(span(4, 5), span(1, 3), span(0, 2))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return load(spark, sf_dir, "part").where("length(p_name) >= 6").select("p_partkey", marked(F.col("p_name"), spans).alias("text"))


@query("found_in_page", """
select page_id, ((length(html) - length(replace(lower(html), 'the', ''))) // 3)::int as n, case when contains(lower(html), 'the') then (instr(lower(html), 'the') - 1)::int end as first from pages
""")
def found_in_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a text in each page, whatever the case (2.16)."""
    found = load(spark, sf_dir, "pages").select("page_id", occurrences(F.col("html"), "THE").alias("at"))
    return found.select("page_id", F.size("at").alias("n"), F.get("at", F.lit(0)).cast("int").alias("first"))


@query("script_shares", r"""
select doc_id, lang, round(case when length(regexp_replace(text, '[\x00-\x2f]', '', 'g')) > 0 then length(regexp_replace(text, '[^à-ÿ]', '', 'g'))::double / length(regexp_replace(text, '[\x00-\x2f]', '', 'g')) else 0 end, 6) as share from documents
""")
def script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a script's letters in each text (2.16)."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang", F.round(script_ratio(F.col("text"), "à-ÿ"), 6).alias("share"))


@query("combined_notes", """
with t as (select conv_id as doc_id, turn as pos, role || turn as name, case when (conv_id + turn) % 3 = 0 then trim(text) else '' end as text from conversations),
g as (select doc_id, count(*) as tabs, count(*) filter (text <> '') as n, any_value(text) filter (text <> '') as one, string_agg('## ' || name || chr(10) || chr(10) || text, chr(10) || chr(10) order by pos) filter (text <> '') as many from t group by doc_id)
select doc_id, case when n = 1 then one else coalesce(many, '') end as text, tabs from g
""")
def combined_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes of a document as one text (2.1.17)."""
    text = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("text")).otherwise(" ")
    tabs = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat("role", "turn").alias("name"), text.alias("text"))
    return reading.combined_notes(tabs)


_MARKED = """
select l_orderkey as doc_id, l_linenumber as row, cast(min(l_partkey) as string) as id, cast(min(l_suppkey) % 9 as int) as start, min(l_shipmode) as note from
(select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity > 25 then 'look ' || l_returnflag else ' ' end as l_shipmode from lineitem) group by l_orderkey, l_linenumber
"""


@query("highlights_text", f"""
select doc_id, string_agg('> quote ' || id || chr(10) || '> more' || case when trim(note) <> '' then chr(10) || chr(10) || trim(note) else '' end, chr(10) || chr(10) order by row, start, id) as text, count(*) as n from ({_MARKED}) group by doc_id
""")
def highlights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights of a document as markdown, in its order (2.2.12)."""
    items = relation(spark, sf_dir, _MARKED).withColumn("quote", F.concat(F.lit("quote "), "id", F.lit("\nmore ")))
    return reading.highlights_text(items)


@query("citation_tooltips", f"""
with r as (select doc_id, label, author, year, case when label % 2 = 0 then 'T ' || label else '' end as title from ({REFS}))
select doc_id, label::varchar as label, author || case when title <> '' then '. ' || title else '' end || '. V, ' || year as text, case when label % 3 = 0 then 'u' || label else '' end as url from r
""")
def citation_tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a citation shows, by label (2.3.24)."""
    r = relation(spark, sf_dir, REFS)
    refs = r.select(
        "doc_id", F.col("label").cast("string").alias("label"), F.array("author").alias("authors"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("T "), "label")).otherwise("").alias("title"),
        F.lit("V").alias("venue"), "year", F.when(F.col("label") % 3 == 0, F.concat(F.lit("u"), "label")).alias("url"), F.lit(0).alias("pos"),
    )
    return reading.tooltips(refs).select("doc_id", F.explode("tips").alias("label", "tip")).select("doc_id", "label", "tip.text", "tip.url")


@query("reading_bundles", f"""
with m as (select doc_id, count(*) as n, string_agg(line, '|' order by i) as texts from ({MARKDOWN}) group by doc_id),
t as (select doc_id, count(*) as heads, string_agg(level || ':' || text, '|' order by pos) as toc from ({_LEVELS}) group by doc_id)
select m.doc_id, n::int as n, texts, coalesce(heads, 0)::int as heads, coalesce(toc, '') as toc from m left join t using (doc_id)
""")
def reading_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a reader of a document needs, in one row (2.2.9)."""
    md, heads = relation(spark, sf_dir, MARKDOWN), relation(spark, sf_dir, _LEVELS)
    refs = relation(spark, sf_dir, REFS).select("doc_id", F.col("label").cast("string").alias("label"), F.col("author").alias("text"))
    rows = md.select("doc_id", F.col("i").alias("row"), F.col("line").alias("original"), F.lit(None).cast("string").alias("translation"))
    b = reading.bundle(rows, heads.select("doc_id", F.col("pos").alias("row"), "level", "text"), refs).withColumn("toc", F.coalesce("toc", F.array()))
    return b.select(
        "doc_id", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["original"]), "|").alias("texts"), F.size("toc").alias("heads"),
        F.array_join(F.transform("toc", lambda r: F.concat_ws(":", r["level"], r["text"])), "|").alias("toc"),
    )
