"""Queries on lines, headings and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import hash_text, heading_key, plain_entities, running_signature, sentences, squeeze, strip_tags
from lectern.operators import headings, lines
from lectern.sources.tables import load, relation

from . import query
from .fixtures import HEADINGS

_SQ = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_LINES = "lines as (select doc_id, source, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) - 1 as i from documents)"
_UN = ", ".join(f"'{x}'" for x in headings.UNNUMBERED)
_AR, _RO, _LE = (p.replace("'", "''") for p in (headings.ARABIC, headings.ROMAN, headings.LETTER))
_ROMAN_OK = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
RELEVEL = f"""
h as (select doc_id, pos, text, trim(text) as t from ({HEADINGS.replace(" as string)", " as varchar)")})),
s as (select *, case when regexp_matches(t, '{_AR}') then 'dotted-arabic'
   when regexp_matches(t, '{_RO}') and regexp_matches(regexp_extract(t, '{_RO}', 1), '{_ROMAN_OK}') then 'roman'
   when regexp_matches(t, '{_LE}') then 'letter'
   when lower(trim(regexp_replace(t, '[:\\-–—]+\\s*$', ''))) in ({_UN}) or regexp_matches(lower(trim(regexp_replace(t, '[:\\-–—]+\\s*$', ''))), '^appendix(\\s|$)') then 'unnumbered'
   else 'none' end as scheme from h),
d as (select *, case scheme when 'dotted-arabic' then regexp_extract(t, '{_AR}', 1) when 'roman' then regexp_extract(t, '{_RO}', 1)
   when 'letter' then regexp_extract(t, '{_LE}', 1) || case when regexp_extract(t, '{_LE}', 3) <> '' then '.' || regexp_extract(t, '{_LE}', 3) else '' end else '' end as number,
   case scheme when 'dotted-arabic' then trim(regexp_extract(t, '{_AR}', 3)) when 'roman' then trim(regexp_extract(t, '{_RO}', 2)) when 'letter' then trim(regexp_extract(t, '{_LE}', 5)) else t end as title from s),
e as (select *, (case when scheme in ('dotted-arabic', 'letter') then 1 + length(number) - length(replace(number, '.', '')) else 1 end)::int as depth from d),
m as (select *, case when bool_or(scheme = 'roman') over w and (bool_or(scheme = 'letter') over w or bool_or(scheme = 'dotted-arabic') over w) then 'roman-mixed' else 'arabic' end as mode from e window w as (partition by doc_id)),
r as (select doc_id, pos, text, scheme, number, depth, title, mode, (case when scheme in ('unnumbered', 'none') then 1 when mode = 'roman-mixed' and scheme = 'roman' then 1
   when mode = 'roman-mixed' and scheme = 'letter' then least(depth + 1, 6) when mode = 'roman-mixed' then least(depth + 2, 6) else least(greatest(depth, 1), 6) end)::int as level,
   scheme = 'none' as needs_review from m)
"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.relevel(relation(spark, sf_dir, HEADINGS))


@query("relevel_headings", f"with {RELEVEL} select * from r")
def relevel_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, number, depth, mode and level of every heading (2.7.1, 2.6.8, 2.4.2)."""
    return _levels(spark, sf_dir)


@query("level_groups", f"""
with {RELEVEL}
select doc_id, scheme, depth, count(*) as n, array_to_string((list(title order by pos))[1:2], ' | ') as examples, case when min(level) = max(level) then min(level) end as level
from r group by doc_id, scheme, depth
""")
def level_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings grouped by scheme and depth (2.6.7)."""
    return headings.level_groups(_levels(spark, sf_dir))


@query("section_tree", f"""
with {RELEVEL}
select a.doc_id, a.pos, a.level, max(b.pos) as parent from r a left join r b on a.doc_id = b.doc_id and b.pos < a.pos and b.level < a.level group by a.doc_id, a.pos, a.level
""")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent of every heading (2.8.7)."""
    return headings.parents(_levels(spark, sf_dir)).select("doc_id", "pos", "level", "parent")


@query("section_regions", f"""
with {RELEVEL}
select doc_id, pos, coalesce(lead(pos) over (partition by doc_id order by pos), 8) as until from r
""")
def section_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every section ends (2.7.21)."""
    return headings.regions(_levels(spark, sf_dir), F.lit(8)).select("doc_id", "pos", "until")


@query("guess_title", f"""
with {RELEVEL},
p as (select *, length(text) <= 140 and not regexp_matches(text, '[.;]\\s*$') and lower(trim(text)) not in ({_UN}) as ok from r)
select doc_id, coalesce(arg_min(text, pos) filter (ok and level = 1), arg_min(text, pos) filter (ok), arg_min(text, pos)) as title from p group by doc_id
""")
def guess_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every document (2.7.5, 2.4.4)."""
    return headings.guess_title(_levels(spark, sf_dir))


@query("run_in_levels", f"""
with {RELEVEL},
x as (select doc_id, pos, case when scheme <> 'none' then level end as l from r),
y as (select *, last_value(l ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from x)
select doc_id, pos, coalesce(l, least(before + 1, 6), 1)::int as level from y
""")
def run_in_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of headings without a number, from those before (2.7.2)."""
    df = _levels(spark, sf_dir).withColumn("level", F.when(F.col("scheme") != "none", F.col("level")))
    return headings.run_in_levels(df).select("doc_id", "pos", "level")


@query("inherit_levels", f"""
with {RELEVEL},
k as (select *, lower({_SQ.format("regexp_replace(text, '^[\\s0-9.):(\\-]+', '')")}) as key from r),
o as (select doc_id, key, arg_min(struct_pack(level := case when pos % 2 = 0 then 5 else level end, auto := level), pos) as o from k group by doc_id, key)
select k.doc_id, k.pos, (case when o.o.level <> o.o.auto then o.o.level else k.level end)::int as level from k left join o on k.doc_id = o.doc_id and k.key = o.key
""")
def inherit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of an older version carried over by heading key (2.5.28, 2.9.7)."""
    new = _levels(spark, sf_dir)
    old = new.withColumn("auto_level", F.col("level")).withColumn("level", F.when(F.col("pos") % 2 == 0, 5).otherwise(F.col("level")))
    return headings.inherit(new, old).select("doc_id", "pos", F.col("level").cast("int").alias("level"))


@query("document_lines", f"with {_LINES} select doc_id, i::int as i, length(line)::int as n from lines")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document (2.7.9)."""
    return lines.lines(load(spark, sf_dir, "documents")).select("doc_id", "i", F.length("line").alias("n"))


@query("paragraph_blocks", f"""
with {_LINES},
b as (select *, trim(line) = '' as blank from lines),
s as (select *, (not blank and coalesce(lag(blank) over (partition by doc_id order by i), true))::int as opens from b),
g as (select *, sum(opens) over (partition by doc_id order by i) as block from s)
select doc_id, block::bigint as block, min(i)::int as first, string_agg(line, chr(10) order by i) as text from g where not blank group by doc_id, block
""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines (2.7.9)."""
    return lines.paragraphs(lines.lines(load(spark, sf_dir, "documents"))).select("doc_id", "block", "first", "text")


@query("running_heads", f"""
with {_LINES},
s as (select source, doc_id, regexp_replace(lower({_SQ.format("line")}), '[0-9]+', '#', 'g') as sig from lines)
select source, sig, count(distinct doc_id) as pages, count(*) as n from s where length(sig) between 8 and 200 group by source, sig having count(distinct doc_id) >= 2
""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line signatures that several documents of a source share (2.6.10, 2.3.20)."""
    rows = lines.lines(load(spark, sf_dir, "documents")).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return lines.running_heads(rows, running_signature(F.col("line")), "source", "doc_id", 2)


@query("drop_running_heads", f"""
with {_LINES},
s as (select source, doc_id, i, regexp_replace(lower({_SQ.format("line")}), '[0-9]+', '#', 'g') as sig from lines),
h as (select source, sig from s where length(sig) between 8 and 200 group by source, sig having count(distinct doc_id) >= 3)
select doc_id, count(*) as n from s where not exists (select 1 from h where h.source = s.source and h.sig = s.sig) group by doc_id
""")
def drop_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in each document without its source's running heads (2.6.10)."""
    docs = load(spark, sf_dir, "documents")
    rows = lines.lines(docs).join(docs.select("doc_id", "source"), "doc_id")
    return lines.drop_running_heads(rows, running_signature(F.col("line")), "source", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("line_snippets", f"""
with {_LINES},
f as (select *, first_value(case when trim(line) <> '' then trim(line) end ignore nulls) over (partition by doc_id order by i rows between 1 following and unbounded following) as body from lines),
w as (select *, regexp_split_to_array(body, '[ \\t\\n\\r\\f\\v]+') as parts from f)
select doc_id, i::int as i, case when len(parts) > 10 then array_to_string(parts[1:10], ' ') || '…' else array_to_string(parts[1:10], ' ') end as snippet from w
""")
def line_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the next line with text (2.7.3)."""
    return lines.snippet(lines.lines(load(spark, sf_dir, "documents"))).select("doc_id", "i", "snippet")


@query("page_titles", """
select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', '', 'g')) as title,
  substr(sha256(html), 1, 16) as hash
from pages
""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, cleaned, and their content hash (2.3.1, 2.3.2, 2.10.1)."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", strip_tags(plain_entities(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title"), hash_text(F.col("html")).alias("hash"))


@query("plain_pages", """
with b as (select page_id, regexp_extract(html, '(?s)<body>(.*)</body>', 1) as body from pages)
select page_id, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as text from b
""")
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup (2.3.18, 2.3.8)."""
    body = F.regexp_extract("html", "(?s)<body>(.*)</body>", 1)
    return load(spark, sf_dir, "pages").select("page_id", squeeze(F.regexp_replace(body, "<[^>]+>", " ")).alias("text"))


@query("heading_keys", f"""
with {_LINES} select doc_id, i::int as i, lower({_SQ.format("regexp_replace(line, '^[\\s0-9.):(\\-]+', '')")}) as key from lines where trim(line) <> ''
""")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading keys of all lines (2.3.4, 2.3.6)."""
    return lines.lines(load(spark, sf_dir, "documents")).where(F.trim("line") != "").select("doc_id", "i", heading_key(F.col("line")).alias("key"))


@query("sentence_counts", """
select doc_id, (len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')))::int as n from documents
""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document (2.10.15)."""
    return load(spark, sf_dir, "documents").select("doc_id", F.size(sentences(F.col("text"))).alias("n"))


@query("shift_anchors", """
with a as (select l_orderkey as doc_id, l_linenumber as id, min(l_partkey) % 50 as line from lineitem group by l_orderkey, l_linenumber),
e as (select l_orderkey as doc_id, min(l_suppkey) % 40 as at, case when l_linenumber % 2 = 0 then 2 else -1 end as delta from lineitem group by l_orderkey, l_linenumber)
select a.doc_id, a.id, a.line, (a.line + coalesce(sum(case when e.at <= a.line then e.delta end), 0))::bigint as now from a left join e using (doc_id) group by a.doc_id, a.id, a.line
""")
def shift_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line anchors moved by edits above them (2.14.13)."""
    li = load(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id")).agg((F.min("l_partkey") % 50).alias("line"))
    e = li.groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg((F.min("l_suppkey") % 40).alias("at"))
    return lines.shift_anchors(a, e.select("doc_id", "at", F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(-1).alias("delta")))
