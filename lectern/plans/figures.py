"""Queries on captions, images and headings that are neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import front_label_parts
from lectern.operators import captions
from lectern.sources.tables import load, relation

from . import query
from .fixtures import MARKDOWN

MD = f"md as ({MARKDOWN})"
_T = "trim(regexp_replace(line, '<[^>]+>', '', 'g'))"
_WORDS = r"(Figure|Fig\.?|Table|Tab\.?)"
_CAP = rf"(?i)^\**\s*{_WORDS}\s+([0-9]+|[IVXLC]+)\**[.:]?\s*(.*)$"
_NUM = r"(?i)^(>\s*)?(\*\*|__)?\s*(Figure|Fig\.?|Table|Tab\.?|그림|표)\s*([0-9]+)(\*\*|__)?\s*[.:]"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, MARKDOWN)


@query("plain_headings", rf"""
with {MD}
select doc_id, i, case when regexp_matches(line, '^#{{1,6}}\s+[•·‣●▪◦∙・]\s+(\S.*)$') then '- ' || trim(regexp_extract(line, '^#{{1,6}}\s+[•·‣●▪◦∙・]\s+(\S.*)$', 1))
  when line like '# <i>Table IX%' then 'Table IX: ' || name else line end as line from md
""")
def plain_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that are list items or captions become such (2.3.19)."""
    return _rows(spark, sf_dir).select("doc_id", "i", captions.plain_headings(F.col("line")).alias("line"))


@query("caption_keys", rf"""
with {MD},
k as (select doc_id, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(line, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '\_', '_'), '\*', '*'), '\s+', ' ', 'g')) as key from md)
select doc_id, i, key, lower(regexp_replace(key, '[^0-9A-Za-z]+', '', 'g')) as match_key from k
""")
def caption_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by which captions are compared (2.3.3)."""
    line = F.col("line")
    return _rows(spark, sf_dir).select("doc_id", "i", captions.caption_key(line).alias("key"), captions.match_key(line).alias("match_key"))


@query("duplicate_captions", rf"""
with {MD},
n as (select *, lag(line, 1) over w as u1, lag(line, 2) over w as u2, lag(line, 3) over w as u3, lead(line, 1) over w as d1, lead(line, 2) over w as d2 from md window w as (partition by doc_id order by i)),
p as (select *, coalesce(trim(u1) = '', false) as gap from n where regexp_matches(trim(line), '^!\[[^\]]*\]\(([^)]+)\)\s*$')),
c as (select doc_id, i, gap, line, case when gap then u2 else u1 end as b, case when gap then u3 else u2 end as o, case when trim(d1) = '' then d2 else d1 end as a from p)
select doc_id, (i - 1 - gap::int)::int as first, (1 + gap::int)::int as lines, regexp_extract(line, '([^/()]+)\)\s*$', 1) as image from c
where (o is null or trim(o) = '') and nullif(regexp_extract(trim(regexp_replace(b, '<[^>]+>', '', 'g')), '{_NUM}', 4), '') = nullif(regexp_extract(trim(regexp_replace(a, '<[^>]+>', '', 'g')), '{_NUM}', 4), '')
""")
def duplicate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that are printed before and again after their image (2.5.3)."""
    return captions.duplicate_captions(_rows(spark, sf_dir), same_text=False)


@query("duplicate_captions_of_one_text")
def duplicate_captions_of_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose texts are the same but for formulas and spacing (2.4.16, 2.5.3); the lines that stay."""
    rows = _rows(spark, sf_dir)
    return captions.drop_lines(rows, captions.duplicate_captions(rows)).select("doc_id", "i", "line")


@query("table_captions", rf"""
with {MD},
n as (select *, last_value(case when trim(line) <> '' then line end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as above,
  first_value(case when trim(line) <> '' then line end ignore nulls) over (partition by doc_id order by i rows between 1 following and unbounded following) as below,
  lag(line) over (partition by doc_id order by i) as prev, {_T} as t from md)
select doc_id, i, case when lower(regexp_extract(t, '{_CAP}', 1)) like 'tab%' then 'Table ' else 'Figure ' end || regexp_extract(t, '{_CAP}', 2) as label, nullif(trim(regexp_extract(t, '{_CAP}', 3)), '') as caption
from n where regexp_matches(t, '{_CAP}') and (regexp_matches(t, '(?i){_WORDS}\s+([0-9]+|[IVXLC]+)\s*[.:]') or coalesce(regexp_matches(above, '^\s*\|.*\|\s*$'), false) or coalesce(regexp_matches(below, '^\s*\|.*\|\s*$'), false))
  and not coalesce(prev like '![%', false)
""")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that no image has taken (2.5.4)."""
    rows = _rows(spark, sf_dir)
    image = F.lag("line").over(captions.in_order("doc_id")).startswith("![")
    taken = rows.withColumn("taken", image).where("taken").select("doc_id", "i")
    return captions.table_captions(rows, taken)


_KEEP = ", ".join(f"'{x}'" for x in captions.SECTIONS)


@query("figure_text", rf"""
with {MD},
t as (select doc_id, i, line, trim(regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1)) as title, {_T} as t from md where trim(line) <> ''),
k as (select doc_id, i, regexp_matches(line, '^#{{1,6}}\s+') and not regexp_matches(title, '(?i)^\s*([0-9]|Part\b|Appendix\b|Chapter\b|Section\b)') and length(title) <= 60
    and lower(trim(regexp_replace(title, ':+$', ''))) not in ({_KEEP}) as maybe,
  line like '![%' or regexp_matches(t, '(?i)^(Figure|Fig\.?)\s+[0-9]') or regexp_matches(trim(line), '^\s*([-*+]\s+)?\(?[a-z]\)(\s|$)') as figure from t),
r as (select *, last_value(case when not maybe then figure end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before,
  lead(maybe) over (partition by doc_id order by i) as nm, lead(figure) over (partition by doc_id order by i) as nf from k)
select doc_id, i from r where maybe and (coalesce(before, false) or (not coalesce(nm, false) and coalesce(nf, false)))
""")
def figure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that are words inside figures (2.7.17)."""
    return captions.figure_text(_rows(spark, sf_dir))


@query("image_names", rf"""
with {MD}
select doc_id, i, case when line like '![x]%' then '![x](' || case when doc_id % 5 = 1 then 'one.png' else 'img-' || (doc_id % 5) || '.png' end || ')'
  when line like 'Keywords%' then 'Keywords: ' || name || ' ![y](why.png) ![z](d.png)' else line end as line from md
""")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images renamed and moved to one folder (2.3.17)."""
    names = F.create_map(F.lit("a/img-1.png"), F.lit("one.png"), F.lit("b.png"), F.lit("why.png"))
    return _rows(spark, sf_dir).select("doc_id", "i", captions.rename_images(F.col("line"), names).alias("line"))


@query("front_labels", rf"""
with {MD}
select doc_id, i, case when line like 'Keywords%' then 'Keywords:' else trim(line) end as label, case when line like 'Keywords%' then trim(substr(line, 10)) else '' end as rest from md
""")
def front_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before the first section, apart from what follows them (2.3.15, 2.4.1)."""
    parts = front_label_parts(F.col("line"))
    return _rows(spark, sf_dir).select("doc_id", "i", parts["label"].alias("label"), parts["rest"].alias("rest"))


@query("digest_copies", """
with d as (select doc_id, sha256(text) as digest from documents),
s as (select doc_id, digest from d where doc_id % 10 = 0)
select s.doc_id as source, d.doc_id as copy from s join d using (digest) where s.doc_id <> d.doc_id
""")
def digest_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-identical copies of a set of originals, by digest (2.5.25, 2.14.11)."""
    from lectern.operators import library

    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("digest"))
    return library.copies(d.where("name % 10 = 0"), d).select(F.col("name").alias("source"), "copy")
