"""Queries on assembled documents, manifests and pages of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import assembly
from lectern.sources.tables import load, relation

from . import query
from .fixtures import MARKDOWN

#: Sections of the markdown fixture: headings, and plain lines as run-in ones; levels of every kind.
SECTIONS = f"""
select doc_id, i, 'h' || cast(i as string) as id, case when line like 'Plain%' then 'Plain ' || name when line like '#%' then trim(regexp_replace(line, '^#+', '')) else line end as text,
  case (doc_id + 5 * i) % 8 when 0 then 'drop' when 1 then 'merge-up' when 2 then 'italic' when 3 then 'skip' when 4 then '1' when 5 then '2' when 6 then '3' else '2' end as level,
  line like 'Plain%' as runin, case when line like 'Plain%' then 'body of ' || name || ' ![](pic.png) [1] first. [2] second' end as body
from ({MARKDOWN}) where line like '#%' or line like 'Plain%' or line like 'Keywords%'
"""
RENDERED = rf"""
md as ({MARKDOWN}), sec as ({SECTIONS}),
j as (select md.*, s.id, s.text, s.level, s.runin, s.body, last_value(s.level ignore nulls) over (partition by md.doc_id order by md.i) as near from md left join sec s using (doc_id, i)),
k as (select *, case when id is null then [line] when runin and level in ('merge-up', 'skip') then [line] when runin and level = 'italic' then ['*' || text || '.* ' || body]
  when runin then [repeat('#', level::int) || ' ' || text, '', body] when level = 'merge-up' then [] when level = 'italic' and text like 'Keywords:%' then ['*Keywords:* ' || trim(substr(text, 10))]
  when level = 'italic' then ['*' || text || '*'] when level = 'skip' then [text] else [repeat('#', level::int) || ' ' || text] end as lines, regexp_matches(level, '^[1-6]$') as head
  from j where coalesce(near <> 'drop', true)),
e as (select doc_id, i, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as sub, id, level, text, head from k),
f as (select doc_id, i, sub, line, case when head and sub = 0 then id end as id, case when head and sub = 0 then level end as level, case when sub = 0 then text end as text from e),
g as (select *, sum((id is not null and lower(text) = 'references')::int) over w as lists, last_value(case when id is not null then lower(text) = 'references' end ignore nulls) over w as own from f window w as (partition by doc_id order by i, sub)),
h as (select *, coalesce(lists = 1 and own, false) and id is null as inside from g),
p as (select doc_id, min(i) as i, trim(regexp_replace(regexp_replace(string_agg(trim(line), ' ' order by i, sub), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as flat from h where inside group by doc_id),
q as (select doc_id, i, list_filter(list_transform(string_split(regexp_replace(flat, '(\[[0-9]{{1,3}}\]\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as es from p),
added as (select doc_id, i, unnest(list_concat([''], flatten(list_transform(es, lambda x: [x, ''])))) as line, generate_subscripts(list_concat([''], flatten(list_transform(es, lambda x: [x, '']))), 1) - 1 as sub from q where len(es) >= 2),
u as (select doc_id, i, sub, line, id, level from h where not (inside and doc_id in (select doc_id from added)) union all select doc_id, i, sub, line, null, null from added),
r as (select doc_id, row_number() over (partition by doc_id order by i, sub) - 1 as out_line, regexp_replace(line, '(!\[[^\]]*\]\()([^)/]+\))', '\1images/\2', 'g') as line, id, level from u)
"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SECTIONS)


@query("rendered_lines", f"with {RENDERED} select doc_id, out_line::int as out_line, line, id, level from r")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered from their sections (2.7.6)."""
    return assembly.render(relation(spark, sf_dir, MARKDOWN), _sections(spark, sf_dir))


@query("assembled_documents", f"with {RENDERED} select doc_id, string_agg(line, chr(10) order by out_line) || chr(10) as text from r group by doc_id")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rendered texts (2.2.1)."""
    return assembly.documents(rendered_lines(spark, sf_dir))


@query("assembled_sections", f"with {RENDERED} select doc_id, id, level::int as level, regexp_replace(line, '^#+ ', '') as text, out_line::int as out_line from r where id is not null")
def assembled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section map of the rendered texts (2.2.1)."""
    return assembly.section_map(rendered_lines(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    known = F.col("i") % 3 != 0
    return s.select(
        "doc_id", "id", "text", F.when(known, F.col("level")).alias("level"), F.when(F.col("i") % 2 == 0, F.lit("4")).alias("auto_level"), F.lit(None).cast("int").alias("marker_level"),
        F.when(F.col("i") % 4 == 1, F.lit(False)).alias("translate"), "runin", "body", "i",
    )


@query("manifest_sections", f"""
with s as (select *, case when i % 3 <> 0 then level end as lv, case when i % 2 = 0 then '4' end as al from ({SECTIONS})),
t as (select *, coalesce(lv, '2') as l, text like 'Keywords:%' and regexp_matches(coalesce(lv, '2'), '^[1-6]$') and coalesce(al, lv, '2') = coalesce(lv, '2') as old from s)
select doc_id, id, text, case when i % 5 = 0 then -1 else i end as line, case when old then 'italic' else l end as level, case when old then 'italic' else coalesce(al, l) end as auto_level,
  2 as marker_level, i % 4 <> 1 as translate, runin, body from t
""")
def manifest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sections with their defaults and lines (2.1.12)."""
    s = _stored(spark, sf_dir)
    return assembly.anchored(s.drop("i"), s.where("i % 5 <> 0").select("doc_id", "id", F.col("i").alias("line")))


@query("manifest_round_trip", f"select doc_id, id, text, level, runin, body from ({SECTIONS})")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections written to one text a document and read again (2.2.2, 2.1.12)."""
    s = _sections(spark, sf_dir).select("doc_id", "id", "text", F.col("i").alias("line"), "level", F.lit(2).alias("marker_level"), F.col("level").alias("auto_level"), F.lit(True).alias("translate"), "runin", "body")
    back = assembly.loaded(assembly.stored(s))
    return back.select("doc_id", "id", "text", "level", F.coalesce("runin", F.lit(False)).alias("runin"), "body")


@query("run_in_decisions", f"""
with s as (select *, (i % 6) + 1 as dl from ({SECTIONS})),
c as (select doc_id, i as pos, case when runin then null else 3 end as level, i % 2 = 0 as open, doc_id % 3 <> 0 as decided, dl % 2 = 0 as yes, dl from s)
select doc_id, pos, case when open and decided and yes and dl between 2 and 6 then dl when open and decided and not yes then null else level end::int as level from c
""")
def run_in_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels after a model's decisions on run-in headings (2.5.29)."""
    s = _sections(spark, sf_dir)
    level = (F.col("i") % 6 + 1).cast("int")
    c = s.select("doc_id", F.col("i").alias("pos"), F.when(~F.col("runin"), 3).alias("level"), (F.col("i") % 2 == 0).alias("open"))
    d = s.where("doc_id % 3 <> 0").select("doc_id", F.col("i").alias("pos"), (level % 2 == 0).alias("is_heading"), level.alias("level"))
    return assembly.run_in_decisions(c, d)


@query("heading_pages", rf"""
with s as (select doc_id, i, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as k from ({SECTIONS})),
p as (select doc_id, k, arg_max(i // 2 + 1, i) as page from s where i % 2 = 1 group by doc_id, k)
select s.doc_id, s.i, p.page::int as page from s left join p using (doc_id, k)
""")
def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of sections by the headings that were seen on them (2.5.13)."""
    s = _sections(spark, sf_dir).select("doc_id", "i", "text")
    found = s.where("i % 2 = 1").select("doc_id", F.col("i").alias("pos"), F.upper("text").alias("text"), F.floor(F.col("i") / 2 + 1).cast("int").alias("page"))
    return assembly.heading_pages(s, found).select("doc_id", "i", "page")


_PAGES = f"select doc_id, cast(floor(i / 2) + 1 as int) as page, i, line from ({MARKDOWN})"


@query("section_pages", rf"""
with pages as (select doc_id, page, regexp_replace(lower(regexp_replace(string_agg(line, ' ' order by i), '<[^>]+>', '', 'g')), '[^0-9a-z]+', '', 'g') as flat from ({_PAGES}) group by doc_id, page),
n as (select *, row_number() over (partition by doc_id order by i) as n from ({SECTIONS}) where not runin),
s as (select doc_id, i as pos, case when n % 2 = 0 then cast(floor(i / 2) + 1 as int) end as page, regexp_replace(lower(regexp_replace(text, '<[^>]+>', '', 'g')), '[^0-9a-z]+', '', 'g') as title from n),
b as (select *, coalesce(last_value(page ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 1) as low,
  first_value(page ignore nulls) over (partition by doc_id order by pos rows between 1 following and unbounded following) as high from s),
h as (select b.doc_id, b.pos, min(p.page) as hit from b join pages p on b.doc_id = p.doc_id and b.page is null and length(title) >= 4 and p.page >= low and (high is null or p.page <= high) and contains(flat, title) group by all)
select b.doc_id, b.pos, coalesce(b.page, h.hit)::int as page from b left join h using (doc_id, pos)
""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all sections, looked for where they are not known (2.14.15)."""
    s = _sections(spark, sf_dir).where("not runin").withColumn("n", F.row_number().over(assembly.in_order("doc_id")))
    s = s.select("doc_id", F.col("i").alias("pos"), "text", F.when(F.col("n") % 2 == 0, F.floor(F.col("i") / 2 + 1).cast("int")).alias("page"))
    lines = relation(spark, sf_dir, _PAGES).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return assembly.section_pages(s, lines.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text")))


@query("linked_documents", """
with o as (select o_orderkey as doc_id from orders),
r as (select doc_id, unnest([0, 1, 2, 3]) as i, 0 as sub, unnest(['see [1] and [2] and [1](x)', 'not ![3] or [9]', '# References', 'old list']) as line from o)
select doc_id, i, sub, case i when 0 then case when doc_id % 2 = 0 then 'see [[1]](u1) and [2] and [1](x)' else 'see [[1]](u1) and [[2]](u2) and [1](x)' end else line end as line from r where i < 3
union all select doc_id, 3, unnest([0, 1]), unnest(['[1] new one', '[2] new two']) from o
""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations linked outside the list of references, and the list itself replaced (2.14.18)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    texts = lambda *t: F.array(*[F.lit(x) for x in t])
    rows = o.select("doc_id", F.posexplode(texts("see [1] and [2] and [1](x)", "not ![3] or [9]", "# References", "old list")).alias("i", "line"))
    links = o.select("doc_id", F.lit("1").alias("label"), F.lit("u1").alias("url")).unionByName(o.where("doc_id % 2 = 1").select("doc_id", F.lit("2").alias("label"), F.lit("u2").alias("url")))
    lists = o.select("doc_id", F.posexplode(texts("[1] new one", "[2] new two")).alias("pos", "line"))
    return assembly.linked(rows, o.select("doc_id", F.lit(3).alias("start"), F.lit(4).alias("until")), links, lists)
