"""Queries on blocks, abstracts, captions and page regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import frontmatter, grids, lines
from lectern.sources.tables import load, relation

from . import query
from .fixtures import ITEMS


@query("abstracts", """
with b as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as block from documents),
t as (select doc_id, block, trim(text) as text from b),
p as (select *, not regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')
  and not (regexp_matches(text, '(?i)(university|institute|department|college|school|laborator|inc\\.|ltd|gmbh|research center)') and len(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) <= 25) as prose from t)
select doc_id, arg_max(text, struct_pack(n := length(text), f := -block)) filter (length(text) >= 150 and prose) as abstract from p group by doc_id
""")
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prose block of each document, its abstract where none is marked (2.7.20, 2.4.7, 2.4.8)."""
    b = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    return frontmatter.abstract(b)


@query("caption_lines", """
select p_partkey, '> **Figure ' || p_size || ':**' || case when p_size % 4 = 0 then '' else ' ' || p_name end as quote, '*Figure ' || p_size || case when p_size % 4 = 0 then '' else ': ' || p_name end || '*' as italic from part
""")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered captions (2.3.14)."""
    p = load(spark, sf_dir, "part")
    label, text = F.concat(F.lit("Figure "), "p_size"), F.when(F.col("p_size") % 4 != 0, F.col("p_name"))
    return p.select("p_partkey", frontmatter.caption_line(label, text, "blockquote").alias("quote"), frontmatter.caption_line(label, text, "italic").alias("italic"))


@query("export_links", """
select o_orderkey as doc_id, 'see [1](' || case when o_orderkey % 3 = 0 then '#ref-1' else 'https://doi.org/1' end || ') and [2](#ref-2)' as line from orders
""")
def export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation anchors turned into addresses where there are any (2.3.16)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = lines.lines(o.withColumn("text", F.lit("see [1](#ref-1) and [2](#ref-2)")))
    urls = o.select("doc_id", F.lit("1").alias("label"), F.when(F.col("doc_id") % 3 != 0, "https://doi.org/1").alias("url"))
    return frontmatter.export_lines(rows, urls, "links").select("doc_id", "line")


@query("page_regions", f"""
with recursive i as ({ITEMS}),
e as (select a.doc_id, a.page, a.unit as a, b.unit as b from i a join i b on a.doc_id = b.doc_id and a.page = b.page and a.l <= b.r + 2 and b.l <= a.r + 2 and a.t <= b.b + 2 and b.t <= a.b + 2),
r as (select doc_id, page, unit, unit as root from i union select r.doc_id, r.page, e.b, r.root from r join e on e.doc_id = r.doc_id and e.page = r.page and e.a = r.unit)
select doc_id, page, unit, min(root) as region from r group by doc_id, page, unit
""")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch, page by page (2.6.20, 2.7.25)."""
    return grids.regions(relation(spark, sf_dir, ITEMS))
