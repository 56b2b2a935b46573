"""Queries on translation context, guarded writes, figures and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import citations, lines, writing
from lectern.sources.tables import load, relation

from . import query
from .fixtures import REFS


@query("context_tails", """
with b as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before from conversations),
c as (select *, substr(before, greatest(length(before) - 119, 1), 120) as cut from b)
select conv_id, turn, case when length(before) <= 120 then before when regexp_extract(cut, '(?s)[.!?]\\s+(.*)$', 1) <> '' then regexp_extract(cut, '(?s)[.!?]\\s+(.*)$', 1) else cut end as tail from c
""")
def context_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the turn before each turn (2.7.10)."""
    return writing.context_tail(load(spark, sf_dir, "conversations"), "conv_id", "turn", 120).select("conv_id", "turn", "tail")


@query("first_use", """
with u as (select l_orderkey as doc_id, l_linenumber as pos, string_agg(p_name || ' (' || p_brand || ')', '; ' order by p_name, p_brand) as text from lineitem join part on p_partkey = l_partkey group by all),
t as (select distinct l_orderkey as doc_id, p_name as term, p_name || ' (' || p_brand || ')' as gloss from lineitem join part on p_partkey = l_partkey)
select t.doc_id, term, gloss, min(pos) as first from t join u on t.doc_id = u.doc_id and contains(u.text, t.gloss) group by all
""")
def first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a gloss stands first in each document (2.7.11)."""
    j = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    gloss = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    units = j.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.array_join(F.array_sort(F.collect_list(gloss)), "; ").alias("text"))
    return writing.first_use(units, j.select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("term"), gloss.alias("gloss")).distinct())


@query("guarded_writes", """
with s as (select p_partkey as id, repeat(p_name, 3) as old, p_size as stamp from part where p_partkey % 7 <> 0),
w as (select p_partkey as id, case when p_size % 5 = 0 then '' when p_size % 5 = 1 then substr(p_name, 1, 2) else p_name || p_name || '!' end as text, case when p_partkey % 7 = 0 then null when p_size % 3 = 0 then 0 else p_size end as expect from part)
select w.id, case when not (expect is not distinct from stamp) then old else text end as text,
  case when not (expect is not distinct from stamp) then 'conflict' when text = '' then 'deleted' when coalesce(length(text) * 5 < length(old), false) then 'trashed' else 'written' end as outcome
from w left join s using (id)
""")
def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that land only on what they expect (2.2.13, 2.15.8)."""
    p = load(spark, sf_dir, "part")
    stored = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.repeat("p_name", 3).alias("text"), F.col("p_size").alias("stamp"))
    text = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, F.substring("p_name", 1, 2)).otherwise(F.concat("p_name", "p_name", F.lit("!")))
    expect = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size"))
    return writing.compare_and_set(stored, p.select(F.col("p_partkey").alias("id"), text.alias("text"), expect.alias("expect")))


@query("figure_references", """
with l as (select p_partkey as doc_id, 'See Figure ' || p_size || ', Table IV and Section IIX; Fig. ' || (p_size + 1) as line, p_size from part)
select doc_id, 'fig' as kind, p_size as number from l union all select doc_id, 'fig', p_size + 1 from l union all select doc_id, 'tab', 4 from l
""")
def figure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of figures and tables, roman numerals read (2.5.26, 2.10.8)."""
    text = F.concat(F.lit("See Figure "), "p_size", F.lit(", Table IV and Section IIX; Fig. "), F.col("p_size") + 1)
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("i"), text.alias("line"))
    return writing.figure_references(rows).select("doc_id", "kind", "number")


@query("attach_figures", """
select p_partkey as doc_id, case when p_size % 2 = 0 then 'a red thing | a blue thing' else 'a red thing' end as figures from part
""")
def attach_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of the images that a text shows, each once (2.5.12, 2.6.23)."""
    p = load(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    text = F.when(F.col("p_size") % 2 == 0, "![x](i/red.png#a) ![y](i/blue.png) ![](red.png)").otherwise("![x](red.png) text ![](other.png)")
    described = p.select("doc_id", F.explode(F.array(F.struct(F.lit("red.png").alias("name"), F.lit("a red thing").alias("text")), F.struct(F.lit("blue.png").alias("name"), F.lit("a blue thing").alias("text")))).alias("d"))
    found = writing.attach_figures(p.select("doc_id", F.lit(0).alias("row"), text.alias("text")), described.select("doc_id", "d.name", "d.text"))
    return found.select("doc_id", F.array_join("figures", " | ").alias("figures"))


@query("citation_labels", f"""
select doc_id, label, label || ', ' || 'Q' || (label % 7) || ', ' || year || case when label % 2 = 0 then ', S' || label else '' end as shown,
  case when label % 2 = 0 then 'S' || label else 'Q' || (label % 7) || ', ' || year end as short from ({REFS.replace(" as string)", " as varchar)")})
""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of citations from their chosen parts (2.3.13)."""
    r = relation(spark, sf_dir, REFS)
    both = citations.author_year(F.array(F.concat(F.lit("A Q"), F.col("label") % 7)), F.col("year"))
    short = F.when(F.col("label") % 2 == 0, F.concat(F.lit("S"), "label")).otherwise("")
    name = lambda parts: writing.citation_label(F.col("label").cast("string"), both, short, parts)
    return r.select("doc_id", "label", name(["number", "authoryear", "short"]).alias("shown"), name(["short"]).alias("short"))


@query("folder_names", """
select c_custkey, case when c_nationkey % 3 = 0 then '' else (1990 + c_nationkey)::varchar || case when c_nationkey % 2 = 0 then '_' else '' end end || case when c_nationkey % 2 = 0 then c_mktsegment else '' end || case when c_nationkey % 3 = 0 and c_nationkey % 2 <> 0 then 'Z' else '_Z' end as name,
  case when c_nationkey % 2 = 0 then 'pt-BR' else 'zh-Hant-TW' end as lang from customer
""")
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a template with empty parts, and normal language tags (2.3.11, 2.3.23)."""
    c = load(spark, sf_dir, "customer")
    year = F.when(F.col("c_nationkey") % 3 != 0, 1990 + F.col("c_nationkey"))
    title = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))
    lang = F.when(F.col("c_nationkey") % 2 == 0, "PT_br").otherwise("zh-hANT-tw")
    return c.select("c_custkey", writing.folder_name("{year}_{title}_{author}", {"year": year, "title": title, "author": F.lit("Z")}).alias("name"), writing.language_code(lang).alias("lang"))


@query("joined_lines", """
select doc_id, replace(text, chr(10), ' ') as text from (select doc_id, regexp_replace(regexp_replace(text, '\\n$', ''), '([A-Za-zÀ-ÿ])-\\n([a-zà-ÿ])', '\\1\\2', 'g') as text from documents)
""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document joined into one (2.3.22)."""
    rows = lines.lines(load(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return rows.select("doc_id", writing.join_lines(F.transform("l", lambda x: x["line"])).alias("text"))
