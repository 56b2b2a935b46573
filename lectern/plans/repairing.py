"""Queries on repairs of extracted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import layout, repair
from lectern.sources.tables import load, relation

from . import query
from .fixtures import ITEMS, MARKDOWN


def _texts(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Part names set into a text, as documents: doc_id and text."""
    text = F.concat(*[F.col("p_name") if p == "NAME" else F.lit(p) for p in parts])
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_size", text.alias("text"))


@query("footnoted_texts", """
select p_partkey as doc_id, '# T' || chr(10) || chr(10) || 'We use ' || p_name || ' <sup class="md-fn"><a href="#fn-1">1</a></sup>, see Figure 2 and 11,579 of [2]. Again ' || p_name || ' 1 and tools <sup class="md-fn"><a href="#fn-3">3</a></sup>.'
  || chr(10) || chr(10) || 'Body ends.' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || 'A 2' || chr(10) || chr(10) || '## Footnotes' || chr(10) || chr(10)
  || '<a id="fn-1"></a>**1.** first' || chr(10) || chr(10) || '<a id="fn-2"></a>**2.** second' || chr(10) || chr(10) || '<a id="fn-3"></a>**3.** https://x.org/' || p_size || chr(10) || chr(10) || 'loose' || chr(10) as text from part
""")
def footnoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot notes linked at their first place, those that leaked into the text taken out, and all listed (2.5.21)."""
    d = _texts(spark, sf_dir, "# T\n\nWe use ", "NAME", " 1, see Figure 2 and 11,579 of [2]. Again ", "NAME", " 1 and tools 3.\n\n")
    text = F.concat("text", F.lit("3 https://x.org/"), "p_size", F.lit("\n\nBody ends.\n\n## References\n\nA 2\n"))
    notes = F.array(F.lit("1 first"), F.lit("2. second"), F.lit("loose"))
    return repair.repair(d.select("doc_id", text.alias("text"), notes.alias("notes")), repair.footnoted, "text", "notes").select("doc_id", "text")


@query("cleaned_front", """
select p_partkey as doc_id, '# On ' || p_name || chr(10) || chr(10) || '**Ann Lee** · Y Lab, Univ of Y, 12345' || chr(10) || chr(10) || 'a@x.org' || chr(10) || chr(10) || '**Bo Kim**' || chr(10) || chr(10) || '* Both did the work'
  || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || 'We show ' || p_name || '.' || chr(10) || chr(10) || '## 1 Introduction' || chr(10) || chr(10) || 'It goes on.' || chr(10) as text from part
""")
def cleaned_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter in order, without boilerplate and strayed contacts (2.7.18, 2.7.19)."""
    d = _texts(
        spark, sf_dir, "# On ", "NAME", "\n\n## Ann Lee*\n\nY Lab, Univ of Y, 12345\n\na@x.org\n\n* Both did the work\n\n## Bo Kim †\n\nPermission to make digital copies\n\n## Abstract\n\nWe show ", "NAME",
        ".\n\n## 1 Introduction\n\nCorresponding author:\n\nX Street 1, 54321 Town\n\nann@x.org\n\nIt goes on.\n",
    )
    once = repair.repair(d, repair.without_contacts, "text").withColumn("text", F.replace("text", F.lit("\n\n* Both"), F.lit("\n\n*Both")))
    done = repair.repair(once, repair.ordered_front, "text")
    return done.select("doc_id", F.replace("text", F.lit("\n\n*Both"), F.lit("\n\n* Both")).alias("text"))


_BODY = "of part %s we show that it holds in all of the cases that were looked at, and that it goes on to hold where nobody has looked before, which is new and of some use to all others who care about such matters"


@query("marked_abstracts", f"""
with b as (select p_partkey as doc_id, p_size % 4 as k, replace('{_BODY}', '%s', p_name) as body from part)
select doc_id, case k when 0 then 'Here ' || body || ', and more of it.' when 1 then 'So ' || body || '.' when 2 then 'Then ' || body || ', it ends here.' else '' end as abstract from b
""")
def marked_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts by their mark or as the longest paragraph, split ones joined, notices and keywords left out (2.7.20)."""
    k, body = F.col("p_size") % 4, F.concat(*[x for part in _BODY.split("%s") for x in (F.lit(part), F.col("p_name"))][:-1])
    text = (
        F.when(k == 0, F.concat(F.lit("# T\n\n## Abstract\n\n**Here** "), body, F.lit(", and more\n\n© 2024 A\n\nof it.\n\n## 1 Start\n\nBody.")))
        .when(k == 1, F.concat(F.lit("# T\n\nAbstract—So "), body, F.lit(". Permission to make copies is granted\n\n## Keywords\n\n"), F.repeat(F.lit("key word, "), 40), F.lit("\n\n## 1 Start")))
        .when(k == 2, F.concat(F.lit("# T\n\nAnn Lee, Univ of X, 12345\n\n*Keywords*\n\n"), F.repeat(F.lit("key word "), 60), F.lit("\n\nThen "), body, F.lit(", it\n\n![f](g.png)\n\nends here.\n\n## I. Start")))
        .otherwise("# T\n\nToo short.\n\n## 1 Start\n\n" + "long body " * 40)
    )
    d = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return repair.repair(d, repair.abstract_of, "text", out="abstract").select("doc_id", "abstract")


@query("split_author_lines", """
select p_partkey as doc_id, '# ' || p_name || chr(10) || chr(10) || 'Ann Lee a@x.org' || chr(10) || chr(10) || 'Bo Kim b@y.org' || chr(10) || chr(10) || 'tail' || chr(10) || chr(10) || '<a id="fn-author-1"></a>* equal' || chr(10) || chr(10) || '## 1 Start' as text from part
""")
def split_author_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors one a paragraph, and their notes before the body (2.7.18)."""
    d = _texts(spark, sf_dir, "# ", "NAME", "\n\nAnn Lee a@x.org Bo Kim b@y.org tail\n\n## 1 Start").withColumn("notes", F.array(F.lit(" * equal")))
    return repair.repair(repair.repair(d, repair.split_authors, "text"), repair.placed_notes, "text", "notes").select("doc_id", "text")


@query("unbroken_texts", """
with d as (select doc_id, trim(regexp_replace(text, '[\\s*_`]+', ' ', 'g')) as flat from documents)
select doc_id, flat as text from d where length(flat) >= 60
""")
def unbroken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that were lost in the extraction, as the source has them (2.5.24)."""
    flat = F.regexp_replace(F.regexp_replace("text", r"[\t\n\f\r *_`]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")  # blanks as the SQL's engine knows them
    d = load(spark, sf_dir, "documents").select("doc_id", flat.alias("flat")).where("length(flat) >= 60")
    broken = F.concat(F.substring("flat", 1, 30), F.lit("�"), F.substring(F.col("flat"), F.lit(32), F.length("flat")))
    return repair.repair(d.select("doc_id", broken.alias("text"), "flat"), repair.unbroken, "text", "flat").select("doc_id", "text")


@query("respaced_texts")
def respaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that were run together, apart again as in the source (2.5.23, 2.5.22)."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    fused = F.regexp_replace("source", r"([a-z]{4,}) ([a-z]{4,}) ([a-z]{4,})", "$1$2$3")
    return repair.repair(d.withColumn("text", fused), repair.respaced, "text", "source").select("doc_id", "text")


@query("formula_blocks", r"""
with p as (select p_partkey, p_size % 6 as k, p_size from part),
l as (select *, case k when 0 then '\alpha_' || p_size when 1 then '' when 2 then 'x + y' when 3 then 'a = b' when 4 then '\text{if} n' else '{open' end as latex from p)
select p_partkey, latex, case k when 1 then '![f](f.png)' when 0 then '$$' || latex || ' \tag{' || p_size || '}$$' when 2 then '$' || latex || '$' when 3 then chr(96) || chr(96) || chr(96) || chr(10) || latex || chr(10) || chr(96) || chr(96) || chr(96) when 4 then latex else '$$' || latex || '$$' end as block,
  k not in (1, 5) as good from l
""")
def formula_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas cleaned, tested and in the form of their kind (2.3.21)."""
    k = F.col("p_size") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("```latex\n\\\\alpha_"), "p_size", F.lit("\n```"))).when(k == 1, "").when(k == 2, "$x + y$").when(k == 3, r"\[a = b\tag{3}\]")
        .when(k == 4, "\text{if} n").otherwise("{open")
    )
    kind = F.when(k == 2, "inline").when(k == 3, "code").when(k == 4, "text").otherwise("display")
    p = load(spark, sf_dir, "part").withColumn("latex", repair.clean_latex(raw))
    number = F.when(k == 0, F.col("p_size").cast("string"))
    return p.select("p_partkey", "latex", repair.formula_block(F.col("latex"), kind, number, F.lit("f"), F.lit("f.png")).alias("block"), repair.renderable(F.col("latex")).alias("good"))


_REGIONS = """
select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as int) as slot, case l_linenumber % 4 when 0 then '(' || cast(l_linenumber as string) || ')' when 1 then 'x =  y' when 2 then 'z (9)' else '.' end as orig
from (select distinct l_orderkey, l_linenumber from lineitem)
"""


@query("formula_records", f"""
with r as ({_REGIONS.replace(" as string)", " as varchar)")}),
f as (select *, orig in ('x =  y', 'z (9)') as real, case when orig like '(%' then replace(replace(orig, '(', ''), ')', '') when orig like 'z%' then '9' else '' end as n from r),
g as (select *, sum(real::int) over (partition by doc_id order by slot) as o from f),
h as (select *, first_value(nullif(n, '') ignore nulls) over (partition by doc_id, o order by slot rows between current row and unbounded following) as found from g)
select doc_id, slot, case when real then 'formula-' || lpad(o::varchar, 2, '0') end as id, case when orig like 'x%' then 'x = y' when orig like 'z%' then 'z' when orig = '.' then '.' else '' end as hint, case when real then coalesce(found, '') else '' end as number, not real as drop from h
""")
def formula_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula regions as records, numbers that stand alone with the formula before (2.7.24)."""
    return repair.formula_records(relation(spark, sf_dir, _REGIONS))


@query("placed_formulas", f"""
with m as (select doc_id, i, case when line = '' then '<mark>' else line end as line from ({MARKDOWN})),
s as (select *, case when line = '<mark>' then sum((line = '<mark>')::int) over (partition by doc_id order by i) - 1 end as slot from m)
select doc_id, i, case when slot = 0 then '$x' || (doc_id % 3) || '$' else line end as line from s where not coalesce(slot = 1, false)
""")
def placed_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th mark of a document replaced by its k-th formula, or dropped (2.7.24)."""
    rows = relation(spark, sf_dir, MARKDOWN).select("doc_id", "i", F.when(F.col("line") == "", "<mark>").otherwise(F.col("line")).alias("line"))
    docs = rows.select("doc_id").distinct()
    records = docs.select("doc_id", F.lit(0).alias("slot"), F.concat(F.lit("$x"), F.col("doc_id") % 3, F.lit("$")).alias("block"), F.lit(False).alias("drop"))
    records = records.unionByName(docs.select("doc_id", F.lit(1).alias("slot"), F.lit(None).cast("string").alias("block"), F.lit(True).alias("drop")))
    return repair.placed_formulas(rows, records, "<mark>")


_GLYPHS = """
select l_orderkey as doc_id, 1 as page, l_linenumber as pos, cast(l_linenumber * 6 + case when l_linenumber > 4 then 40 else 0 end as double) as x, cast(l_linenumber * 6 + 5 + case when l_linenumber > 4 then 40 else 0 end as double) as right,
  100.0 + case when l_orderkey % 2 = 0 and l_linenumber % 2 = 0 then 0.5 else 0 end as base, 10.0 as size, substr('abcdefgh', l_linenumber, 1) as char, l_linenumber in (2, 3, 6) as math from (select distinct l_orderkey, l_linenumber from lineitem)
"""


@query("math_islands", f"""
with g as ({_GLYPHS.replace(" as right", ' as "right"')}),
a as (select *, case when "right" is not null and x - lag("right") over (partition by doc_id order by x) > 25 then 1 else 0 end as apart, row_number() over (partition by doc_id order by x) as n from g),
l as (select *, 1 + sum(apart) over (partition by doc_id order by x) as line from a),
c as (select *, case when math is distinct from lag(math) over (partition by doc_id, line order by x) then 1 else 0 end as new from l),
r as (select *, sum(new) over (partition by doc_id, line order by x) as run from c),
t as (select doc_id, line, run, math, string_agg(char, '' order by x) as text from r group by all),
n as (select *, coalesce(lag(text) over (partition by doc_id, line order by run), '') as before, coalesce(lead(text) over (partition by doc_id, line order by run), '') as after from t)
select doc_id, line::int as line, run::bigint as island, text, before, after from n where math
""")
def math_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of formula glyphs within lines, with what stands on either side (2.7.22)."""
    return repair.math_islands(relation(spark, sf_dir, _GLYPHS)).select("doc_id", "line", "island", "text", "before", "after")


@query("aligned_blocks", f"""
with m as (select doc_id, i, name from ({MARKDOWN}) where line <> ''),
b as (select doc_id, i as block, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') || i as k from m), t as (select * from b where block % 3 <> 1)
select b.doc_id, b.block, t.block as item from b left join t on t.doc_id = b.doc_id and t.block = b.block
""")
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text and the items that they came from, both in order (2.5.19)."""
    m = relation(spark, sf_dir, MARKDOWN).where("line <> ''")
    blocks = m.select("doc_id", F.col("i").alias("block"), F.concat(F.lit("**"), F.upper("name"), F.lit("** &lt; "), "i").alias("text"))
    items = m.where("i % 3 <> 1").select("doc_id", F.col("i").alias("item"), F.concat("name", F.lit(" < "), "i").alias("text"))
    return repair.align_blocks(blocks, items)


@query("unwrapped_references", """
select p_partkey as doc_id, 0 as "table", unnest([1, 2, 3]) as marker, unnest([p_name || ' first more', 'second', 'third']) as text from part where p_size % 3 <> 0
""")
def unwrapped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are lists of references, as entries (2.6.22)."""
    p = load(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    cell = lambda row, col, x, text: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(x).alias("l"), text.alias("text"))
    second = F.when(F.col("p_size") % 3 == 0, F.lit("[7]")).otherwise("[2]")
    cells = F.array(
        cell(0, 0, 10.0, F.lit("[1]")), cell(0, 1, 30.0, F.col("p_name")), cell(1, 0, 10.0, second), cell(1, 1, 30.0, F.lit("second")), cell(2, 0, 10.0, F.lit("[3]")), cell(2, 1, 30.0, F.lit("third")),
    )
    line = lambda base, x, text: F.struct(F.lit(base).alias("base"), F.lit(x).alias("l"), text.alias("text"))
    rows = F.array(
        line(1.0, 10.0, F.lit("[1]")), line(1.0, 30.0, F.concat("p_name", F.lit(" first"))), line(2.0, 30.0, F.lit("more")), line(3.0, 10.0, F.lit("[2]")), line(3.0, 30.0, F.lit("second")),
        line(4.0, 10.0, F.lit("[3]")), line(4.0, 30.0, F.lit("third")),
    )
    c = p.select("doc_id", F.lit(0).alias("table"), F.explode(cells).alias("c")).select("doc_id", "table", "c.*", F.lit(False).alias("spans"), F.lit(True).alias("under"))
    r = p.select("doc_id", F.lit(0).alias("table"), F.explode(rows).alias("r")).select("doc_id", "table", "r.*")
    return layout.unwrapped_references(c, r)


@query("pages_without_furniture", f"""
with i as (select *, case when unit % 5 = 0 then 'footnote' when unit % 11 = 0 then 'picture' else 'text' end as lab, case when unit % 7 = 0 then 'Permission to make copies' when unit % 5 = 0 and unit % 2 = 0 then '* equal contribution' else text end as txt from ({ITEMS})),
k as (select *, not (lab = 'text' and txt like 'Permission%') as keep from i),
p as (select distinct doc_id, page from i),
j as (select *, lab = 'text' and (l + r) / 2 > 100 and (l + r) / 2 < 200 and (t + b) / 2 > 100 and (t + b) / 2 < 300 as inside from k where keep)
select doc_id, page, unit, case when lab <> 'footnote' then lab when txt like 'Permission%' then 'boilerplate' when txt like '* equal%' then 'author' else 'body' end as kind from j where not inside
""")
def pages_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of pages without notices and words inside pictures, foot notes by whose they are (2.6.12)."""
    u = F.col("unit")
    items = relation(spark, sf_dir, ITEMS)
    text = F.when(u % 7 == 0, "Permission to make copies").when((u % 5 == 0) & (u % 2 == 0), "* equal contribution").otherwise(F.col("text"))
    items = items.withColumn("label", F.when(u % 5 == 0, "footnote").when(u % 11 == 0, "picture").otherwise("text")).withColumn("text", text)
    one = items.select("doc_id", "page").distinct()
    pictures = one.select("doc_id", "page", F.lit(100.0).alias("l"), F.lit(100.0).alias("t"), F.lit(200.0).alias("r"), F.lit(300.0).alias("b"), F.lit(True).alias("captioned"))
    return layout.relocate_footers(items, pictures).select("doc_id", "page", "unit", "kind")
