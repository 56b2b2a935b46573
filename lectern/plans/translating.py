"""Queries on translation: terms, units, figures, caches, merged edits and the whole conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import copyright_year, field_text, hash_text, is_run_in_title, is_title_phrase, title_of
from lectern.operators import assembly, captions, frontmatter, headings, library, lines, sequences, translating
from lectern.sources.tables import load, relation

from . import query
from .fixtures import COLLECTIONS, LIBRARY, MARKDOWN, TERMS

_POLICY = "case cast(pos as int) % 4 when 0 then 'keep' when 1 then 'transliterate' when 2 then 'gloss-first-use' else 'translate' end"
_TERMS = f"select paper, pos, trim(term) as term, rendering, {_POLICY} as policy from ({TERMS})"


@query("term_blocks", f"""
select paper, string_agg('- ' || term || ' → ' || case policy when 'keep' then 'keep the original spelling' when 'transliterate' then rendering || ' (by sound)'
  when 'gloss-first-use' then rendering || ' (with the original at first use)' else rendering || ' (as given)' end, chr(10) order by pos) as block from ({_TERMS}) group by paper
""")
def term_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a prompt for the terms of each paper (2.10.16)."""
    return translating.term_block(relation(spark, sf_dir, _TERMS))


@query("kept_terms", """
select p_partkey as doc_id, 0 as pos, 'use ' || p_brand || ' and ' || p_brand || ' but `' || 'R ' || p_name || '` and [' || 'R ' || p_name || '](x) and ' || p_brand || ', ' || 'W ' || p_name as text from part
""")
def kept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that must stay are in their own spelling again, outside code and links (2.7.12)."""
    p = load(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    r, w = F.concat(F.lit("R "), "p_name"), F.concat(F.lit("W "), "p_name")
    text = F.concat(F.lit("use "), r, F.lit(" and "), r, F.lit(" ( "), F.upper("p_brand"), F.lit(") but `"), r, F.lit("` and ["), r, F.lit("](x) and "), r, F.lit("（"), F.col("p_brand"), F.lit("）, "), w)
    terms = p.select("doc_id", F.lit(1).alias("pos"), F.col("p_brand").alias("term"), r.alias("rendering"), F.lit("keep").alias("policy"))
    other = p.select("doc_id", F.lit(2).alias("pos"), F.lit("other").alias("term"), w.alias("rendering"), F.lit("translate").alias("policy"))
    return translating.keep_terms(p.select("doc_id", F.lit(0).alias("pos"), text.alias("text")), terms.unionByName(other))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = relation(spark, sf_dir, MARKDOWN).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return md.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


@query("split_units", rf"""
with m as (select *, regexp_matches(line, '^#{{1,6}}\s') as head, max(i) over (partition by doc_id) as last from ({MARKDOWN})),
l as (select * from m where not (i = last and line = '')),
k as (select *, sum(head::int) over (partition by doc_id order by i) - 1 as k from l),
n as (select doc_id, count(*) filter (head) as heads, bool_or(head and i = 0) as starts from m group by doc_id)
select k.doc_id, k.k::bigint as k, string_agg(line, chr(10) order by i) as text from k join n using (doc_id) where starts and heads = case when doc_id % 3 = 0 then 2 else heads end group by k.doc_id, k.k
""")
def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated units back as their sections, where the headings are as many (2.7.28)."""
    t = _texts(spark, sf_dir)
    heads = lines.headings(lines.lines(t)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("h"))
    units = t.join(heads, "doc_id").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(F.col("h")).alias("n"))
    return translating.split_by_headings(units)


_PAPERS = """
select o_orderkey as doc_id, '# Title ' || cast(o_orderkey as string) || chr(10) || 'by someone' || chr(10) || '## ' || case when o_orderkey % 3 = 0 then 'Abstract' else 'Summary' end || chr(10) || 'We show ' || o_orderstatus || chr(10) || chr(10)
  || '## 1 Introduction' || chr(10) || 'It is so.' || chr(10) || '### 2.1 Methods' || chr(10) || 'As usual.' as text
from orders
"""
_PAPERS_SQL = _PAPERS.replace(" as string)", " as varchar)")


@query("term_sources", f"""
with p as ({_PAPERS_SQL}), o as (select o_orderkey as doc_id, o_orderstatus as s from orders)
select doc_id, '## Title ' || doc_id || chr(10) || chr(10) || '## ' || case when doc_id % 3 = 0 then 'Abstract' || chr(10) || 'We show ' || s else 'Summary' end || chr(10) || chr(10) || '## 1 Introduction' || chr(10) || 'It is so.' || chr(10) || chr(10) || '## 2.1 Methods' as source from o
""")
def term_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts and introductions whole, other sections by title (2.10.16)."""
    return translating.term_source(relation(spark, sf_dir, _PAPERS))


@query("translation_contexts", f"""
with p as ({_PAPERS_SQL}), o as (select o_orderkey as doc_id, o_orderstatus as s from orders)
select doc_id, 'Title ' || doc_id as title, case when doc_id % 3 = 0 then 'We show ' || s else text end as abstract from p join o using (doc_id)
""")
def translation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and abstract that go with every unit (2.10.16)."""
    return translating.title_abstract(relation(spark, sf_dir, _PAPERS))


_FIGURES = """
select l_orderkey as doc_id, cast(l_linenumber as int) as i, 'a ![x](images/f' || cast(min(l_partkey) % 4 as string) || '.png) ![y](images/formula-1.png) [[images/f' || cast(min(l_suppkey) % 3 as string) || '.de.png]]' as line
from lineitem group by l_orderkey, l_linenumber
"""
_FIGURES_SQL = _FIGURES.replace(" as string)", " as varchar)")
_FILES = "select distinct l_orderkey as doc_id, unnest(['f0.png', 'f1.png', 'f2.png', 'f3.png']) as name, 'd' || (l_orderkey % 5) as digest from lineitem"


def _figure_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = relation(spark, sf_dir, _FIGURES)
    docs = rows.select("doc_id").distinct()
    files = docs.select("doc_id", F.explode(F.array(*[F.lit(f"f{k}.png") for k in range(4)])).alias("name"), F.concat(F.lit("d"), F.col("doc_id") % 5).alias("digest"))
    done = files.where("name in ('f0.png', 'f1.png')")
    records = done.select("doc_id", "name", F.replace("name", F.lit(".png"), F.lit(".de.png")).alias("translated"), F.when(F.col("name") == "f0.png", F.col("digest")).otherwise(F.concat(F.lit("d"), F.col("doc_id") % 3)).alias("src_digest"))
    return rows, files, records


@query("figures_to_translate", f"""
with f as ({_FIGURES_SQL}),
s as (select doc_id, regexp_extract(line, 'images/(f[0-9]\\.png)\\)', 1) as name, min(i) as seen from f group by all)
select doc_id, name, row_number() over (partition by doc_id order by seen) as place, not (name = 'f0.png' or (name = 'f1.png' and doc_id % 5 = doc_id % 3)) as todo from s
""")
def figures_to_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in order of reference, and whether their translation is missing or out of date (2.14.12, 2.4.17)."""
    return translating.figures_to_translate(*_figure_tables(spark, sf_dir))


@query("linked_figures", f"""
with f as ({_FIGURES_SQL}),
p as (select doc_id, i, regexp_extract(line, 'images/f([0-9])\\.png\\)', 1) as a, regexp_extract(line, 'f([0-9])\\.de', 1) as b from f),
v as (select *, a = '0' or (a = '1' and doc_id % 5 = doc_id % 3) as va, b = '0' or (b = '1' and doc_id % 5 = doc_id % 3) as vb from p)
select doc_id, i, 'a ![x](images/f' || a || case when va then '.de' else '' end || '.png) ![y](images/formula-1.png) [[images/f' || b || case when vb then '.de' else '' end || '.png]]' as line from v
""")
def linked_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead to valid translations of figures, else to the originals (2.14.12)."""
    return translating.link_figures(*_figure_tables(spark, sf_dir))


@query("retranslation_plan", """
with u as (select l_orderkey as doc_id, (l_linenumber - 1) // 2 as unit, l_linenumber as section, min(l_shipinstr) as text from (select l_orderkey, l_linenumber, 't' || l_partkey as l_shipinstr from lineitem) group by all),
g as (select doc_id, unit, count(*) as sections, bool_or(section = 3) as asked, string_agg(text, chr(10) order by section) as text from u group by all)
select doc_id, unit, sections, case when asked or not exists (select 1 from g d where d.doc_id = g.doc_id and d.unit = 0 and d.text = g.text) then 'translate' else 'keep' end as action from g
""")
def retranslation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a job on chosen sections translates again (2.15.11)."""
    unit = F.floor((F.col("l_linenumber") - 1) / 2).alias("unit")
    u = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), unit, F.col("l_linenumber").alias("section")).agg(F.min(F.concat(F.lit("t"), "l_partkey")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n")
    done = u.where("unit = 0").groupBy("doc_id").agg(hash_text(text).alias("hash"))
    return translating.retranslation_plan(u, u.where("section = 3").select("doc_id", "section"), done)


@query("cached_results", """
select p_partkey as doc_id, case when p_size % 4 = 0 then 'user' else p_size || ':' || length(p_name) || ':v2' end as signature, case when p_size % 4 = 0 then 'mine' when p_size % 4 = 1 then 'old' end as value from part
""")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached results that still hold, by time, size and rule version (2.11.8)."""
    p = load(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey"))
    k = F.col("p_size") % 4
    sign = F.concat_ws(":", F.col("p_size").cast("string"), F.length("p_name").cast("string"))
    cache = p.where("p_size % 4 <> 3").select("doc_id", F.when(k == 0, "user").when(k == 1, F.concat(sign, F.lit(":v2"))).otherwise(F.concat(sign, F.lit(":v1"))).alias("signature"), F.when(k == 0, "mine").otherwise("old").alias("value"))
    return translating.cached_results(p.select("doc_id", F.col("p_size").alias("mtime"), F.length("p_name").alias("size")), cache, 2)


@query("refreshed_results", """
select doc_id, substr(sha256(text), 1, 16) as hash, case when lang = 'en' then -1 else n_chars end as value from documents
""")
def refreshed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, built again only where inputs have changed (2.11.10)."""
    d = load(spark, sf_dir, "documents").withColumn("hash", hash_text(F.col("text")))
    stored = d.select("doc_id", F.when(F.col("lang") == "en", F.col("hash")).otherwise("stale").alias("hash"), F.lit(-1).cast("bigint").alias("value"))
    return translating.refreshed(d, stored, lambda rows: rows.select("doc_id", F.col("n_chars").alias("value")))


@query("filled_references", """
with r as (select distinct l_orderkey as doc_id, l_linenumber as label from lineitem),
s as (select *, label % 3 = 0 as linked, label % 3 = 1 as bulk from r),
o as (select *, case when not linked and not bulk then sum((not linked and not bulk)::int) over (partition by doc_id order by label) end as place from s),
t as (select *, case when linked then 'linked' when bulk then 'bulk' when place > 1 then 'skipped' else 'single' end as status from o)
select doc_id, label, case when linked then 'd' when bulk then 'b' || label when status = 'single' then '' else '' end as doi, case when status in ('bulk', 'single') then 2001 end as year, case when status = 'single' then 's' || label else '' end as arxiv, status, place::bigint as place from t
""")
def filled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with blanks filled from bulk records, then from a limited number of lookups (2.5.6)."""
    r = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("label")).distinct()
    k, title = F.col("label") % 3, F.concat(F.lit("T  "), F.col("label"))
    refs = r.select("doc_id", "label", title.alias("title"), F.when(k == 0, "d").otherwise("").alias("doi"), F.lit("").alias("arxiv"), F.lit(None).cast("int").alias("year"), F.lit("V").alias("venue"))
    pool = r.where("label % 3 <> 0").select(
        "doc_id", F.concat(F.lit("t "), F.col("label")).alias("key"), (k == 1).alias("bulk"), F.when(k == 1, F.concat(F.lit("b"), F.col("label"))).otherwise("").alias("doi"),
        F.when(k == 2, F.concat(F.lit("s"), F.col("label"))).otherwise("").alias("arxiv"), F.lit(2001).alias("year"), F.lit("W").alias("venue"),
    )
    return translating.fill_references(refs, pool, 1).select("doc_id", "label", "doi", "year", "arxiv", "status", "place")


@query("merged_edits", """
select p_partkey as doc_id, case p_size % 5 when 0 then 'a' || chr(10) || '## ' || p_name || chr(10) || 'one MY three' when 1 then 'a' || chr(10) || 'one TWO 3' when 2 then 'a' || chr(10) || '### Mine' when 3 then 'a' else 'theirs' end as text,
  p_size % 5 in (0, 1, 2) as edited, 0 as conflicts, case when p_size % 5 = 3 then 1 else 0 end as dropped from part
""")
def merged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's edits carried over to a new assembly (2.14.14, 2.9.8)."""
    k, name = F.col("p_size") % 5, F.col("p_name")
    base = F.when(k == 0, F.concat(F.lit("a\n# "), name, F.lit("\none two three"))).when(k == 1, "a\none two three").when(k == 2, F.concat(F.lit("a\n## "), name)).when(k == 3, "a\nx y").otherwise("base")
    mine = F.when(k == 0, F.concat(F.lit("a\n# "), name, F.lit("\none MY three"))).when(k == 1, "a\none TWO three").when(k == 2, "a\n## Mine").when(k == 3, "a\nx z")
    theirs = F.when(k == 0, F.concat(F.lit("a\n## "), name, F.lit("\none two three"))).when(k == 1, "a\none two 3").when(k == 2, F.concat(F.lit("a\n### "), name)).when(k == 3, "a").otherwise("theirs")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), base.alias("base"), mine.alias("mine"), theirs.alias("theirs"))
    return translating.reassemble(p)


@query("repaired_layouts", """
select doc_id, case when doc_id % 2 = 0 then text else '# ' || text end as text, case when doc_id % 2 = 0 then 0 else 1 end as fixed, case when doc_id % 2 = 0 then 1 else 0 end as kept
from (select o_orderkey as doc_id, 'Title of ' || o_orderkey || chr(10) || 'text ' || o_orderstatus as text from orders)
""")
def repaired_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts that a model has repaired, and those that it may not change (2.13.3)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Title of "), "o_orderkey", F.lit("\ntext "), "o_orderstatus").alias("text"))

    def call(text: str) -> str:
        return "all lost" if int(text.split("\n")[0].split()[-1]) % 2 == 0 else "# " + text

    return translating.fix_layout(o, call).select("doc_id", "text", "fixed", "kept")


_SMALL, _LABELS = ("of", "the", "and", "in"), ("table", "figure")


@query("title_phrases", r"""
with p as (select p_partkey, case p_size % 6 when 0 then 'Results of ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) when 1 then 'RQ4' when 2 then p_name when 3 then 'Table 1' when 4 then 'The (Old) and New' else 'A b C' end as t from part),
w as (select *, string_split(t, ' ') as w from p)
select p_partkey, len(w) <= 7 and (len(w) > 1 or regexp_matches(w[1], '[a-zà-ÿ]')) and len(list_filter(w, lambda x: not (regexp_matches(x, '^[A-Z]') or lower(x) in ('of', 'the', 'and', 'in')))) = 0 as phrase,
  lower(w[1]) not in ('table', 'figure') and len(list_filter(list_transform(w, lambda x: regexp_replace(x, '^[()]+|[()]+$', '', 'g')), lambda x: not (regexp_matches(x, '^[A-Z]') or regexp_matches(x, '^[0-9]+$') or lower(x) in ('of', 'the', 'and', 'in')))) = 0 as run_in
from w
""")
def title_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that may be titles, before a colon and before a full stop (2.4.3)."""
    k, name = F.col("p_size") % 6, F.col("p_name")
    t = F.when(k == 0, F.concat(F.lit("Results of "), F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))).when(k == 1, "RQ4").when(k == 2, name).when(k == 3, "Table 1").when(k == 4, "The (Old) and New").otherwise("A b C")
    small, labels = (F.array(*[F.lit(x) for x in xs]) for xs in (_SMALL, _LABELS))
    return load(spark, sf_dir, "part").select("p_partkey", is_title_phrase(t, small).alias("phrase"), is_run_in_title(t, small, labels).alias("run_in"))


@query("paper_fields", f"""
select doc_id, case when doc_id % 3 = 0 then title when doc_id % 3 = 1 then 'manifest ' || doc_id else 'folder' || doc_id end as title,
  case when doc_id % 4 = 0 then 2019 when doc_id % 4 = 1 then 2007 end as year, case when doc_id % 2 = 0 then 'A; B' else '' end as authors from ({LIBRARY})
""")
def paper_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, year and shown fields of every paper from the sources that have them (2.1.2, 2.10.7, 2.6.24)."""
    d = F.col("doc_id")
    title = title_of(F.when(d % 3 == 0, F.col("title")).otherwise(" "), F.when(d % 3 == 1, F.concat(F.lit("manifest "), d)), F.concat(F.lit("folder"), d))
    text = F.when(d % 4 == 0, "Copyright © 2019 by A").when(d % 4 == 1, "© 1203 old").otherwise("(c) 20")
    created = F.when(d % 4 == 1, "D:20070304").when(d % 4 == 2, "D:1970").otherwise("x")
    authors = F.when(d % 2 == 0, F.array(F.lit("A"), F.lit("B")))
    return relation(spark, sf_dir, LIBRARY).select("doc_id", title.alias("title"), copyright_year(text, created, F.lit(2026)).alias("year"), field_text(authors, "array<string>").alias("authors"))


@query("text_coverage", r"""
with p as (select regexp_extract(url, '://([^/?#]*)', 1) as host, length(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', '', 'g')) >= 200 as ok from pages)
select host, round(avg(ok::int), 6) as share from p group by host
""")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pages with text, by host (2.4.18)."""
    return frontmatter.text_share(load(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_replace("html", "<[^>]+>", "").alias("text")), "host", 200)


@query("grounded_author_lists", """
with s as (select p_partkey as doc_id, p_size % 3 as k from part)
select doc_id, case when k = 0 then 'Ann Lee|Bo Kim' when k = 1 then 'Bo Kim|Ann Lee' end as names from s
""")
def grounded_author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors that the source names, in its order; none if one is made up (2.4.6)."""
    entry = lambda name, mail, place: F.struct(F.lit(name).alias("name"), F.array(F.lit(mail)).alias("emails"), F.array(F.lit(place)).alias("affiliations"))
    k = F.col("p_size") % 3
    entries = F.array(entry("Bo Kim*", "BO@x.org", "Univ. of X"), entry("Ann Lee †1", "ann@y.org", "Y Lab"))
    good = "Ann  Lee ann@y.org, Y-Lab; Bo Kim* bo@x.org Univ of X; Ann Lee †1"
    source = F.when(k == 0, good).when(k == 1, "Bo Kim* bo@x.org Univ of X. Ann Lee †1 ann@y.org Y Lab").otherwise("Bo Kim* bo@x.org Univ of X")
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), entries.alias("entries"), source.alias("source"))
    found = frontmatter.grounded_authors(rows)
    return found.select("doc_id", F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("names"))


@query("converted_documents", f"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from ({_PAPERS_SQL})),
h as (select *, line like '#%' as head, trim(regexp_replace(line, '^#+', '')) as t from l),
r as (select doc_id, i, case when not head then line when t like '1 %' then '# ' || t when t like '2.1 %' then '## ' || t else '# ' || t end as line from h)
select doc_id, string_agg(line, chr(10) order by i) || chr(10) as text from r group by doc_id
""")
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents converted: captions and headings cleaned, numbered, levelled and rendered (2.15.1)."""
    return convert(relation(spark, sf_dir, _PAPERS))


def convert(docs: DataFrame) -> DataFrame:
    """doc_id and text of raw markdown documents after all stages of the conversion that need no model."""
    rows = lines.lines(docs)
    rows = captions.drop_lines(rows, captions.duplicate_captions(rows)).withColumn("line", captions.plain_headings(F.col("line")))
    rows = rows.join(captions.figure_text(rows), ["doc_id", "i"], "left_anti")
    heads = headings.relevel(lines.headings(rows))
    sections = heads.select("doc_id", "i", F.concat(F.lit("h"), F.col("i")).alias("id"), "text", F.col("level").cast("string").alias("level"), F.lit(False).alias("runin"), F.lit(None).cast("string").alias("body"))
    return assembly.documents(assembly.render(rows, sections))


@query("published_bundles", f"""
with b as (select doc_id, string_agg(line, '|' order by i) as t from ({MARKDOWN}) group by doc_id),
c as (select doc_id as key, substr(sha256(t), 1, 16) as hash from b where doc_id % 5 <> 0), p as (select doc_id as key, case when doc_id % 3 = 0 then 'x' else substr(sha256(t), 1, 16) end as hash from b where doc_id % 2 = 0)
select coalesce(c.key, p.key) as key, case when c.key is null then 'delete' when p.hash is not distinct from c.hash then 'skip' else 'upload' end as action from c full join p on c.key = p.key
""")
def published_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a publishing command does with every document's bundle (2.15.5, 2.1.23)."""
    b = relation(spark, sf_dir, MARKDOWN).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    b = b.select(F.col("doc_id").alias("key"), hash_text(F.array_join(F.transform("l", lambda x: x["line"]), "|")).alias("hash"))
    published = b.where("key % 2 = 0").select("key", F.when(F.col("key") % 3 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return library.publish_plan(published, b.where("key % 5 <> 0"), prune=True)


@query("known_levels", f"""
select h.id, h.name, case when c.naming = 'own' then 3 when c.naming = 'std' then 1 end as level from ({COLLECTIONS.replace(" as string)", " as varchar)")}) h left join ({COLLECTIONS.replace(" as string)", " as varchar)")}) c on c.id = h.id
""")
def known_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that headings were given before, looked up by their key (2.1.18)."""
    c = relation(spark, sf_dir, COLLECTIONS)
    learned = c.where("naming is not null").select(F.concat(F.lit("  "), F.upper("name")).alias("text"), F.when(F.col("naming") == "own", 3).when(F.col("naming") == "std", 1).alias("level"))
    return headings.learned_levels(c.withColumn("text", F.col("name")), learned).select("id", "name", "level")


@query("sentence_blocks")
def sentence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every line, none over its end (2.16)."""
    rows = lines.lines(load(spark, sf_dir, "documents")).select("doc_id", F.col("i").alias("block"), F.col("line").alias("text"))
    return sequences.sentence_spans(rows)
