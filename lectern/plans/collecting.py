"""Queries on edits of collections, flags, stored tables and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import collecting, layout
from lectern.sources.tables import load, relation

from . import query
from .fixtures import COLLECTIONS, LIBRARY, MARKDOWN, TERMS

_C = COLLECTIONS.replace(" as string)", " as varchar)")
_OK = f"c as ({_C}), ok as (select id, name, ord, case when parent in (select id from c) then parent end as parent from c)"
_R = f"{_OK}, r as (select id, id as ancestor, 0 as depth from ok union all select r.id, ok.parent, depth + 1 from r join ok on r.ancestor = ok.id where ok.parent is not null)"


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, COLLECTIONS)


@query("collections_created", f"""
with c as ({_C}), n as (select r_regionkey, row_number() over (order by r_regionkey) as place from region)
select id, name, parent, ord from c union all
select 'x' || r_regionkey, case when r_regionkey % 2 = 0 then 'Collection ' || ((select count(*) from c) + place) else 'New one ' || r_regionkey end, case when r_regionkey < 3 then 'r' || r_regionkey end, 1000 + r_regionkey from n
""")
def collections_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New collections among the others, with names for those that have none (2.14.1, 2.1.19)."""
    name = F.when(F.col("r_regionkey") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" New  one "), "r_regionkey"))
    parent = F.when(F.col("r_regionkey") < 3, F.concat(F.lit("r"), "r_regionkey")).otherwise("nowhere")
    new = load(spark, sf_dir, "region").select(F.concat(F.lit("x"), "r_regionkey").alias("id"), name.alias("name"), parent.alias("parent"), (1000 + F.col("r_regionkey")).alias("ord"))
    return collecting.create(_collections(spark, sf_dir), new)


@query("collections_deleted", f"""
with recursive {_R}, gone as (select id from c where id in ('r1', 'n2') or id = 'w'),
up as (select id, arg_min(ancestor, depth) as up from r where depth > 0 and ancestor not in (select id from gone) group by id)
select c.id, c.name, case when c.parent in (select id from gone) then up.up else c.parent end as parent from c left join up using (id) where c.id not in (select id from gone)
""")
def collections_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections after some are deleted; what was below them moves up (2.14.1)."""
    c = _collections(spark, sf_dir)
    return collecting.delete(c, c.where("id in ('r1', 'n2', 'w')").select("id")).select("id", "name", "parent")


@query("memberships_left", """
select c_custkey as doc_id, array_to_string(list_filter(['n' || c_nationkey, 'r' || (c_custkey % 4), 'w'], lambda x: x not in ('r1', 'n2', 'w')), ',') as projects from customer
""")
def memberships_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of each document after some are deleted (2.14.1, 2.2.6)."""
    ids = F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), F.col("c_custkey") % 4), F.lit("w"))
    m = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), ids.alias("projects"))
    gone = _collections(spark, sf_dir).where("id in ('r1', 'n2', 'w')").select("id")
    return collecting.leave(m, gone).select("doc_id", F.array_join("projects", ",").alias("projects"))


_MOVES = "select 'r' || cast(r_regionkey as string) as id, case r_regionkey when 0 then 'n0' when 1 then 'r1' when 2 then 'missing' when 3 then null else 'r0' end as to from region union all select 'w', 'n5' union all select 'ghost', 'w'"


@query("collections_moved", f"""
with recursive {_R}, m as (select id, "to" from ({_MOVES.replace(" as to ", ' as "to" ').replace("cast(r_regionkey as string)", "r_regionkey")}) t)
select m.id, m."to" as "to", m.id in (select id from c) and (m."to" is null or (m."to" in (select id from c) and not exists (select 1 from r where r.id = m."to" and r.ancestor = m.id))) as allowed from m
""")
def collections_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which collections may move where; never below themselves (2.14.1)."""
    return collecting.move(_collections(spark, sf_dir), relation(spark, sf_dir, _MOVES))


@query("collection_settings", """
select 'n' || n_nationkey as id, case when n_nationkey % 3 = 0 then null else 'a' || n_nationkey end as naming, 'k' as lang, case when n_nationkey % 2 = 0 then 'z' end as flavor from nation
""")
def collection_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of collections set, kept and unset (2.14.1)."""
    n = load(spark, sf_dir, "nation").withColumn("id", F.concat(F.lit("n"), "n_nationkey"))
    old = n.select("id", F.create_map(F.lit("naming"), F.lit("old"), F.lit("lang"), F.lit("k")).alias("settings"))
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("naming").alias("key"), F.lit("first").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("naming").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("a"), "n_nationkey")).alias("value")),
        F.struct(F.lit(2).alias("pos"), F.when(F.col("n_nationkey") % 2 == 0, "flavor").otherwise("colour").alias("key"), F.lit("z").alias("value")),
    )
    got = collecting.set_settings(old, n.select("id", F.explode(rows).alias("r")).select("id", "r.*"), ["naming", "lang", "flavor"])
    return got.select("id", *[F.element_at("settings", F.lit(k)).alias(k) for k in ("naming", "lang", "flavor")])


_ASKED = "select n_nationkey as ask, case n_nationkey % 5 when 0 then 'n' || cast(n_nationkey as string) when 1 then n_name when 2 then lower(substr(n_name, 2, 4)) when 3 then 'A' else ' no such ' end as text from nation"


@query("collections_found", f"""
with c as ({_C}), a as (select ask, trim(text) as key from ({_ASKED.replace("cast(n_nationkey as string)", "n_nationkey")})),
h as (select ask, id, 0 as rank from a join c on key = id union all select ask, id, 1 from a join c on key = name union all select ask, id, 2 from a join c on key <> '' and contains(lower(name), lower(key))),
b as (select ask, rank, count(distinct id) as n, min(id) as id from h group by ask, rank qualify row_number() over (partition by ask order by rank) = 1)
select a.ask, case when n = 1 then id end as id, coalesce(n, 0) as matches from a left join b using (ask)
""")
def collections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections by id, by name, or by a part of a name that one has only (2.15.2)."""
    return collecting.find(_collections(spark, sf_dir), relation(spark, sf_dir, _ASKED))


@query("document_flags", f"""
select doc_id, case when doc_id % 4 = 0 then not hidden else hidden end as hidden, case when doc_id % 3 = 0 then coalesce(pinned_at, 7) when doc_id % 3 = 1 then null else pinned_at end as pinned_at,
  case when doc_id % 5 = 0 then 'de' else 'en' end as lang, case when doc_id % 2 = 0 then 'fr' when doc_id % 5 = 0 then 'de' else 'en' end as used from ({LIBRARY})
""")
def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents hidden, pinned and translated otherwise (2.14.2)."""
    docs = relation(spark, sf_dir, LIBRARY).withColumn("lang", F.lit("en"))
    d = F.col("doc_id")
    changes = docs.select(
        "doc_id", F.when(d % 4 == 0, ~F.col("hidden")).alias("hidden"), F.when(d % 3 == 0, True).when(d % 3 == 1, False).alias("pin"), F.when(d % 5 == 0, "de").alias("lang")
    )
    out = collecting.set_flags(docs, changes, F.lit(7).cast("bigint"))
    return out.withColumn("used", collecting.language(F.when(d % 2 == 0, "fr"), F.when(d % 5 == 0, "de").otherwise(" "), F.lit("en")))


@query("stored_terms", f"""
with t as (select *, trim(regexp_replace(lower(term), '\\s+', ' ', 'g')) as key from ({TERMS.replace(" as string)", " as varchar)")})),
f as (select paper, key, min(pos) as pos, arg_min(term, pos) as term, arg_min(rendering, pos) as r1, arg_min(policy, pos) as p1, arg_min(rendering, pos) filter (rendering <> '') as r2, arg_min(policy, pos) filter (rendering <> '') as p2 from t group by paper, key)
select paper, pos - 1 as pos, term, case when r1 = '' then coalesce(r2, '') else r1 end as rendering, case when r1 = '' and r2 is not null then p2 else p1 end as policy from f
""")
def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term tables written as texts and read again, each key once (2.1.13, 2.2.3)."""
    return collecting.read_terms(collecting.write_terms(relation(spark, sf_dir, TERMS)))


@query("replaced_tables", """
with o as (select s_suppkey as id, lang, 'old' as payload from supplier, (select unnest(['de', 'fr']) as lang)),
n as (select s_suppkey as id, 'de' as lang, 'new' as payload from supplier where s_suppkey % 3 = 0)
select * from (select o.* from o left join n using (id, lang) where n.payload is null union all select * from n) where id % 7 <> 0
""")
def replaced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tables replaced, and deleted in all languages (2.2.3)."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    old = s.select("id", F.explode(F.array(F.lit("de"), F.lit("fr"))).alias("lang"), F.lit("old").alias("payload"))
    new = s.where("id % 3 = 0").select("id", F.lit("de").alias("lang"), F.lit("new").alias("payload"))
    return collecting.replace_tables(old, new, s.where("id % 7 = 0"), ["id", "lang"])


@query("changed_copies", """
select doc_id::varchar as name, 'en_' || doc_id as "to" from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from documents where lang = 'en' and doc_id % 3 <> 0)
""")
def changed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to copy: referenced ones whose bytes differ from the copy's (2.2.7)."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"), "doc_id", "lang")
    there = d.where("lang = 'en'").select(F.concat(F.lit("en_"), "name").alias("name"), F.when(F.col("doc_id") % 3 != 0, F.col("digest")).otherwise("stale").alias("digest"))
    return collecting.changed_copies(d, there, d.where("doc_id % 2 = 0"), "en_")


@query("command_batch", f"""
with recursive {_R}
select distinct o_orderkey as doc_id from orders join customer on c_custkey = o_custkey join r on r.id = 'n' || c_nationkey and r.ancestor = 'r1' where o_orderkey % 11 <> 0
""")
def command_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a collection and below that a command runs over (2.15.3)."""
    docs = relation(spark, sf_dir, LIBRARY)
    m = docs.select("doc_id", F.concat(F.lit("n"), "nation").alias("id"))
    return collecting.batch(docs, m, _collections(spark, sf_dir), "r1")


@query("turn_jobs", """
select conv_id as session, turn, case when turn % 2 = 0 then turn || ':a ' || (turn + 1) || ':b' else '' end as jobs from (select distinct conv_id, turn from conversations)
""")
def turn_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the jobs that they started (2.12.4)."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn").distinct()
    rows = F.array(F.struct(F.lit(2).alias("pos"), (F.col("turn") + 1).alias("id"), F.lit("b").alias("kind")), F.struct(F.lit(1).alias("pos"), F.col("turn").alias("id"), F.lit("a").alias("kind")))
    jobs = turns.where("turn % 2 = 0").select("session", "turn", F.explode(rows).alias("j")).select("session", "turn", "j.*")
    got = collecting.attach_jobs(turns, jobs)
    return got.withColumn("jobs", F.array_join(F.transform("jobs", lambda j: F.concat_ws(":", j["id"].cast("string"), j["kind"])), " "))


@query("written_references", """
select p_partkey, '@misc{k' || p_partkey || ',' || chr(10) || '  title = {' || p_name || case when p_size % 6 = 0 then '}}, year = {1' else '' end || '}' || case when p_size % 2 = 0 then ',' || chr(10) || '  note = {' || p_brand || '}' else '' end
  || chr(10) || '}' || chr(10) as entry, true as same from part
""")
def written_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written as text that read as the same fields again (2.14.6)."""
    fields = {"title": F.concat("p_name", F.when(F.col("p_size") % 6 == 0, "}}, year = {1").otherwise("")), "note": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ")}
    p = load(spark, sf_dir, "part").withColumn("entry", collecting.reference_entry(F.lit("misc"), F.concat(F.lit("k"), "p_partkey"), fields))
    return p.select("p_partkey", "entry", collecting.reread_entry(F.col("entry"), fields).alias("same"))


@query("replaced_once", """
select p_partkey, case p_size % 4 when 0 then 'a' || chr(10) || 'NEW' || chr(10) || 'c' when 1 then null when 2 then 'NEW' else null end as text from part
""")
def replaced_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block replaced where it stands exactly once on lines of its own (2.14.9)."""
    k, x = F.col("p_size") % 4, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("a\n"), x, F.lit("\nc"))).when(k == 1, F.concat(x, F.lit("\nb\n"), x)).when(k == 2, x).otherwise(F.concat(x, F.lit(" tail")))
    return load(spark, sf_dir, "part").select("p_partkey", collecting.replace_once(text, x, F.lit("NEW")).alias("text"))


_PAIRS = f"select doc_id, i, name || ' and <b>' || coalesce(lead(name) over (partition by doc_id order by i), 'nothing') || '</b>' as text from ({MARKDOWN})"


@query("guessed_pages", f"""
with p as (select doc_id, i as page, array_to_string(regexp_extract_all(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '[0-9a-zà-ÿ]+'), '') as flat, regexp_extract_all(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '[0-9a-zà-ÿ]+') as w from ({_PAIRS})),
places as (select doc_id as id, doc_id, w from p where page = 1),
probes as (select id, doc_id, 2 as rank, array_to_string(w[-5:], '') as probe from places where len(w) >= 5 union all select id, doc_id, 4, array_to_string(w[-3:], '') from places where len(w) >= 3),
hits as (select probes.id, rank, count(*) as n, min(page) as page from probes join p using (doc_id) where length(probe) >= 12 and contains(flat, probe) group by all)
select id, arg_min(page, rank)::int as page from hits where n = 1 group by id
""")
def guessed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a place by the words about it (2.14.10)."""
    pages = relation(spark, sf_dir, _PAIRS).withColumnRenamed("i", "page")
    places = pages.where("page = 1").select(F.col("doc_id").alias("id"), "doc_id", F.concat(F.lit("far off\n\n"), "text").alias("before"), F.lit("").alias("after"))
    return collecting.guess_page(places, pages)


@query("footer_blocks", """
select p_partkey, case when p_size % 5 = 0 then 'author' when p_size % 5 = 1 then 'boilerplate' when p_size % 5 = 2 then 'boilerplate' else 'body' end as kind from part
""")
def footer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot notes of authors, of publishers and of the text (2.6.12)."""
    k = F.col("p_size") % 5
    text = F.when(k == 0, "* Corresponding author: a@b.org").when(k == 1, "Permission to make digital copies is granted").when(k == 2, "© 2024 Some Press").otherwise(F.concat(F.lit("3 See "), "p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", layout.footnote_kind(text).alias("kind"))
