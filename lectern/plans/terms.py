"""Queries on terms, libraries, layouts and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import dice, hash_text, term_key
from lectern.operators import annotations, bibliography, cache, layout, library, lines, sequences, terms
from lectern.sources.tables import library_scan, load, relation

from . import query
from .fixtures import COLLECTIONS, ITEMS, LIBRARY, TERMS

_C = COLLECTIONS.replace(" as string)", " as varchar)")
_KEYED = f"""
t as (select *, lower(trim(regexp_replace(term, '[ \\t]+', ' ', 'g'))) as key from ({TERMS})),
f as (select paper, key, arg_min(struct_pack(term := term, rendering := rendering, policy := policy), pos) as f from t group by paper, key),
v as (select key, trim(f.rendering) as rendering, f.policy as policy, count(*) as papers, min(paper) as first_paper from f group by all)
"""


@query("term_dedupe", f"""
with {_KEYED},
g as (select paper, key, min(pos) as pos, arg_min(term, pos) as term, arg_min(rendering, pos) as r0, arg_min(policy, pos) as p0,
  arg_min(rendering, pos) filter (trim(rendering) <> '') as r1, arg_min(policy, pos) filter (trim(rendering) <> '') as p1 from t group by paper, key)
select paper, key, pos, term, case when trim(r0) = '' and r1 is not null then r1 else r0 end as rendering, case when trim(r0) = '' and r1 is not null then p1 else p0 end as policy from g
""")
def term_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a term and paper (2.6.1, 2.3.5)."""
    return terms.dedupe(relation(spark, sf_dir, TERMS))


@query("term_variants", f"with {_KEYED} select * from v")
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How papers render each term (2.6.2)."""
    return terms.variants(relation(spark, sf_dir, TERMS))


@query("term_conflicts", f"""
with {_KEYED}
select key, count(*) as n_variants, sum(papers)::bigint as papers, arg_max(rendering, struct_pack(papers := papers, f := -first_paper)) as rendering,
  arg_max(policy, struct_pack(papers := papers, f := -first_paper)) as policy from (select key, papers, first_paper, rendering, policy from v) group by key having count(*) >= 2
""")
def term_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that papers render differently (2.6.3, 2.15.10)."""
    t = relation(spark, sf_dir, TERMS)
    return terms.conflicts(t)


@query("term_shared", f"""
with {_KEYED}, w as (select key || ' ' || lower(policy) as key, papers from v)
select key, sum(papers)::bigint as papers from w group by key having count(*) = 1 and sum(papers) >= 2
""")
def term_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, told apart by policy, that several papers render alike (2.6.4)."""
    t = relation(spark, sf_dir, TERMS)
    first = t.withColumn("key", term_key(F.col("term"))).groupBy("paper", "key").agg(F.min_by(F.struct("pos", "rendering", "policy"), "pos").alias("f"))
    split = first.select("paper", "f.pos", F.concat_ws(" ", "key", "f.policy").alias("term"), "f.rendering", "f.policy")
    split = split.withColumn("term", F.concat_ws(" ", F.expr("regexp_replace(term, ' [^ ]*$', '')"), "policy"))
    v = terms.variants(split.withColumn("rendering", F.trim("rendering"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("papers").alias("papers"))
    return v.where("n = 1 and papers >= 2").select("key", "papers")


@query("term_effective", f"""
with {_KEYED},
p as (select key, min(pos) as pp, arg_min(policy, pos) as policy from t where paper = 1 group by key),
c as (select key, min(pos) as cp, arg_min(policy, pos) as policy from t where paper = 2 group by key)
select coalesce(p.key, c.key) as key, coalesce(c.policy, p.policy) as policy, case when c.key is null then 'paper' else 'collection' end as origin,
  row_number() over (order by pp nulls last, cp) as place from p full join c on p.key = c.key
""")
def term_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper's terms under its collection's (2.5.14)."""
    t = relation(spark, sf_dir, TERMS).withColumn("key", term_key(F.col("term")))
    one = lambda p: t.where(F.col("paper") == p).groupBy("key").agg(F.min_by(F.struct("pos", "term", "rendering", "policy"), "pos").alias("f")).select("key", "f.*")
    return terms.effective(one(1), one(2)).select("key", "policy", "origin", "place")


@query("term_extend", f"with {_KEYED} select key from t where paper = 2 and key not in (select key from t where paper = 1) group by key")
def term_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms that a paper lacks (2.9.6)."""
    t = relation(spark, sf_dir, TERMS)
    return terms.extend(t.where("paper = 1"), t.where("paper = 2")).select("key")


@query("relevant_terms", """
with t as (select distinct p_type as term, p_type || ' -> ' || lower(p_type) as line from part),
u as (select p_partkey as unit, p_name || ' of ' || p_type || ' kind' as text from part),
h as (select unit, array_to_string(list_sort(list(distinct line)), chr(10)) as lines from u, t where contains(' ' || lower(text), ' ' || lower(term)) group by unit)
select u.unit, h.lines, substr(sha256(text || coalesce(h.lines, '')), 1, 16) as hash from u left join h using (unit)
""")
def relevant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term lines that occur in each unit, and the unit's cache key (2.5.15, 2.11.1, 2.9.2)."""
    p = load(spark, sf_dir, "part")
    t = p.select(F.col("p_type").alias("term"), F.concat_ws(" -> ", "p_type", F.lower("p_type")).alias("line")).distinct()
    units = p.select(F.col("p_partkey").alias("unit"), F.concat("p_name", F.lit(" of "), "p_type", F.lit(" kind")).alias("text"))
    return terms.occurring(units, t)


@query("translation_impact", """
with g as (select source as paper, lang as model, count(*) as units, sum(length(text))::bigint as chars from documents group by all),
k as (select *, floor(chars / 3.5)::bigint as tokens_in from g)
select paper, model, units, chars, tokens_in, floor(tokens_in * 1.3)::bigint as tokens_out,
  case when model = 'en' then round((tokens_in * 3.0 + floor(tokens_in * 1.3) * 15.0) / 1e6, 6) else 0.0 end as cost from k
""")
def translation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What translating every source's documents would cost (2.6.5, 2.6.17)."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("paper"), F.col("lang").alias("model"), "text")
    prices = spark.range(1).select(F.lit("en").alias("model"), F.lit(3.0).alias("usd_in"), F.lit(15.0).alias("usd_out"))
    return terms.impact(d, prices).withColumn("cost", F.round("cost", 6))


@query("concordance", """
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) as sentence,
  generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), 1) as k from documents),
h as (select doc_id, sentence, contains(sentence, 'License') as exact, k from s where contains(lower(sentence), 'license'))
select doc_id, sentence, exact from h qualify row_number() over (partition by doc_id order by not exact, k) = 1
""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of every document that holds a term (2.5.16)."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("row"), "text")
    return terms.concordance(rows, "License").select("doc_id", "sentence", "exact")


@query("collection_closure", f"""
with recursive c as ({_C}), ok as (select id, case when parent in (select id from c) then parent end as parent from c),
r as (select id, id as ancestor, 0 as depth from ok union all select r.id, ok.parent, depth + 1 from r join ok on r.ancestor = ok.id where ok.parent is not null)
select * from r
""")
def collection_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection with its ancestors (2.8.5)."""
    return library.closure(relation(spark, sf_dir, COLLECTIONS))


@query("collection_tree", f"""
with recursive c as ({_C}), ok as (select id, ord, case when parent in (select id from c) then parent end as parent from c),
r as (select id, 0 as depth, lpad(ord::varchar, 12, '0') as path from ok where parent is null union all select ok.id, depth + 1, path || '/' || lpad(ok.ord::varchar, 12, '0') from r join ok on ok.parent = r.id)
select id, depth, row_number() over (order by path) as place from r
""")
def collection_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections in the order of a tree view (2.8.5)."""
    return library.depth_first(relation(spark, sf_dir, COLLECTIONS))


@query("collection_setting", f"""
with recursive c as ({_C}), ok as (select id, case when parent in (select id from c) then parent end as parent from c),
r as (select id, id as ancestor, 0 as depth from ok union all select r.id, ok.parent, depth + 1 from r join ok on r.ancestor = ok.id where ok.parent is not null)
select r.id, arg_min(naming, depth) filter (naming is not null) as value from r join c on c.id = r.ancestor group by r.id
""")
def collection_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest setting of every collection (2.8.6)."""
    return library.inherited(relation(spark, sf_dir, COLLECTIONS), "naming")


@query("collection_paths", f"""
with recursive c as ({_C}), ok as (select id, name, case when parent in (select id from c) then parent end as parent from c),
r as (select id, name as path from ok where parent is null union all select ok.id, path || ' / ' || ok.name from r join ok on ok.parent = r.id)
select * from r
""")
def collection_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of collections from the top down (2.8.5)."""
    return library.path_names(relation(spark, sf_dir, COLLECTIONS))


@query("collection_counts", f"""
with recursive c as ({_C}), ok as (select id, case when parent in (select id from c) then parent end as parent from c),
r as (select id, id as ancestor from ok union all select r.id, ok.parent from r join ok on r.ancestor = ok.id where ok.parent is not null),
n as (select ancestor as id, count(distinct c_custkey) as n from customer join r on r.id = 'n' || c_nationkey::varchar group by ancestor)
select c.id, coalesce(n, 0) as n from c left join n using (id)
""")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in every collection and below (2.6.14, 2.6.16)."""
    m = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("n"), "c_nationkey").alias("id"))
    return library.subtree_counts(relation(spark, sf_dir, COLLECTIONS), m)


@query("library_counts", """
with p as (select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then null else o_orderpriority end as project from orders union select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderstatus end from orders)
select coalesce(project, '(none)') as project, count(distinct doc_id) as n from p group by project union all select '(all)', count(distinct doc_id) from p
""")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each project, of none, and all (2.6.14, 2.6.16)."""
    ids = F.when(F.col("o_orderkey") % 5 != 0, F.array("o_orderpriority", "o_orderstatus", "o_orderpriority"))
    return library.counts(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), ids.alias("projects")))


@query("library_page", f"""
select doc_id, title, place from (select *, row_number() over (order by pinned_at desc nulls last, mtime desc, doc_id) as place from ({LIBRARY}) where not hidden and contains(lower(title || ' ' || segment), 'build')) where place <= 50
""")
def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a library search, pinned documents first (2.4.15, 2.8.8)."""
    found = library.listing(relation(spark, sf_dir, LIBRARY), "BUILD", ["title", "segment"])
    return library.page(found, [F.desc("mtime"), F.col("doc_id")], 50).select("doc_id", "title", "place")


@query("library_recent", f"""
with s as (select *, row_number() over (order by mtime desc, doc_id) as rank from ({LIBRARY}) where not hidden)
select doc_id, case when rank <= 100 then rank end as rank from s where rank <= 100 or pinned_at is not null
""")
def library_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents, and the pinned ones that are older (2.1.1)."""
    docs = relation(spark, sf_dir, LIBRARY).withColumn("root", F.col("doc_id"))
    return library_scan(docs, 100).select("doc_id", "rank")


@query("keyed_upsert", """
select coalesce(o.k, n.k) as key, case when o.k is null then 'insert' when n.k is null then 'keep' when o.v = n.v then 'same' else 'update' end as change, coalesce(n.v, o.v) as v
from (select p_partkey as k, p_name as v from part where p_size <= 30) o full join (select p_partkey as k, case when p_size % 2 = 0 then p_name else p_brand end as v from part where p_size > 10) n on o.k = n.k
""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries over old ones by key (2.2.4, 2.5.31)."""
    p = load(spark, sf_dir, "part")
    old = p.where("p_size <= 30").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("v"))
    new = p.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("v"))
    return library.upsert(old, new, "key", ["v"])


@query("publish_plan", """
select coalesce(p.k, c.k) as key, case when c.k is null then 'delete' when p.h is not distinct from c.h then 'skip' else 'upload' end as action
from (select doc_id as k, substr(sha256(text), 1, 16) as h from documents where n_chars > 500) p
full join (select doc_id as k, substr(sha256(case when lang = 'de' then text || '!' else text end), 1, 16) as h from documents where n_chars < 5000) c on p.k = c.k
""")
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental publish uploads, skips and deletes (2.2.10, 2.2.11)."""
    d = load(spark, sf_dir, "documents")
    old = d.where("n_chars > 500").select(F.col("doc_id").alias("key"), hash_text(F.col("text")).alias("hash"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return library.publish_plan(old, d.where("n_chars < 5000").select(F.col("doc_id").alias("key"), hash_text(text).alias("hash")), prune=True)


@query("membership_changes", """
with o as (select distinct o_custkey as doc_id, o_orderstatus as place from orders), n as (select distinct o_custkey as doc_id, o_orderstatus as place from orders where o_totalprice > 100000)
select doc_id, place, 'remove' as action from (select * from o except select * from n) union all select doc_id, place, 'write' from (select * from n except select * from o)
""")
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to write and remove when memberships change (2.2.6)."""
    o = load(spark, sf_dir, "orders")
    pick = lambda df: df.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("place"))
    return library.membership_changes(pick(o), pick(o.where("o_totalprice > 100000")))


@query("export_targets", """
with m as (select o_orderkey as doc_id, unnest(['r' || (o_orderkey % 7)::varchar, 'r' || (o_orderkey % 5)::varchar]) as id, unnest([0, 1]) as pos from orders),
f as (select 'r' || r_regionkey::varchar as id, '/' || r_name as folder from region where r_regionkey <> 3),
j as (select doc_id, folder, min(pos) as pos from m left join f using (id) group by doc_id, folder),
k as (select *, count(folder) over (partition by doc_id) as n from j)
select doc_id, coalesce(folder, '/common') as folder, row_number() over (partition by doc_id order by pos) as place from k where folder is not null or n = 0
""")
def export_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that each document is exported to (2.5.30, 2.2.5)."""
    ids = F.array(F.concat(F.lit("r"), F.col("o_orderkey") % 7), F.concat(F.lit("r"), F.col("o_orderkey") % 5))
    m = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(ids).alias("pos", "id"))
    f = load(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.concat(F.lit("/"), "r_name").alias("folder"))
    return library.export_targets(m, f, "/common")


@query("unique_names", """
with r as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part)
select p_partkey, case when n = 1 then p_name else p_name || '-' || n end as unique_name from r
""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by a suffix (2.7.7, 2.14.3, 2.14.8)."""
    u = library.suffixed(load(spark, sf_dir, "part"), "p_name", "p_partkey")
    return u.select("p_partkey", F.col("unique").alias("unique_name"))


@query("open_tabs", """
select o_custkey as doc_id, min(o_orderkey) as pos, arg_max(o_orderpriority, struct_pack(a := o_orderstatus = 'O', b := o_orderkey)) as path from orders group by o_custkey
""")
def open_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tab a document (2.6.15, 2.14.7)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("path"), (F.col("o_orderstatus") == "O").alias("inside"))
    return library.one_per_identity(o)


@query("layout_columns", f"""
with i as ({ITEMS}),
w as (select *, max(r) over (partition by doc_id, page order by l, r, unit rows between unbounded preceding and 1 preceding) as reach from i)
select doc_id, page, count(*) filter (coalesce(l > reach + 8, true)) as cols, count(*) as n from w group by doc_id, page
""")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every page by interval merge (2.7.15)."""
    c = layout.columns(relation(spark, sf_dir, ITEMS))
    return c.groupBy("doc_id", "page").agg((F.max("col") + 1).alias("cols"), F.count(F.lit(1)).alias("n"))


@query("broken_paragraphs", f"""
with i as ({ITEMS}),
w as (select *, lag(text) over v as before, lag(label) over v as lb from i window v as (partition by doc_id order by page, unit)),
n as (select *, (not coalesce(not regexp_matches(before, '[.!?:;]$') and lb = label and regexp_matches(text, '^[a-zà-ÿ]'), false))::int as opens from w),
g as (select *, sum(opens) over (partition by doc_id order by page, unit) as para from n)
select doc_id, para::bigint as para, min(page) as page, count(*) as parts, string_agg(text, ' ' order by page, unit) as text from g group by doc_id, para
""")
def broken_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs rejoined over columns and pages (2.7.16, 2.3.22)."""
    return layout.join_broken(relation(spark, sf_dir, ITEMS))


@query("stale_units", """
select doc_id, substr(sha256(text), 1, 16) as hash from documents where substr(sha256(text), 1, 16) not in (select substr(sha256(text), 1, 16) from documents where lang = 'en')
""")
def stale_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text no cached one equals (2.11.3, 2.11.6)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", hash_text(F.col("text")).alias("hash"))
    unit = d.select(F.lit(0).alias("doc_id"), F.col("doc_id").alias("unit"), "hash")
    cached = d.where("lang = 'en'").select(F.lit(0).alias("doc_id"), "hash")
    return cache.stale(unit, cached).select(F.col("unit").alias("doc_id"), "hash")


@query("stage_freshness", """
with i as (select l_orderkey as doc_id, l_linenumber as k, min(l_partkey) as h, min(l_suppkey) as s, count(*) as n from lineitem group by all),
o as (select doc_id, k, n = 1 and h % 9 <> 0 as own from i)
select doc_id, k, bool_and(own) over (partition by doc_id order by k) as fresh from o
""")
def stage_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that need not run again (2.4.19, 2.11.9, 2.2.14)."""
    li = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"), F.count(F.lit(1)).alias("n"))
    status = li.select("doc_id", "k", F.when(F.col("p") % 9 != 0, F.col("p")).alias("hash"), (F.col("n") == 1).alias("done"))
    return cache.stages(li.select("doc_id", "k", F.col("p").alias("hash")), status)


@query("batch_plan", """
with d as (select *, case when lang = 'es' then 'skipped' when quality is null then 'fresh' when toxic = 1 then 'full' when quality = 0 then 'stale' else 'current' end as kind from documents left join labels using (doc_id))
select kind, count(*) as docs, count(*) * 2 as units, sum(n_chars)::bigint as chars from d group by kind
""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch translation would do (2.14.17)."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    stale = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return cache.batch_plan(d.select("doc_id", (F.col("lang") == "es").alias("excluded"), F.col("quality").isNotNull().alias("translated"), F.lit(2).cast("bigint").alias("units"), stale.alias("stale"), F.col("n_chars").alias("chars")))


@query("occurrence_pairs", """
with a as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
n as (select *, row_number() over (partition by doc_id, line order by i) as n from a)
select doc_id, count(*) as pairs, sum(n)::bigint as ranks from n group by doc_id
""")
def occurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th equal line of one version with the n-th of the other (2.5.18, 2.5.20, 2.5.27, 2.3.26)."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    z = lines.zip_same(rows, rows, ["doc_id"], "line", "i")
    return z.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("ranks"))


@query("bigram_dice", """
with p as (select p_partkey, p_name as a, p_brand || p_name as b from part),
ga as (select p_partkey, substr(a, i, 2) as g, count(*) as n from p, lateral (select unnest(generate_series(1, length(a) - 1)) as i) group by all),
gb as (select p_partkey, substr(b, i, 2) as g, count(*) as n from p, lateral (select unnest(generate_series(1, length(b) - 1)) as i) group by all),
hit as (select p_partkey, sum(least(ga.n, gb.n)) as n from ga join gb using (p_partkey, g) group by p_partkey)
select p_partkey, round(2.0 * coalesce(hit.n, 0) / (length(a) + length(b) - 2), 9) as score from p left join hit using (p_partkey)
""")
def bigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice similarity of character bigrams (2.16)."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(dice(F.col("p_name"), F.concat("p_brand", "p_name")), 9).alias("score"))


@query("caption_pairs", """
with l as (select distinct l_orderkey as doc_id, l_linenumber as i, case l_linenumber % 3 when 0 then '![x](a.png)' when 1 then 'Figure ' || l_linenumber || ': seen' else '' end as line from lineitem),
p as (select *, row_number() over (partition by doc_id order by i) as p from l),
img as (select doc_id, i, p, row_number() over (partition by doc_id order by p) as k from p where line like '![%'),
cap as (select doc_id, i, p from p where line like 'Figure%'),
c as (select img.doc_id, img.k, img.i as image, cap.i as caption, case cap.p - img.p when 1 then 1 when 2 then 2 when -1 then 3 when -2 then 4 else 5 end as prio from img join cap using (doc_id)
  where cap.p - img.p between -2 and 2 or (cap.p - img.p between 3 and 8 and not exists (select 1 from p q where q.doc_id = img.doc_id and q.p > img.p and q.p < cap.p and q.line <> ''))),
one as (select doc_id, any_value(image) as image, arg_min(caption, prio) as caption from c where k = 1 group by doc_id),
two as (select c.doc_id, any_value(c.image) as image, arg_min(c.caption, c.prio) as caption from c left join one using (doc_id) where k = 2 and (one.caption is null or c.caption <> one.caption) group by c.doc_id)
select doc_id, image, caption, 'Figure ' || caption as label from (select * from one union all select * from two)
""")
def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and their captions in documents made of parts (2.5.2)."""
    kinds = F.when(F.col("l_linenumber") % 3 == 0, F.lit("![x](a.png)")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Figure "), "l_linenumber", F.lit(": seen"))).otherwise("")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("i"), kinds.alias("line")).distinct()
    return sequences.caption_pairs(rows)


@query("pack_units", """
with recursive d as (select doc_id // 20 as doc_id, doc_id as pos, n_chars as size, lang = 'en' as free, row_number() over (partition by doc_id // 20 order by doc_id) as n from documents),
r as (select doc_id, pos, size, free, n, case when free then 0 else -1 end::bigint as unit, case when free and size >= 1500 then 1 else 0 end::bigint as next, case when free and size < 1500 then size else 0 end::bigint as have from d where n = 1
  union all select d.doc_id, d.pos, d.size, d.free, d.n, case when d.free then r.next else -1 end, case when not d.free then r.next + (r.have > 0)::int when r.have + d.size >= 1500 then r.next + 1 else r.next end,
    case when not d.free or r.have + d.size >= 1500 then 0 else r.have + d.size end from r join d on d.doc_id = r.doc_id and d.n = r.n + 1)
select doc_id, pos, size, free, unit from r
""")
def pack_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents packed into units of translation (2.7.13)."""
    d = load(spark, sf_dir, "documents")
    return sequences.pack_units(d.select(F.floor(F.col("doc_id") / 20).alias("doc_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"), (F.col("lang") == "en").alias("free")))


@query("fuller_authors", """
select s_suppkey, case when s_suppkey % 2 = 0 then 'Ann Lee' else 'A. Lee' end as author from supplier
""")
def fuller_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names in the place of initials, for the same people (2.9.3, 2.4.11)."""
    s = load(spark, sf_dir, "supplier")
    ours = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Ann Lee"))).otherwise(F.array(F.lit("Bo Kim")))
    return s.select("s_suppkey", F.get(bibliography.fuller_authors(F.array(F.lit("A. Lee")), ours), F.lit(0)).alias("author"))


_CELLS = "select p_partkey // 40 as doc_id, p_partkey as row, p_name || ' ' || p_brand as text from part"


@query("reanchor_quotes", f"""
with c as (select *, lower(replace(replace(text, ' ', ''), '-', '')) as t from ({_CELLS})),
a as (select doc_id, row as id, row as old, case when row % 2 = 0 then t else 'xy' || substr(t, 1, 4) || 'q' || substr(t, 6) end as q from c),
held as (select a.doc_id, a.id, c.row, row_number() over (partition by a.id order by abs(c.row - old), c.row) as n from a join c on a.doc_id = c.doc_id and abs(c.row - old) <= 25 and contains(t, q)),
rest as (select * from a where id not in (select id from held)),
j as (select r.id, r.doc_id, c.row, q, t from rest r join c on r.doc_id = c.doc_id and abs(c.row - old) <= 25 and length(t) <= length(q) * 2.5 and length(t) * 2.5 >= length(q)),
ga as (select id, substr(q, i, 2) as g, count(*) as n from rest, lateral (select unnest(generate_series(1, length(q) - 1)) as i) group by all),
gc as (select row, substr(t, i, 2) as g, count(*) as n from c, lateral (select unnest(generate_series(1, length(t) - 1)) as i) group by all),
hit as (select j.id, j.row, sum(least(ga.n, gc.n)) as n from j join ga using (id) join gc on gc.row = j.row and gc.g = ga.g group by all),
s as (select j.doc_id, j.id, j.row, 2.0 * coalesce(hit.n, 0) / (length(q) + length(t) - 2) as score from j left join hit on hit.id = j.id and hit.row = j.row),
b as (select *, row_number() over (partition by id order by score desc, row) as n, coalesce(lead(score) over (partition by id order by score desc, row), 0) as second from s)
select doc_id, id, row, 1.0::double as score, true as sure from held where n = 1
union all select doc_id, id, row, round(score, 9)::double, score >= 0.75 from b where n = 1 and score >= 0.5 and score - second >= 0.1
""")
def reanchor_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes found again among their neighbours, as they were or slightly changed (2.16)."""
    cells = relation(spark, sf_dir, _CELLS.replace("p_partkey // 40", "p_partkey div 40"))
    flat = F.lower(F.regexp_replace("text", "[ -]", ""))
    quote = F.when(F.col("row") % 2 == 0, F.upper("text")).otherwise(F.concat(F.lit("xy"), F.substring(flat, 1, 4), F.lit("q"), F.substring(flat, F.lit(6), F.length(flat))))
    anchors = cells.select("doc_id", F.col("row").alias("id"), quote.alias("quote"), "row")
    return annotations.reanchor(anchors, cells).select("doc_id", "id", "row", F.round("score", 9).alias("score"), "sure")
