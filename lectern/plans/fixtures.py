"""Relations that the queries build from the fixture tables, as SQL that both engines run."""

#: Lines of documents: doc_id, source, i, line.
LINES = "select doc_id, source, lang, text from documents"
#: Headings in several numbering schemes: doc_id, pos, text.
HEADINGS = """
select h.doc_id, h.pos,
  case when h.pos = 7 then case when h.doc_id % 2 = 0 then 'References' else 'Appendix: ' || p.p_name end
       when h.doc_id % 4 = 0 then cast(h.pos as string) || '. ' || p.p_name
       when h.doc_id % 4 = 1 then case h.pos % 3 when 1 then 'IV. ' || p.p_name when 2 then 'B. ' || p.p_name else '3.' || cast(h.pos as string) || ' ' || p.p_name end
       when h.doc_id % 4 = 2 then case h.pos % 3 when 1 then '2 ' || p.p_name when 2 then '2.1 ' || p.p_name else 'A.1.' || cast(h.pos as string) || ' ' || p.p_name end
       else case h.pos % 2 when 1 then p.p_name || '.' else 'IIX. ' || p.p_name end end as text
from (select l_orderkey as doc_id, l_linenumber as pos, min(l_partkey) as pk from lineitem group by l_orderkey, l_linenumber) h
join part p on p.p_partkey = h.pk
"""
#: References: doc_id, label, author, year; several of an author and year in one document.
REFS = """
select l.doc_id, l.label, s.s_name || ' Q' || cast(s.s_suppkey % 7 as string) as author, 1995 + cast(l.label % 2 as int) as year
from (select l_orderkey as doc_id, l_linenumber as label, min(l_suppkey) as sk from lineitem group by l_orderkey, l_linenumber) l
join supplier s on s.s_suppkey = l.sk
"""
#: Texts with numbered markers: doc_id, text.
CITING = """
select o_orderkey as doc_id,
  'see [1] and [2, 4-' || cast(3 + o_orderkey % 5 as string) || '] but not [' || cast(o_orderkey % 12 as string) || '](x) or ![3] nor `[1]` or [5-2]' as text
from orders
"""
#: Terms of papers: paper, pos, term, rendering, policy.
TERMS = """
select paper, cast(row_number() over (partition by paper order by l_orderkey, l_linenumber, l_partkey) as int) as pos,
  case when l_orderkey % 3 = 0 then upper(p_name) when l_orderkey % 3 = 1 then '  ' || p_name else p_name end as term,
  case when l_orderkey % 5 = 0 then '' else p_brand end as rendering, p_type as policy
from (select distinct l_suppkey as paper, l_orderkey, l_linenumber, l_partkey from lineitem) l
join part on p_partkey = l_partkey
"""
#: A library: doc_id, title, mtime, hidden, pinned_at, projects.
LIBRARY = """
select o_orderkey as doc_id, c_name || ' ' || o_orderpriority as title, o_orderdate as mtime, o_orderkey % 11 = 0 as hidden,
  case when o_orderpriority = '1-URGENT' and o_orderkey % 40 = 0 then o_orderkey end as pinned_at, c_mktsegment as segment, c_nationkey as nation
from orders join customer on c_custkey = o_custkey
"""
#: A forest of collections: world, regions, nations; ids are strings, and parents of two rows are broken.
COLLECTIONS = """
select 'w' as id, 'World' as name, cast(null as string) as parent, 0 as ord, 'std' as naming
union all select 'r' || cast(r_regionkey as string), r_name, 'w', 1 + r_regionkey, case when r_regionkey = 2 then 'custom' end from region
union all select 'n' || cast(n_nationkey as string), n_name, case when n_nationkey = 3 then 'missing' else 'r' || cast(n_regionkey as string) end, 100 + n_nationkey,
  case when n_nationkey % 6 = 0 then 'own' end from nation
"""
#: An operation log: doc_id, pos, ts, op, id, item.
OPS = """
select user_id as doc_id, event_id as pos, ts, case event_type when 'view' then 'put' when 'purchase' then 'put' when 'click' then 'del' else event_type end as op,
  event_id % 5 as id, props as item
from events
"""
#: Calls of remote sources: source, ts, failed.
CALLS = "select user_id as source, ts, event_id, event_type = 'error' or event_type = 'click' as failed from events"
#: Layout items in two columns with page furniture: doc_id, page, unit, label, l, t, r, b, text.
ITEMS = """
select cast(floor(l_orderkey / 100) as bigint) as doc_id, cast(l_linenumber as int) as page, cast(row_number() over (partition by floor(l_orderkey / 100), l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_quantity) as int) as unit,
  'text' as label, case when l_partkey % 2 = 0 then 50.0 else 320.0 end + cast(l_quantity as double) as l, cast(l_partkey % 700 as double) as t,
  case when l_partkey % 2 = 0 then 50.0 else 320.0 end + cast(l_quantity as double) + 180.0 as r, cast(l_partkey % 700 as double) + 12.0 as b,
  case when l_suppkey % 3 = 0 then 'ends here.' when l_suppkey % 3 = 1 then 'goes on' else 'Starts and' end as text
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem)
"""
#: Lines of small documents in markdown: doc_id, i (from 0), name, line; consecutive kinds make figures, captions, tables and lists.
MARKDOWN = """
select doc_id, i, p_name as name, case (doc_id + i) % 14
  when 0 then '## ' || cast(i as string) || '.1 ' || p_name when 1 then 'Figure ' || cast(doc_id % 3 as string) || ': ' || p_name when 2 then ''
  when 3 then '![x](a/img-' || cast(doc_id % 5 as string) || '.png)' when 4 then case when doc_id % 7 = 0 then '## Axis ' || p_name else '' end when 5 then case when doc_id % 4 = 0 then 'Figure 1: ' || p_name else '**Fig. ' || cast(doc_id % 2 as string) || '.** &lt;i&gt;' || p_name end
  when 6 then '## ' || p_name when 7 then '| ' || p_name || ' | b |' when 8 then 'Table 4 ' || p_name when 9 then '# <i>Table IX: ' || p_name
  when 10 then '### • ' || p_name when 11 then 'Plain ' || chr(92) || '_text' || chr(92) || '_ of <b>' || p_name || '</b>. Figure 3 shows [[r' || cast(i as string) || ']].' when 12 then '## References'
  else 'Keywords: ' || p_name || ' ![y](b.png) ![z]( c/d.png )' end as line
from (select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as int) as i, min(l_partkey) as pk from lineitem group by l_orderkey, l_linenumber)
join part on p_partkey = pk
"""
