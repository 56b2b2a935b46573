"""Queries on lines, layouts, caches, models and text functions that other queries only use in passing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import annotations, bibliography, cache, grids, layout, library, lines, sequences
from lectern.sources import tables
from lectern.sources.tables import load, relation

from . import query
from .fixtures import MARKDOWN

_HEAD = r"^\s*(#{1,6})\s+(.*)$"
_SECTIONS = rf"""
m as ({MARKDOWN}),
s as (select *, regexp_matches(line, '{_HEAD}') as head, sum(regexp_matches(line, '{_HEAD}')::int) over (partition by doc_id order by i) as section from m),
g as (select doc_id, section, min(i) as first, max(case when head then trim(regexp_extract(line, '{_HEAD}', 2)) end) as heading, string_agg(line, chr(10) order by i) as text from s group by doc_id, section)
"""


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, MARKDOWN)


@query("markdown_headings", rf"""
with m as ({MARKDOWN}) select doc_id, i, length(regexp_extract(line, '{_HEAD}', 1))::int as marks, trim(regexp_extract(line, '{_HEAD}', 2)) as text from m where regexp_matches(line, '{_HEAD}')
""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings outside code fences with their marks (2.7.4)."""
    return lines.headings(_md(spark, sf_dir))


@query("row_sections", rf"""
with m as ({MARKDOWN})
select doc_id, i, last_value(case when regexp_matches(line, '{_HEAD}') then trim(regexp_extract(line, '{_HEAD}', 2)) end ignore nulls) over (partition by doc_id order by i) as section from m
""")
def row_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each row stands under (2.5.10)."""
    head = F.when(F.col("line").rlike(lines.HEADING), F.trim(F.regexp_extract("line", lines.HEADING, 2)))
    return lines.carry_forward(_md(spark, sf_dir), head, "section").select("doc_id", "i", "section")


@query("search_chunks", rf"""
with {_SECTIONS},
c as (select *, last_value(heading ignore nulls) over (partition by doc_id order by section) as near, row_number() over (partition by doc_id order by section) - 1 as row from g)
select doc_id, row::int as row, coalesce(near, '') as heading, text, regexp_matches(regexp_replace(text, '(?m)^\s*#{{1,6}}\s+.*$', '', 'g'), '\S') as searchable from c
""")
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as rows to search, with the heading in force and whether there is a body (2.7.8)."""
    return lines.search_chunks(_md(spark, sf_dir))


@query("aligned_sections", rf"""
with {_SECTIONS},
a as (select doc_id, text, row_number() over (partition by doc_id order by section) as k from g),
b as (select doc_id, 'T ' || text as text, row_number() over (partition by doc_id order by section) as k from g where doc_id % 3 <> 0 or section <> 1),
n as (select doc_id, (select count(*) from a x where x.doc_id = d.doc_id) = (select count(*) from b x where x.doc_id = d.doc_id) as same from (select distinct doc_id from a) d)
select a.doc_id, a.k::int as k, a.text as original, case when same then b.text end as translation from a left join b using (doc_id, k) left join n using (doc_id)
""")
def aligned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of an original beside those of its translation, where both have as many (2.5.9)."""
    s = lines.sections(_md(spark, sf_dir)).select("doc_id", "section", "text")
    other = s.where("doc_id % 3 <> 0 or section <> 1").withColumn("text", F.concat(F.lit("T "), "text"))
    return lines.align(s, other)


_ANCHORS = """
select l_orderkey as doc_id, array(named_struct('side', case when l_orderkey % 2 = 0 then 'ko' else 'en' end, 'row', cast(min(l_linenumber) as int), 'start', 4),
  named_struct('side', case when l_orderkey % 3 = 0 then 'ko' else 'en' end, 'row', cast(max(l_linenumber) as int), 'start', 9), named_struct('side', 'ko', 'row', 99, 'start', 1)) as anchors
from lineitem group by l_orderkey
"""


@query("highlight_order", """
with a as (select l_orderkey as doc_id, min(l_linenumber) as lo, max(l_linenumber) as hi, l_orderkey % 2 <> 0 as e1, l_orderkey % 3 <> 0 as e2 from lineitem group by l_orderkey)
select doc_id, (case when e1 then lo when e2 then hi else lo end)::int as row, (case when e1 then 4 when e2 then 9 else 4 end)::int as start,
  case when e1 and e2 then 'en:' || lo || ' ko:99' when not e1 and not e2 then 'ko:' || lo when e1 then 'en:' || lo || ' ko:' || hi else 'ko:' || lo || ' en:' || hi end as kept from a
""")
def highlight_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a highlight stands in its document, and its first anchor on each side (2.8.4, 2.9.1)."""
    a = relation(spark, sf_dir, _ANCHORS)
    at, kept = annotations.document_order(F.col("anchors")), annotations.one_anchor_a_side(F.col("anchors"))
    return a.select("doc_id", at["row"].alias("row"), at["start"].alias("start"), F.array_join(F.transform(kept, lambda k: F.concat_ws(":", k["side"], k["row"].cast("string"))), " ").alias("kept"))


@query("known_memberships", """
select c_custkey, array_to_string(list_filter(['n' || c_nationkey, 'x', 'n' || (c_custkey % 25)], lambda x: x <> 'x'), ',') as ids from customer where c_nationkey <> c_custkey % 25
union all select c_custkey, 'n' || c_nationkey from customer where c_nationkey = c_custkey % 25
""")
def known_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that a document may belong to, each once and in order (2.9.5)."""
    known = load(spark, sf_dir, "nation").agg(F.collect_list(F.concat(F.lit("n"), "n_nationkey")).alias("known"))
    a, b = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), F.col("c_custkey") % 25)
    c = load(spark, sf_dir, "customer").select("c_custkey", F.array(a, F.lit("x"), b, a).alias("ids")).join(F.broadcast(known))
    return c.select("c_custkey", F.array_join(library.known_memberships(F.col("ids"), F.col("known")), ",").alias("ids"))


_NUMBERS = """
select cast(floor(l_orderkey / 100) as bigint) as doc_id, cast(l_linenumber % 3 + 1 as int) as page, cast((l_orderkey % 100) * 10 + l_linenumber as string) as text, case when l_orderkey % 4 = 0 then 10.0 else 300.0 + l_linenumber * 20 end as l, cast(l_orderkey * 10 + l_linenumber as double) as t
from (select distinct l_orderkey, l_linenumber from lineitem)
"""


@query("line_number_columns", f"""
with i as ({_NUMBERS.replace(" as string)", " as varchar)")}),
n as (select *, text::int as v, coalesce((l - lag(l) over (partition by doc_id, page order by l) > 6)::int, 0) as new from i),
g as (select *, sum(new) over (partition by doc_id, page order by l range between unbounded preceding and current row) as g from n),
u as (select *, coalesce(v > lag(v) over (partition by doc_id, page, g order by t), true) as up from g),
f as (select doc_id, page, g, count(*) as n, bool_and(up) as up, min(l) as l from u group by all having count(*) >= 2 and bool_and(up))
select doc_id, floor(l / 6)::bigint as band, count(distinct page) as pages from f group by all having count(distinct page) >= 2
""")
def line_number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of numbers that count up beside the text on several pages (2.6.11)."""
    return layout.gutters(relation(spark, sf_dir, _NUMBERS), least=2)


_BOXES = """
select p_partkey as doc_id, 1 as page, p_size % 5 as num, p_partkey as did, cast(p_size as double) as l, 0.0 as t, cast(p_size + 10 as double) as r, 10.0 as b from part
"""


@query("paired_descriptions", """
with d as (select p_partkey as doc_id, p_size % 5 as num, p_size as l from part)
select doc_id, doc_id as did, case when num = 1 then 1 else 0 end::int as fid, case when l <= 24 then 'place' else 'number' end as how from d where l <= 24 or num in (0, 1)
""")
def paired_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of figures beside the figures, by place and then by number (2.5.1, 2.10.14)."""
    d = relation(spark, sf_dir, _BOXES)
    box = lambda k: F.struct(F.lit(k).alias("fid"), F.lit(k).alias("num"), F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.lit(30.0).alias("r"), F.lit(10.0).alias("b"))
    f = d.select("doc_id", "page", F.explode(F.array(box(0), box(1))).alias("f")).select("doc_id", "page", "f.*")
    return layout.pair_descriptions(d, f)


@query("numbered_entries", """
select p_partkey as doc_id, unnest([1, 2]) as marker, unnest(['[1] ' || p_name || ' goes on', '[2] ' || p_brand]) as text from part
""")
def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a reference list with the marker that they belong to (2.10.5)."""
    row = lambda t, text: F.struct(F.lit(1).alias("page"), F.lit(t).alias("t"), F.lit(0.0).alias("l"), text.alias("text"))
    rows = F.array(row(0.0, F.lit("before")), row(1.0, F.concat(F.lit("[1] "), "p_name")), row(2.0, F.lit(" goes on ")), row(3.0, F.concat(F.lit("[2] "), "p_brand")))
    return layout.assign_lines(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.slice(rows, 2, 3)).alias("r")).select("doc_id", "r.*"))


@query("line_heights", """
with v as (select l_orderkey as doc_id, list_sort(list(l_quantity)) as v from lineitem group by l_orderkey)
select doc_id, v[least(floor(len(v) * 0.25), len(v) - 1)::int + 1] as low, v[least(floor(len(v) * 0.9), len(v) - 1)::int + 1] as high from v
""")
def line_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower percentiles of the values of each document (2.10.13)."""
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("v"))
    return g.select("doc_id", layout.lower_percentile(F.col("v"), 0.25).alias("low"), layout.lower_percentile(F.col("v"), 0.9).alias("high"))


@query("cached_units", """
select p_partkey as doc_id, 0 as unit, case p_size % 3 when 0 then 'whole' when 1 then 'a' || chr(10) || chr(10) || 'b' end as text from part
""")
def cached_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units answered from the cache, whole or by their pieces (2.11.2)."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 3).alias("k"))
    pieces = p.select("doc_id", F.lit(0).alias("unit"), F.posexplode(F.array(F.lit("ha"), F.lit("hb"))).alias("pos", "hash"))
    held = F.when(F.col("k") == 0, F.array(F.struct(F.lit("h").alias("hash"), F.lit("whole").alias("text")))).otherwise(
        F.array(F.struct(F.lit("ha").alias("hash"), F.lit("a").alias("text")), F.struct(F.when(F.col("k") == 1, "hb").otherwise("other").alias("hash"), F.lit("b").alias("text"))))
    stored = p.select("doc_id", F.explode(held).alias("c")).select("doc_id", "c.*")
    return cache.lookup(p.select("doc_id", F.lit(0).alias("unit"), F.lit("h").alias("hash")), pieces, stored)


@query("first_sources", """
select p_partkey as id, case p_size % 3 when 0 then 'a' when 1 then 'b' else 'c' end as source, p_partkey * 10 + p_size % 3 as rid from part
""")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source on the ladder that found a record (2.5.8)."""
    p = load(spark, sf_dir, "part")
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = p.select(F.col("p_partkey").alias("id"), "p_size", F.posexplode(names).alias("priority", "source")).where(F.col("priority") >= F.col("p_size") % 3)
    return bibliography.ladder(rows.withColumn("rid", F.col("id") * 10 + F.col("priority")))


@query("bibtex_entries", """
select p_partkey::varchar as path, unnest([0, 1]) as pos, unnest(['article', 'misc']) as kind, unnest(['k' || p_partkey, 'm']) as key, unnest([p_name || ' {x}', 'only ' || p_brand]) as title, unnest([(1990 + p_size)::varchar, null]) as year from part
""")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of reference files (2.1.15)."""
    text = F.concat(
        F.lit("junk @article{k"), "p_partkey", F.lit(",\n  Title = {"), "p_name", F.lit(" {x}},\n  year = "), 1990 + F.col("p_size"), F.lit("\n}\n@misc{m, title = \"only "), "p_brand", F.lit("\"}")
    )
    files = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text"))
    found = tables.bibtex(files)
    return found.select("path", "pos", "kind", "key", F.element_at("fields", F.lit("title")).alias("title"), F.element_at("fields", F.lit("year")).alias("year"))


@query("json_columns", """
select event_id, case when event_id % 5 <> 0 then try_cast(json_extract_string(props, '$.k') as int) end as k, event_id % 5 = 0 as corrupt from events
""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of JSON as structs; what does not parse is set aside (2.1.3, 2.1.14, 2.1.16)."""
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    parsed = tables.json_column(e, "props", "k int")
    bad = F.col("event_id") % 5 == 0
    return parsed.select("event_id", F.when(~bad, F.col("props.k")).alias("k"), (F.coalesce(F.col("props.k").isNull(), F.lit(True)) & bad).alias("corrupt"))


def _apply(df: DataFrame, how, kind: str, *columns: str) -> DataFrame:  # noqa: ANN001
    """df with `out`, what a function makes of some columns, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([how(*x) for x in zip(*cols, strict=True)], dtype=object)

    return df.withColumn("out", run(*columns))


@query("protected_spans", """
select p_partkey, 'see ⟦1⟧ and ⟦0⟧, ⟦2⟧ in ⟦3⟧ ' || p_name as masked, 4 as n, true as same from part
""")
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a translation must not touch, masked and put back (2.10.6)."""
    text = F.concat(F.lit("see [x](y) and `code "), "p_name", F.lit("`, https://x.org/a in Fig. 3 "), "p_name")
    p = load(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    masked = _apply(p, lambda t: sequences.protect(t)[0], "string", "text").withColumnRenamed("out", "masked")
    n = _apply(masked, lambda t: len(sequences.protect(t)[1]), "int", "text").withColumnRenamed("out", "n")
    back = _apply(n, lambda t: sequences.restore(*sequences.protect(t)), "string", "text")
    return back.select("p_partkey", "masked", "n", (F.col("out") == F.col("text")).alias("same"))


@query("translation_violations", """
select p_partkey, case p_size % 5 when 0 then '' when 1 then 'headings' when 2 then 'links pipes' when 3 then 'math' else 'images code' end as wrong from part
""")
def translation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures that a translation lost or added (2.4.12)."""
    k = F.col("p_size") % 5
    source = F.concat(F.lit("# "), "p_name", F.lit("\nsee [a](b) and `c` $x_1$ ![i](j) | k"))
    to = F.when(k == 0, "# T\nsiehe [a](b) und `c` $x_1$ ![i](j) | k").when(k == 1, "## T\nsiehe [a](b) und `c` $x_1$ ![i](j) | k").when(k == 2, "# T\nsiehe a und `c` $x_1$ ![i](j) k")
    to = to.when(k == 3, "# T\nsiehe [a](b) und `c` x_1 ![i](j) | k").otherwise("# T\nsiehe [a](b) und c $x_1$ | k")
    p = load(spark, sf_dir, "part").select("p_partkey", source.alias("source"), to.alias("target"))
    return _apply(p, lambda a, b: " ".join(sequences.violations(a, b)), "string", "source", "target").select("p_partkey", F.col("out").alias("wrong"))


@query("kept_content", """
select p_partkey, case p_size % 3 when 0 then '' when 1 then 'lost' else 'grown' end as wrong from part
""")
def kept_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten layouts that lost content or grew (2.4.13)."""
    k = F.col("p_size") % 3
    before = F.concat(F.lit("Title "), "p_name", F.lit(" and a body of words"))
    after = F.when(k == 0, F.concat(F.lit("# "), before)).when(k == 1, F.lit("Title and")).otherwise(F.concat(before, F.lit(" "), before))
    p = load(spark, sf_dir, "part").select("p_partkey", before.alias("a"), after.alias("b"))
    return _apply(p, lambda a, b: " ".join(sequences.kept_content(a, b)), "string", "a", "b").select("p_partkey", F.col("out").alias("wrong"))


@query("split_texts", """
select o_orderkey, 3 as n, true as same from orders
""")
def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pieces at paragraphs, which join again (2.7.14)."""
    part = F.concat(F.repeat(F.lit("w "), 20), "o_orderstatus", F.lit("\n\n"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(part, part, part, part, part).alias("text"))
    n = _apply(o, lambda t: len(sequences.split_text(t, 90)), "int", "text").withColumnRenamed("out", "n")
    return _apply(n, lambda t: "".join(sequences.split_text(t, 90)), "string", "text").select("o_orderkey", "n", (F.col("out") == F.col("text")).alias("same"))


@query("assigned_records", """
select p_partkey, case when p_size % 2 = 0 then '0:0 1:1 2:3' else '0:0 2:2' end as pairs from part
""")
def assigned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences matched by equal texts, gaps only where both sides count the same (2.5.17)."""
    other = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.lit("y"), F.lit("new"), F.lit("z"))).otherwise(F.array(F.col("p_name"), F.lit("q"), F.lit("z")))
    mine = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.lit("y"), F.lit("z"))).otherwise(F.array(F.col("p_name"), F.lit("q1"), F.lit("z")))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", mine.alias("a"), other.alias("b"))

    def pairs(a: list, b: list) -> str:
        found = sequences.assign(list(a), list(b))
        return " ".join(f"{i}:{j}" for i, j in sorted(found.items()) if list(a)[i] == list(b)[j])

    return _apply(p, pairs, "string", "a", "b").select("p_partkey", F.col("out").alias("pairs"))


@query("sentence_alignment", """
select p_partkey, case when p_size % 2 = 0 then '0+1=0+1 1+1=1+1' else '0+1=0+2 1+1=2+1' end as pairs from part
""")
def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a text beside those of its translation, by their lengths (2.16)."""
    a = F.lit("One long sentence stands here and goes on for a while. Short one.")
    b = F.when(F.col("p_size") % 2 == 0, "Ein langer Satz steht hier und geht noch weiter. Kurz.").otherwise("Ein langer Satz steht hier. Er geht noch weiter. Kurz ja.")

    def pairs(x: str, y: str) -> str:
        sizes = lambda t: [j - i for i, j in sequences.split_sentences(t)]
        return " ".join(f"{i}+{m}={j}+{n}" for i, m, j, n in sequences.align_sentences(sizes(x), sizes(y)) or [])

    return _apply(load(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b")), pairs, "string", "a", "b").select("p_partkey", F.col("out").alias("pairs"))


@query("sibling_spans", """
select p_partkey as id, 13::int as start, 25::int as "end", 1.0::double as score from part where p_size % 2 = 0
""")
def sibling_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote found again through the sentence that is paired with it (2.16)."""
    quote = F.when(F.col("p_size") % 2 == 0, "Two is here.").otherwise("Nothing like it 123")
    rows = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), quote.alias("quote"), F.lit("One is here. Two is here.").alias("text"), F.lit("Eins ist hier. Zwei ist da.").alias("sibling"),
        F.lit(15).alias("start"), F.lit(27).alias("end"), F.lit(True).alias("first"),
    )
    return sequences.sibling_spans(rows)


@query("collapsed_rows", """
select p_partkey, case when p_size % 2 = 0 then 'a1 a2|' || p_name || ';b|y' end as rows from part
""")
def collapsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that collapsed into one, where the columns agree (2.6.21, 2.10.12)."""

    def rows(name: str, even: int) -> str | None:
        found = grids.split_rows([["a1", "a2", "b"], [name, "y"]], [[True, False, True], [True, bool(even)]])
        return ";".join("|".join(r) for r in found) if found else None

    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 2 == 0).cast("int").alias("even"))
    return _apply(p, rows, "string", "p_name", "even").select("p_partkey", F.col("out").alias("rows"))


@query("model_answers", """
select p_partkey, case when p_size % 4 <> 0 then 'say: ' || p_name end as answer, case when p_size % 4 = 0 then 'failed: ValueError' else 'ok' end as status from part
""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an injected model, failures as data (2.1.24, 2.11.4, 2.13.1, 2.13.2)."""

    def call(prompt: str, text: str) -> str:
        if text.startswith("!"):
            raise ValueError(text)
        return f"{prompt}: {text}"

    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("!"), "p_name")).otherwise(F.col("p_name")).alias("text"))
    return sequences.with_model(p, call, "say").drop("text")
