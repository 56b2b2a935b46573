"""Operators on small relations with known answers."""

from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.similarity import matching_ratio, may_reach, ratio
from lectern.operators import annotations, bibliography, cache, citations, headings, layout, library, lines, search, sequences, terms
from lectern.plans import citing, repairing
from lectern.sources import tables
from lectern.streaming.oplog import breaker_stream, fold_stream


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("inner", "want"), [("1", [1]), ("1, 3-5", [1, 3, 4, 5]), ("5-3", None), ("1-200", None), ("7–9", [7, 8, 9]), ("a", None)])
def test_label_ranges(spark, inner, want):
    assert one(spark, T.expand_range(F.col("c")), c=inner) == want


@pytest.mark.parametrize(("numeral", "value"), [("IV", 4), ("MCMXC", 1990), ("12", 12), ("IIX", None), ("", None)])
def test_numerals(spark, numeral, value):
    assert one(spark, T.number_value(F.col("c")), c=numeral) == value


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("c")), c="The *walking* classes and \\alpha CATS, 설문조사!") == ["walk", "classe", "cat", "설문", "문조", "조사"]


def test_front_labels_titles_and_venues(spark):
    assert one(spark, T.is_front_label(F.col("c")), c="ACMReference Format:") and not one(spark, T.is_front_label(F.col("c")), c="Introduction")
    assert not one(spark, T.usable_title(F.col("c")), c="3. Related   Work") and one(spark, T.usable_title(F.col("c")), c="On the nature of things")
    assert one(spark, T.venue_or_blank(F.col("c")), c="arXiv.org") == "" and one(spark, T.venue_or_blank(F.col("c")), c=" Proc. X , ") == "Proc. X"


def test_levels_of_mixed_numbering(spark):
    rows = ["I. Intro", "A. First", "1. Deep", "1.1 Deeper", "References", "No number", "A.1.2 App"]
    got = headings.relevel(spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id int, pos int, text string")).orderBy("pos").collect()
    assert [r.level for r in got] == [1, 2, 3, 4, 1, 1, 4] and [r.needs_review for r in got][5] and got[0].mode == "roman-mixed" and got[6].depth == 3
    flat = headings.relevel(spark.createDataFrame([(1, 0, "2.3.1 X"), (1, 1, "IIII. Y")], "doc_id int, pos int, text string")).orderBy("pos").collect()
    assert [(r.level, r.scheme) for r in flat] == [(3, "dotted-arabic"), (1, "none")]


def test_fences_sections_and_chunks(spark):
    text = "lead\n# One\nbody\n```\n# not\n```\n## Two\n\n# Three\nend\n"
    rows = lines.lines(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))
    assert [(r.marks, r.text) for r in lines.headings(rows).orderBy("i").collect()] == [(1, "One"), (2, "Two"), (1, "Three")]
    chunks = lines.search_chunks(rows).orderBy("row").collect()
    assert [(c.row, c.heading, c.searchable) for c in chunks] == [(0, "", True), (1, "One", True), (2, "Two", False), (3, "Three", True)]
    assert "```\n# not\n```" in chunks[1].text
    assert [r.text for r in lines.paragraphs(rows).orderBy("block").collect()][-1] == "# Three\nend"


def test_alignment_is_null_where_counts_differ(spark):
    a = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, section int, text string")
    b = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 0, "p"), (2, 1, "q")], "doc_id int, section int, text string")
    assert [(r.original, r.translation) for r in lines.align(a, b).orderBy("doc_id", "k").collect()] == [("a", "x"), ("b", "y"), ("c", None)]


def test_author_year_suffixes(spark):
    refs = spark.createDataFrame([(1, 3, "Ann Lee", 2020), (1, 1, "Bo Lee", 2020), (1, 2, "Kim, C", 2020)], "doc_id int, label int, author string, year int")
    cites = spark.createDataFrame([(1, "lee", 2020, s) for s in ("", "a", "b", "z")] + [(1, "kim", 2020, ""), (1, "nobody", 2020, "")], "doc_id int, surname string, year int, suffix string")
    got = {(r.surname, r.suffix): r.label for r in citations.match_author_year(cites, refs).collect()}
    assert got == {("lee", ""): 1, ("lee", "a"): 1, ("lee", "b"): 3, ("lee", "z"): 1, ("kim", ""): 2, ("nobody", ""): None}


def test_identity_gate(spark):
    df = spark.createDataFrame(
        [(1, 0.98, "A long enough title", False, False), (2, 0.98, "Cognitive Offloading", False, False), (3, 0.98, "Cognitive Offloading", True, False),
         (4, 0.95, "A long enough title", False, False), (5, 0.95, "A long enough title", False, True), (6, 0.5, "A long enough title of a work", True, False)],
        "i int, s double, t string, shared boolean, close boolean",
    )
    other = F.when(F.col("i") == 6, "A long enough title of a work: with a subtitle").otherwise("x")
    ok = bibliography.gate(F.col("s"), F.col("t"), other, F.col("shared"), F.col("close"))
    assert [r.ok for r in df.select("i", ok.alias("ok")).orderBy("i").collect()] == [True, False, True, False, True, True]
    assert df.select(ratio(F.col("t"), F.col("t")).alias("r")).first().r == 1.0 and matching_ratio("abcd", "bcde") == 0.75


def test_collections_with_cycles_and_orphans(spark):
    rows = [("a", "A", None, 0, None), ("b", "B", "a", 1, "x"), ("c", "C", "b", 2, None), ("d", "D", "gone", 3, None), ("e", "E", "f", 4, "y"), ("f", "F", "e", 5, None), ("g", "G", "g", 6, None)]
    df = spark.createDataFrame(rows, "id string, name string, parent string, ord int, flag string")
    tree = [(r.id, r.depth) for r in library.depth_first(df).orderBy("place").collect()]
    assert tree == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 0), ("f", 0), ("g", 0)]
    assert {r.id: r.value for r in library.inherited(df, "flag").collect()} == {"a": None, "b": "x", "c": "x", "d": None, "e": "y", "f": None, "g": None}


def test_effective_terms_keep_places(spark):
    s = "key string, pos int, term string, rendering string, policy string"
    paper = spark.createDataFrame([("x", 1, "X", "p", "t"), ("y", 2, "Y", "p", "t")], s)
    coll = spark.createDataFrame([("z", 1, "Z", "c", "t"), ("y", 2, "Y", "c", "t")], s)
    assert [(r.key, r.rendering, r.origin) for r in terms.effective(paper, coll).orderBy("place").collect()] == [("x", "p", "paper"), ("y", "c", "collection"), ("z", "c", "collection")]


def test_notes_come_first_and_empty_hits_fall_back(spark):
    chunks = spark.createDataFrame([(i, i != 1) for i in range(6)], "row int, searchable boolean")
    ranked = spark.createDataFrame([(4, 2.0), (5, 1.0)], "row int, score double")
    notes = spark.createDataFrame([(5,), (0,)], "row int")
    order = lambda *a: [r.row for r in search.retrieve(*a).orderBy("place").collect()]
    assert order(chunks, ranked, notes, "my notes?", 3) == [5, 0, 4] and order(chunks, ranked, notes, "what is it", 3) == [4, 5]
    assert order(chunks, ranked.limit(0), notes.limit(0), "what", 8) == [0, 2, 3]


def test_spatial_pairs(spark):
    box = "doc_id int, page int, num int, l double, t double, r double, b double"
    figs = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0, 10), (1, 1, 2, 0.0, 200.0, 100.0, 300.0, 11)], box + ", fid int")
    alts = spark.createDataFrame([(1, 1, 2, 10.0, 10.0, 50.0, 50.0, 1), (1, 1, None, 0.0, 250.0, 100.0, 350.0, 2), (1, 9, 2, 0.0, 0.0, 1.0, 1.0, 3)], box + ", did int")
    assert {(r.did, r.fid, r.how) for r in layout.pair_descriptions(alts, figs).collect()} == {(1, 10, "place"), (3, 11, "number")}


def test_gutters_and_columns(spark):
    num = [(1, p, i, "n", 20.0 + i % 2, 10.0 * i, 30.0, 10.0 * i + 8, str(p * 50 + i)) for p in (1, 2) for i in range(8)]
    body = [(1, p, 100 + i, "t", 53.0 if i < 4 else 317.0, 20.0 * (i % 4), 295.0 if i < 4 else 559.0, 20.0 * (i % 4) + 10, "word 7") for p in (1, 2) for i in range(8)]
    items = spark.createDataFrame(num + body, "doc_id int, page int, unit int, label string, l double, t double, r double, b double, text string")
    assert [(r.doc_id, r.pages) for r in layout.gutters(items).collect()] == [(1, 2)]
    text = items.where("label = 't'")
    assert layout.columns(text).groupBy("page").agg(F.countDistinct("col").alias("n")).first().n == 2
    assert layout.reading_order(text).where("breaks").count() == 0


def test_cache_needs_all_pieces(spark):
    units = spark.createDataFrame([(1, 1, "u1"), (1, 2, "u2"), (1, 3, "u3")], "doc_id int, unit int, hash string")
    pieces = spark.createDataFrame([(1, 2, 0, "a"), (1, 2, 1, "b"), (1, 3, 0, "a"), (1, 3, 1, "no")], "doc_id int, unit int, pos int, hash string")
    stored = spark.createDataFrame([(1, "u1", "U"), (1, "a", "A"), (1, "b", "B")], "doc_id int, hash string, text string")
    assert {r.unit: r.text for r in cache.lookup(units, pieces, stored).collect()} == {1: "U", 2: "A\n\nB", 3: None}


OPS = [(1, 1.0, "put", 7, "a"), (1, 2.0, "put", 8, "b"), (1, 3.0, "del", 7, None), (2, 1.0, "put", 7, "z"), (1, 4.0, "put", 7, "c"), (1, 5.0, "put", 8, "d"), (1, 5.5, "x", 9, "q"), (2, 0.5, "del", 7, None)]


def test_fold_keeps_created_and_restarts_after_del(spark):
    ops = spark.createDataFrame([(*o, i) for i, o in enumerate(OPS)], "doc_id bigint, ts double, op string, id bigint, item string, pos int")
    got = {(r.doc_id, r.id): (r.item, r.created) for r in annotations.fold(annotations.latest_ops(ops)).collect()}
    assert got == {(1, 7): ("c", 4.0), (1, 8): ("d", 2.0), (2, 7): ("z", 1.0)}


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    for k, part in enumerate((OPS[:4], OPS[4:7])):
        spark.createDataFrame(part, "doc_id bigint, ts double, op string, id bigint, item string").coalesce(1).write.json(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("doc_id bigint, ts double, op string, id bigint, item string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*"))
    seen = {}

    def keep(df, _):
        by = {}
        for r in df.collect():
            by.setdefault(r.doc_id, {})[r.id] = (r.item, r.created)
        seen.update(by)

    q = fold_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert seen == {1: {7: ("c", 4.0), 8: ("d", 2.0)}, 2: {7: ("z", 1.0)}}


def test_breaker_stream_opens_and_pauses(spark, tmp_path):
    calls = [("s", float(t), f) for t, f in enumerate([True, True, False, True, True, True, True, True, True])]
    spark.createDataFrame(calls, "source string, ts double, failed boolean").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, ts double, failed boolean").json(str(tmp_path / "in"))
    out = []
    q = breaker_stream(stream, pause=2.0).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and [(r.ts, r.until) for r in out] == [(5.0, 7.0)]


def test_reanchor_by_quote_and_by_likeness(spark):
    cells = spark.createDataFrame([(1, 0, "Something else"), (1, 3, "The quick brown fox, jumps"), (1, 4, "over the lazy dog today")], "doc_id int, row int, text string")
    anchors = spark.createDataFrame([(1, "a", "quick  Brown fox", 1), (1, "b", "over a lazy dog today", 9), (1, "c", "nothing like it at all", 2)], "doc_id int, id string, quote string, row int")
    assert {(r.id, r.row, r.sure) for r in annotations.reanchor(anchors, cells).collect()} == {("a", 3, True), ("b", 4, True)}


def test_bibtex_entries():
    text = '@article{k1,\n title = {A {Nested} title},\n year = 2020,\n note="q"}\n@broken{x, title={never\n@book{k2, author = {B}}'
    got = tables.parse_bibtex(text)
    assert got[0] == {"kind": "article", "key": "k1", "fields": {"title": "A {Nested} title", "year": "2020", "note": "q"}} and got[-1]["key"] == "k2"


def test_captions_pair_once():
    rows = ["![](a.png)", "Figure 1: first", "![](b.png)", "", "(a) sub", "Fig. 2. second", "Table 3 shows", "![](c.png)", "prose", "Figure 9: far"]
    assert sequences.pair_captions(rows) == [(0, 1, "Figure 1"), (2, 5, "Figure 2"), (7, 9, "Figure 9")]
    assert sequences.pair_captions(rows[:9]) == [(0, 1, "Figure 1"), (2, 5, "Figure 2"), (7, 6, "Table 3")]


def test_merge_keeps_both_sides_and_counts_conflicts():
    base = "a\nb\nc\nd\ne"
    assert sequences.merge3(base, "A\nb\nc\nd\ne", "a\nb\nc\nd\nE") == ("A\nb\nc\nd\nE", 0, 0)
    assert sequences.merge3(base, "a\nB\nc\nd\ne", "a\nX\nc\nd\ne") == ("a\nB\nc\nd\ne", 1, 0)
    assert sequences.merge3(base, "a\nB\nc\nd\ne", "a\nB\nc\nd\ne") == ("a\nB\nc\nd\ne", 0, 0)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab$`#\n !()[]x.", max_size=200), st.integers(1, 40))
def test_round_trips(text, most):
    assert "".join(sequences.split_text(text, most)) == text
    assert sequences.restore(*sequences.protect(text)) == text
    assert sequences.violations(text, text) == [] and sequences.kept_content(text, text) == []
    assert all(text[a:b] == text[a:b].strip() or not text.strip() for a, b in sequences.split_sentences(text)[1:])


def test_sentences_and_their_alignment():
    text = "See Fig. 2 (e.g. this. one) here. It works! J. Doe agrees, 3.5 times. and so on."
    assert [text[a:b] for a, b in sequences.split_sentences(text)] == ["See Fig. 2 (e.g. this. one) here.", "It works!", "J. Doe agrees, 3.5 times. and so on."]
    assert sequences.align_sentences([10, 20], [11, 19]) == [(0, 1, 0, 1), (1, 1, 1, 1)]
    assert sequences.align_sentences([40, 20], [20, 20, 20]) == [(0, 1, 0, 2), (1, 1, 2, 1)]


def test_packing_and_assignment():
    assert sequences.pack([1000, 600, 50, 10, 2000], [True, True, True, False, True]) == [0, 0, 1, -1, 2]
    assert sequences.assign(["a", "x", "b", "c"], ["a", "y", "b", "p", "q", "c"]) == {0: 0, 1: 1, 2: 2, 3: 5}


def test_model_failures_are_rows(spark):
    def call(prompt, text):
        if text == "bad":
            raise ValueError
        return prompt + text

    df = spark.createDataFrame([("ok",), ("bad",)], "text string")
    assert {tuple(r) for r in sequences.with_model(df, call, "p:").collect()} == {("ok", "p:ok", "ok"), ("bad", None, "failed: ValueError")}


def test_abstract_by_marker_and_by_length(spark):
    long = "This is prose that goes on and on about a matter of some weight. " * 4
    rows = [(1, 0, "# Title"), (1, 1, "Ann Lee"), (1, 2, "Abstract"), (1, 3, long), (1, 4, "# 1 Intro"), (1, 5, long * 3), (2, 0, "# Title"), (2, 1, long), (2, 2, "# 1 Intro"), (2, 3, long * 3), (3, 0, "short")]
    from lectern.operators.frontmatter import abstract

    got = {r.doc_id: r.abstract for r in abstract(spark.createDataFrame(rows, "doc_id int, block int, text string")).collect()}
    assert got == {1: long.strip(), 2: long.strip(), 3: None}


def test_exports_leave_fences_alone(spark):
    from lectern.operators.frontmatter import export_lines

    rows = lines.lines(spark.createDataFrame([(1, "[1](#ref-1)\n```\n[1](#ref-1)\n```\n[2](#ref-2)")], "doc_id int, text string"))
    urls = spark.createDataFrame([(1, "1", "http://x")], "doc_id int, label string, url string")
    got = [r.line for r in export_lines(rows, urls, "links").orderBy("i").collect()]
    assert got == ["[1](http://x)", "```", "[1](#ref-1)", "```", "[2](#ref-2)"]
    assert [r.line for r in export_lines(rows, urls, "blocks").orderBy("i").collect()][0] == "[1](#^ref-1)"


def test_collapsed_table_rows_split_only_where_columns_agree():
    from lectern.operators.grids import connected, row_starts, split_rows

    assert split_rows([["a", "b c"], ["1", "2"]], [[True, True], [True, True]]) == [["a", "1"], ["b c", "2"]]
    assert split_rows([["a", "b"], ["1", "2"]], [[True, False], [True, True]]) is None
    assert row_starts([(10, 90), (30, 40), (10, 95)], 100.0) == [True, False, True]
    assert connected([(0, 0, 10, 10), (50, 50, 60, 60), (11, 0, 20, 10), (20, 9, 30, 30)]) == [0, 1, 0, 0]


def test_guarded_writes_and_glosses(spark):
    from lectern.operators import writing

    stored = spark.createDataFrame([(1, "x" * 100, "s"), (2, "keep", "s")], "id int, text string, stamp string")
    writes = spark.createDataFrame([(1, "short", "s"), (2, "new", "old"), (3, "first", None), (2, "", "s")], "id int, text string, expect string")
    assert sorted((r.id, r.outcome) for r in writing.compare_and_set(stored, writes).collect()) == [(1, "trashed"), (2, "conflict"), (2, "deleted"), (3, "written")]
    units = spark.createDataFrame([(1, 0, "A (a) here"), (1, 1, "again A (a)"), (2, 0, "none")], "doc_id int, pos int, text string")
    firsts = writing.first_use(units, spark.createDataFrame([(1, "a", "A (a)")], "doc_id int, term string, gloss string"))
    got = writing.drop_later_glosses(units, firsts, F.regexp_replace("gloss", r" \(.*\)$", "")).orderBy("doc_id", "pos").collect()
    assert [r.text for r in got] == ["A (a) here", "again A", "none"]


def test_reference_tables_meet_their_lines_without_a_broadcast(spark, sf):
    df = repairing.unwrapped_references(spark, sf)
    assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_tables_of_references_are_unwrapped(spark):
    row = lambda d, r, c, x, t, spans=False: (d, 0, r, c, x, t, spans, True)
    cells = [
        row(1, 0, 0, 10.0, "[1]"), row(1, 0, 1, 30.0, "a"), row(1, 1, 0, 10.0, "[2]"), row(1, 1, 1, 30.0, "b"),
        row(2, 0, 0, 10.0, "[1]"), row(2, 0, 1, 30.0, "a"), row(2, 1, 0, 10.0, "[3]"), row(2, 1, 1, 30.0, "b"),
        row(3, 0, 0, 10.0, "[1]"), row(3, 0, 1, 30.0, "a"), row(3, 1, 0, 10.0, "[2]"), row(3, 1, 1, 30.0, "b", True),
        row(4, 0, 1, 30.0, "a"), row(4, 1, 1, 30.0, "b"), row(5, 0, 0, 10.0, "[1]"), row(5, 0, 1, 30.0, "a"),
    ]
    lines = [(d, 0, b, x, t) for d in range(1, 6) for b, x, t in [(1.0, 10.0, "[1]"), (1.0, 30.0, "a"), (2.0, 10.0, "[2]"), (2.0, 30.0, "b")]]
    c = spark.createDataFrame(cells, "doc_id int, table int, row int, col int, l double, text string, spans boolean, under boolean")
    got = layout.unwrapped_references(c, spark.createDataFrame(lines, "doc_id int, table int, base double, l double, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, "a"), (1, 0, 2, "b")]


@pytest.mark.parametrize(
    ("own", "doi", "want"),
    [("", "10.48550/arXiv.2101.010001", "2101.010001"), ("", "10.48550/arXiv.2101.01000", "2101.01000"), ("arXiv:0704.0001v2", "", "0704.0001"), ("2101.01234567", "10.1/x", "2101.01234567"), ("", "10.1/2101.01000", ""), ("", None, "")],
)
def test_numbers_of_preprints_are_whole(spark, own, doi, want):
    assert one(spark, T.arxiv_id(F.col("own"), F.col("doi").cast("string")), own=own, doi=doi) == want


def test_best_matches_are_the_best_of_all_candidates(spark, sf):
    words = "the rain in spain falls mainly on every plain that lies below a hill".split()
    title = lambda i: " ".join(words[: 3 + i % 9]) + ["", " x", "!", " of it"][i // 9 % 4]
    works = [(i, title(i), [["Ann Lee"], ["Bo Kim", "Cy Lee"], [None], []][i % 4], [2000, 2001, 2004, None][i // 3 % 4]) for i in range(150)]
    works += [(170 + i, title(8) + " at noon" * 4 + "."[:i] + " m"[i:], [f"A Name{'xy'[i]}"], 1950 + 10 * i) for i in range(2)]
    works += [(150 + i, "Ключ " * i + "долгое имя работы", None, 2000) for i in range(3)] + [(160, None, ["A Lee"], 2000)]
    w = spark.createDataFrame(works, "id int, title string, authors array<string>, year int")
    near = w.select(F.col("id").alias("rid"), "title", "authors", (F.col("year") + 1).alias("year"))
    rows = lambda df: sorted(map(str, df.select("id", "rid", "similarity", "gap", "same").collect()))
    pairs = bibliography.candidates(w, near)
    assert rows(bibliography.best_matches(w, near)) == rows(bibliography.best(pairs))
    assert rows(bibliography.best_matches(w, near, apart=True)) == rows(bibliography.best(pairs.where("id <> rid")))
    d = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring(F.split("text", "\n")[0], 1, 120).alias("title"), F.array("source").alias("authors"), F.lit(2000).alias("year"))
    r = d.select(F.col("id").alias("rid"), "title", "authors", F.lit(2001).alias("year"))
    assert rows(citing.best_records(spark, sf)) == rows(bibliography.best(bibliography.candidates(d, r, 20).where("id <> rid")))


def test_copies_of_a_title_are_matched_without_their_pairs(spark):
    w = spark.range(20_000).select("id", F.lit("One title that all of them share").alias("title"), F.array(F.lit("Ann Lee")).alias("authors"), F.lit(2000).alias("year"))
    got = bibliography.best_matches(w, w.withColumnRenamed("id", "rid"), apart=True)
    assert got.where("same and rid = if(id = 0, 1, 0)").count() == 20_000


@given(st.text("abc ", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "bd"])), max_size=5))
def test_titles_that_may_be_alike_are_never_left_out(a, edits):
    b = a
    for at, put in edits:
        b = b[:at] + put + b[at + 1 :]
    assert may_reach(pd.Series([a]), pd.Series([b]), 0.9)[0] or matching_ratio(a, b) < 0.9
