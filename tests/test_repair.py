"""Repairs of extracted text, merges, sentences and reading tools on hand-made cases."""

from __future__ import annotations

import duckdb
import pytest

from lectern.operators import annotations, assembly, captions, reading, repair, search, sequences, translating
from lectern.plans import ORACLES, repairing


def test_spacing_comes_back_where_the_reference_is_sure():
    ref = "we propose a Naturalistic interface for people. The naturalistic view holds."
    assert repair.respaced("we propose aNaturalistic interfaceforpeople.", ref) == "we propose a Naturalistic interface for people."
    assert repair.respaced("| a | interfaceforpeople |\n```\ninterfaceforpeople\n```", ref).endswith("```\ninterfaceforpeople\n```")
    assert repair.Spaced("interface for people and interface forpeople").find("interfaceforpeople") is None  # occurrences disagree
    assert repair.respaced("C onversational and D train", "Conversational and D train") == "Conversational and D train"


def test_broken_characters_come_from_their_context():
    ref = "as for the coeﬃcient of the model was zero in all runs"
    assert repair.unbroken("as for the coe�cient of the model was zero", ref) == "as for the coeﬃcient of the model was zero"
    assert repair.unbroken("x�y", ref) == "x�y"
    wide = "".join(chr(ord(a) << 8 | ord(b)) for a, b in zip("Looking at the"[::2], "Looking at the"[1::2], strict=True))
    assert repair.unpaired(wide, "First. Looking at the stars. End.") == "Looking at the"
    assert repair.unpaired("한국어 글은 그대로", "First. Looking at the stars.") == "한국어 글은 그대로"


def test_broken_characters_of_repeating_text_come_from_their_own_place():
    runs = "And " * 9 + "erheha " * 9 + "theawhsh " * 9
    table = "".join(f"the value of the row is {c} as the next row says below. " for c in "abcdef")
    odd = "one two three four five six\xa0\u2003seven eight nine ten eleven twelve"
    for ref in (runs, table, odd, "x" * 70, "ab " * 40 + "\ufffd" * 9 + " and so on it goes to the end of it"):
        for at in range(20, len(ref) - 20):
            assert repair.unbroken(ref[:at] + "\ufffd" + ref[at + 1 :], ref) == ref
    assert repair.unbroken("And " * 7 + "A\ufffdd And " + "erheha " * 9, "**Title** And\n" + "And " * 8 + "erheha " * 9) == "And " * 9 + "erheha " * 9


def test_character_maps():
    cmap = repair.parse_cmap("beginbfchar\n<01> <0041>\n<02> <00660069>\nendbfchar beginbfrange <10> <12> <0061> endbfrange")
    assert cmap == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c"}
    assert [repair.glyph_text(g) for g in ("uni00410042", "u1F600", "f_i", "a.alt", "g123")] == ["AB", "😀", "fi", "a", None]
    assert repair.fixed_font({1: "�", 2: "x"}, {1: "uni00E9", 2: "y", 3: "comma", 4: "g9"}) == {1: "é", 2: "x", 3: ","}


def test_foot_notes_by_evidence_and_by_form():
    text = "# 1 Start\n\nThe kit 1 has 13 turns, GitHub 13 and more.\n\n## References\n\nx 1"
    out = repair.footnoted(text, ["1 one", "13 thirteen"], [(13, "used GitHub")])
    assert "13 turns" in out and 'GitHub <sup class="md-fn"><a href="#fn-13">' in out and "kit 1 has" in out
    assert "kit <sup" in repair.footnoted(text, ["1 one"]) and out.endswith("**13.** thirteen\n")


def test_front_matter_moves_only_with_reason():
    plain = "# T\n\nAn ordinary text.\n\n## 1 Start\n\nBody.\n"
    assert repair.ordered_front(plain) == plain and repair.ordered_front("no heading") == "no heading"
    assert repair.without_contacts("A.\n\nCorresponding author: x\n\nB goes on here.\n") == "A.\n\nB goes on here.\n"


def test_emphasis_by_majority():
    words = "This line has one very bold statement in the middle of it"
    stream = "".join(words.split())
    at = stream.index("verybold")
    styles = [1 if at <= i < at + len("verybold") else 0 for i in range(len(stream))]
    assert repair.emphasized(f"# 1 Intro\n{words}", stream, styles) == "# 1 Intro\nThis line has one **very bold** statement in the middle of it"
    assert repair.line_styles("somethingelseentirely", stream, styles) is None


def test_islands_need_context():
    text = "where alpha x2 holds for all of it, and beta y2 holds never"
    assert repair.placed_islands(text, [("x2", "wherealpha", "holdsforall", "x^2"), ("zz", "nothing", "there", "z")]) == "where alpha $x^2$ holds for all of it, and beta y2 holds never"


def test_blocks_follow_items_in_order():
    assert repair.aligned_blocks(["A b", "zz", "C &lt; d"], ["x", "a-b", "c < d"]) == [1, None, 2]
    long_ = "a paragraph of more than twenty four letters"
    assert repair.aligned_blocks([long_ + " that goes on"], [long_]) == [0] and repair.aligned_blocks(["abc d"], ["abc"]) == [None]


@pytest.mark.parametrize(
    ("base", "mine", "theirs", "want"),
    [
        ("a\nb", "a\nb", "a\nc", ("a\nc", 0, 0)), ("one two three", "one TWO three", "one two 3", ("one TWO 3", 0, 0)), ("# T", "# Mine", "### T", ("### Mine", 0, 0)),
        ("x\ny z\n", "x\ny Q\n", "x\n", ("x\n", 0, 1)), ("a b", "a c", "a d", ("a c", 1, 0)), ("a\nc", "a\nb\nc", "a\nc\nd", ("a\nb\nc\nd", 0, 0)),
    ],
)
def test_merges(base, mine, theirs, want):
    assert sequences.merge3(base, mine, theirs) == want


def test_sentences_and_siblings():
    text = "We cite Lee et al. in Fig. 3. It works (see Sec. 2. there). A. Jelson agrees! 0.5 is enough… 終わり。次。"
    assert [text[a:b] for a, b in sequences.split_sentences(text)] == ["We cite Lee et al. in Fig. 3.", "It works (see Sec. 2. there).", "A. Jelson agrees!", "0.5 is enough…", "終わり。", "次。"]
    assert sequences.sibling_span("Two is here.", "One is here. Two is here.", "Eins ist hier. Zwei ist da.", 15, 27, True) == (13, 25, 1.0)
    assert sequences.sibling_span("Nothing like it", "One. Two.", "Eins. Zwei.", 6, 11, True) is None


def test_pieces_for_a_model_join_again():
    text = "# A\n\n" + "word " * 40 + "\n\n```\n\n# no\n```\n# B\n\n" + "more " * 40
    parts = sequences.split_for_model(text, 100)
    assert "\n".join(parts) == text and len(parts) > 1 and any(p.startswith("# B") for p in parts)
    assert sequences.violations("a $x_i$ costs $5", "a $x_i$ kostet 5 $") == [] and sequences.violations("`a` $x$", "a x") == ["math", "code"]


def test_captions_of_one_text(spark):
    lines = ["Figure 2: N = 16 people", "", "![f](a/f.png)", "", "Figure 2: $N=16$ people", "tail", "Figure 3: one", "![g](g.png)", "Figure 3: something else"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id bigint, i int, line string")
    got = captions.duplicate_captions(rows)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 2, "f.png")]
    assert [r.line for r in captions.drop_lines(rows, got).orderBy("i").collect()][0] == "![f](a/f.png)"


def test_reanchor_uses_spans_and_context(spark):
    cells = spark.createDataFrame([(1, 0, "Cats sleep all day long. Dogs bark at night. Birds sing."), (1, 1, "Something else is here.")], "doc_id bigint, row int, text string")
    spans = sequences.sentence_spans(cells, pos="row").withColumnRenamed("block", "row")
    anchors = spark.createDataFrame([(1, "a", "Dogs bark at the night.", 0, "", ""), (1, "b", "Elephants never forget", 0, "", "")], "doc_id bigint, id string, quote string, row int, prefix string, suffix string")
    got = [(r.id, r.row, r.start, r.end, r.sure) for r in annotations.reanchor(anchors, cells, spans).collect()]
    assert got == [("a", 0, 25, 44, True)]


def test_section_pages_follow_each_other(spark):
    s = spark.createDataFrame([(1, 0, "Alpha part", None), (1, 1, "Beta part", None), (1, 2, "Alpha part", None), (1, 3, "Omega", 4)], "doc_id bigint, pos int, text string, page int")
    p = spark.createDataFrame([(1, 1, "alpha part"), (1, 2, "beta part"), (1, 3, "ALPHA-part again"), (1, 4, "x")], "doc_id bigint, page int, text string")
    assert [r.page for r in assembly.section_pages(s, p).orderBy("pos").collect()] == [1, 2, 3, 4]


def test_search_with_notes_first_and_a_budget(spark):
    chunks = spark.createDataFrame([(0, "cats and dogs"), (1, "dogs only"), (2, "birds")], "row int, text string")
    notes = spark.createDataFrame([("n1", 1, "remember dogs")], "id string, row int, text string")
    ask = spark.createDataFrame([(1, "cats dogs"), (2, "my notes on dogs")], "question int, text string")
    got = [(r.question, r.place, r.row, list(r.notes)) for r in reading.search_paper(chunks, ask, notes).orderBy("question", "place").collect()]
    assert got[0][2] == 0 and (2, 1, 1, ["an1"]) in got
    few = reading.search_paper(chunks, ask, notes, budget=5).collect()
    assert sorted(r.question for r in few) == [1, 2]  # the first row always


def test_index_reads_only_buckets_of_its_terms(spark):
    chunks = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "row int, text string")
    index = search.build_index(chunks, "row", buckets=8)
    ask = search.query_terms(spark.createDataFrame([(1, "word7")], "q int, text string"), "q")
    assert [r.row for r in search.search_index(index, ask, "q").collect()] == [7]


def test_layouts_that_break_are_kept(spark):
    docs = spark.createDataFrame([(1, "Title\n\ntext `x` here"), (2, "")], "doc_id bigint, text string")

    def fails(text):
        raise ValueError(text)

    assert [tuple(r)[1:4] for r in translating.fix_layout(docs, fails).orderBy("doc_id").collect()] == [("Title\n\ntext `x` here", 0, 1), ("", 0, 0)]
    assert [r.text for r in translating.fix_layout(docs, lambda t: "# " + t).orderBy("doc_id").collect()] == ["# Title\n\ntext `x` here", ""]


def test_unbroken_texts_keep_the_blanks_that_the_sql_keeps(spark, tmp_path):
    words = "and so it goes on to the end of all the lines that there are"
    texts = [f"\u00a0 {words}\u3000", words.replace(" ", "\v"), "And " * 9 + "erheha " * 9, words.replace("goes on", "goes\u00a0*on"), None, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = repairing.unbroken_texts(spark, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(ORACLES["unbroken_texts"]).fetchall())
