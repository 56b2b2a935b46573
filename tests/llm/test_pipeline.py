"""The pipeline's stages on their own input."""

from __future__ import annotations

import collections

import corpus_pipeline as P
import pytest

from lectern.llm import decontaminate, secrets
from lectern.llm.common import materialize, read

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = text.lower().split()
    return frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4)))


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_stages_keep_the_columns_and_only_lose_rows(steps):
    assert list(steps) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mix_sources"]
    for name, (a, b) in steps.items():
        assert b.count() <= a.count()
        if name != "mix_sources":
            assert b.columns == a.columns


def test_near_duplicates_leave_one_each(steps):
    a, b = steps["simhash_near_dedup"]
    text = {r.doc_id: shingles(r.text) for r in a.collect()}
    kept = {r.doc_id for r in b.collect()}
    at = collections.defaultdict(list)
    for d, s in text.items():
        for x in s:
            at[x].append(d)
    like = collections.defaultdict(set)
    for ids in at.values():
        for d in ids:
            like[d] |= set(ids)
    jaccard = lambda x, y: len(text[x] & text[y]) / len(text[x] | text[y])
    pairs = [(d, e) for d in like for e in like[d] if d < e and jaccard(d, e) >= 0.8]
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert pairs and len(missed) <= 0.05 * len(pairs)
    assert all(max(jaccard(d, e) for e in like[d] - {d}) >= 0.8 for d in set(text) - kept)


def test_leaks_and_secrets_are_gone(spark, steps):
    _, clean = steps["benchmark_decontamination"]
    assert decontaminate.find_leaks(clean, read(spark, SF, "benchmark")).count() == 0
    before, after = steps["secret_scan"]
    assert before.count() == after.count() and secrets.secret_scan(after).where("n_assign + n_access + n_hex > 0").count() == 0
    assert after.where("length(text) <> n_chars").count() == 0


def test_mix_covers_every_document(steps):
    docs, mix = steps["mix_sources"]
    assert mix.count() == docs.count()
    assert mix.selectExpr("sum(taken)").first()[0] == pytest.approx(1.5 * mix.selectExpr("sum(size)").first()[0], rel=0.05)


def test_run_is_the_stages_in_turn(spark, steps):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, steps["mix_sources"][1].collect()))
