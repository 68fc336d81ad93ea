"""Joins whose sides Spark sizes too low; pairs of every document with every target."""

from __future__ import annotations

import __spark_entry__ as entry
from siftwork.llm import simhash
from siftwork.operators import match as M
from siftwork.sources.corpus import every_pair


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ring_keys_are_not_broadcast(spark):
    df = spark.range(50).selectExpr("id * id * 7919 as fp")
    plan = _plan(simhash.near_links(df, 4))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_are_made_last(spark):
    for name in ("keyword_density", "screening_verdict", "screening_recommendations", "verdict_rollup"):
        plan = _plan(entry.queries()[name](spark, entry.SMOKE_DIR))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_every_density_equals_the_joined_pairs(spark, monkeypatch):
    docs = [(1, "Alpha beta, gamma+ Alphabet"), (1, "delta"), (1, "delta"), (2, None), (3, ""), (None, "alpha"), (None, "beta"), (4, "BETA\tépsilon")]
    texts = [(7, "alpha beta delta", "text"), (8, "it a", "text"), (9, "gamma+ beta", "text"), (9, "omega", "text"), (-1, "beta role", "role")]
    pairs = [(1, -1, "role"), (1, None, "none"), (2, 7, "text"), (4, -5, "role"), (None, None, "none"), (None, -1, "role")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(texts, "target_id long, text string, target_kind string")
    p = spark.createDataFrame(pairs, "doc_id long, target_id long, target_kind string")
    want = M.assigned_density(d, t, every_pair(p, d, t)).drop("top_missing_list").collect()
    assert sorted(map(repr, M.every_density(d, t, p).collect())) == sorted(map(repr, want)) and len(want) > 30
    beside = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w")], "doc_id long, more string")
    joined = lambda: sorted(map(repr, M.every_density(d, t, p, beside=beside).collect()))
    got = joined()
    monkeypatch.setattr(M, "FEW_TARGETS", 1)
    assert got == joined()


def test_priority_skills_are_met_as_sets(spark):
    gaps = spark.createDataFrame([(1, 5, ["b", "c", "a"]), (2, 5, []), (3, None, ["a"])], "doc_id long, target_id long, missing array<string>")
    mentions = spark.createDataFrame([(5, [("c", 3), ("d", 2), ("a", 1), ("b", 1)])], "target_id long, ordered array<struct<skill:string,mentions:int>>")
    p = M.priority_skills(gaps, mentions, 2)
    assert {r.doc_id: r.priority_skills for r in p.collect()} == {1: ["c", "a"], 2: [], 3: []}
    assert "array_intersect" in _plan(p)



def test_coverage_meets_names_as_sets(spark):
    docs = spark.createDataFrame([(1, "knows go and C++"), (2, None), (1, "x")], "doc_id long, text string")
    dt = spark.createDataFrame([(1, "technical", "SQL")], "doc_id long, category string, canonical string")
    tt = spark.createDataFrame([(5, "technical", c) for c in ("SQL", "Go", "C++", "GO", "Rust")], "target_id long, category string, canonical string")
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, None)], "doc_id long, target_id long")
    c = M.keyword_coverage(dt, tt, docs, pairs)
    assert "array_contains" not in _plan(c)
    got = {(r.doc_id, r.target_id): (r.matched, r.missing, round(r.keyword_coverage, 3)) for r in c.collect()}
    assert got == {(1, 5): (["C++", "GO", "Go", "SQL"], ["Rust"], 0.5), (2, 5): ([], ["C++", "GO", "Go", "Rust", "SQL"], 0.0), (2, None): ([], [], 0.5)}
