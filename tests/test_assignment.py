"""Assigned pairs, null and blank texts, and names inside texts, against plain re-statements."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import lexicons as L
from siftwork.operators import extract as X
from siftwork.operators import keywords as KW
from siftwork.operators import match as M
from siftwork.operators import rewrite as RW
from siftwork.operators import screen as SCR
from siftwork.plans import report as RP
from siftwork.sources import corpus as C


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, "Python and Docker work. Built machine learning tools since 2019."), (2, "nothing of note"), (3, None), (4, " \n\t"),
        (5, "pythonic dockerized kubernetesque, machine-learning apart"), (6, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(10, " Needs Python, Docker and Kubernetes. Machine learning. "), (11, "Wants the best people"), (12, "  "), (13, None)],
                                 "target_id long, text string")


@pytest.fixture(scope="module")
def assignment(spark, targets):
    rows = [(1, 10, None), (1, 10, "Data Scientist"), (1, 12, "Data Scientist"), (1, None, " Data Scientist "), (2, 11, None), (2, 13, None), (2, 99, " "),
            (3, 10, None), (4, None, "Night Watch"), (5, 10, None), (6, None, None)]
    pairs, texts = C.resolve_targets(spark.createDataFrame(rows, "doc_id long, target_id long, role string"), targets, spark)
    return pairs.cache(), texts.cache()


def test_resolution(assignment):
    pairs, texts = assignment
    got = {(r.doc_id, r.target_kind): r.target_id for r in pairs.collect()}
    assert pairs.count() == 8
    scientist = -1 - L.ROLE_NAMES.index("Data Scientist")
    assert got[(1, "text")] == 10 and got[(1, "role")] == scientist and got[(2, "text")] == 11 and got[(2, "none")] is None
    assert got[(6, "none")] is None and got[(4, "role")] < -len(L.ROLE_NAMES)
    by_id = {r.target_id: r.text for r in texts.collect()}
    assert by_id[10] == "Needs Python, Docker and Kubernetes. Machine learning." and by_id[scientist] == "Data Scientist"
    assert by_id[got[(4, "role")]] == "Night Watch" and not {12, 13} & set(by_id)


def by_pair(df):
    return {(r.doc_id, r.target_id): r for r in df.collect()}


def test_every_pair_once_in_every_operator(spark, docs, assignment):
    pairs, texts = assignment
    want = {(r.doc_id, r.target_id) for r in pairs.collect()}
    dens = M.assigned_density(docs, texts, pairs)
    cov = M.keyword_coverage(RP.all_terms(docs, spark), RP.target_terms(texts, spark), docs, pairs)
    tf = M.tfidf_pair_similarity(M.tfidf_terms(docs, "doc_id", spark), M.tfidf_terms(texts, "target_id", spark), pairs)
    gap = M.skill_gap(M.gap_skills(docs, "doc_id"), M.gap_skills(texts, "target_id"), pairs)
    prio = M.priority_skills(gap, M.skill_mentions(texts))
    scored = RP.score_pairs(docs, texts, spark, pairs)
    screened = SCR.screen(docs, "text", dens)
    for df in (dens, cov, tf, gap, prio, scored, screened, RP.analysis_report(docs, texts, spark, pairs)):
        assert sorted(map(str, by_pair(df))) == sorted(map(str, want)) and df.count() == len(want)
    d, c, s = by_pair(dens), by_pair(cov), by_pair(scored)
    assert d[(6, None)].density_percent is None and d[(3, 10)].density_percent == 0.0 and d[(3, 10)].total_words > 0
    assert c[(6, None)].keyword_coverage == 0.5 and c[(6, None)].total_keywords is None and c[(6, None)].missing == []
    assert c[(2, 11)].keyword_coverage == 0.5  # a target without a known keyword
    k = c[(1, 10)]
    assert set(k.matched) >= {"Python", "Docker", "Machine Learning"} and "Kubernetes" in k.missing
    sub = c[(5, 10)]  # substrings only: half a point each; another character between is no hit
    assert set(sub.matched) == {"Python", "Docker", "Kubernetes"} and sub.coverage_ratio == 0 and "Machine Learning" in sub.missing
    assert abs(sub.keyword_coverage - 3 * 0.5 / sub.total_keywords) < 1e-9
    assert s[(6, None)].blended_similarity == 0.6 and s[(6, None)].tfidf_similarity is None and s[(3, 10)].tfidf_similarity == 0.0
    assert by_pair(screened)[(6, None)].density_percent is None


def test_null_blank_and_empty_texts_are_one(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    rows = {r.doc_id: r for r in SCR.screen(d).collect()}
    facts = {i: (r.ats_score, r.verdict, r.parse_issues, r.scan_issues, [w.section for w in r.weak_sections]) for i, r in rows.items()}
    assert facts[1] == facts[2] == facts[3] and facts[1][:2] == (0, "FAIL") and len(facts[1][4]) >= 4
    p = d.select("doc_id", *RW.project_strength(X.bullets_array(F.col("text")))).collect()
    assert all(r.project_score == 0 and r.total_bullets == 0 for r in p)
    for cols in (X.section_columns(F.col("text")), X.contact_columns(F.col("text")), X.readability_columns(F.col("text"))):
        got = [tuple(r) for r in d.select(*cols).collect()]
        assert got[0] == got[1] == got[2] and None not in got[0]
    assert KW.rake_keywords(d).count() == 0 and KW.candidates(d).count() == 0 and KW.weak_terms(d, spark).count() == 0
    assert C.admission_counts(d.withColumn("source", F.lit("s"))).collect()[0].reason == "empty"


def test_names_in_texts(spark):
    rng = random.Random(5)
    letters = "abc+# "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "X" * 3000 + "abc", "a\nb", "A  b"]
    names = {"".join(rng.choices(letters, k=rng.randint(1, 7))).strip() for _ in range(60)} | {"a b", "c", "c+", "C#", "abc", "b a c"}
    names = sorted(n for n in names if n)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.name) for r in M.names_in_texts(d, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(i, n.lower()) for i, t in enumerate(texts) for n in names if n.lower() in (t or "").lower()}
    plan = M.names_in_texts(d, spark.createDataFrame([(n,) for n in names], "name string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_move_no_text(spark, docs):
    for df in (KW.rake_keywords(docs), KW.candidates(docs), KW.weak_terms(docs, spark)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_rake_against_a_restatement(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "the", "of", ",", "."]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 50))) for _ in range(30)]
    got = {}
    for r in KW.rake_keywords(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=5).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.phrase, r.score))
    for i, t in enumerate(texts):
        phrases, run = [], []
        for w in [*t.split(), "."]:
            if w in ("the", "of", ",", "."):
                phrases += [run] if run else []
                run = []
            else:
                run = [*run, w]
        freq = {w: sum(p.count(w) for p in phrases) for p in phrases for w in p}
        degree = {w: sum(len(p) * p.count(w) for p in phrases) for w in freq}
        best = sorted(((sum(degree[w] / freq[w] for w in p), " ".join(p)) for p in phrases), reverse=True)[:5]
        assert [(p, pytest.approx(s, abs=0.006)) for s, p in best] == got.get(i, [])
