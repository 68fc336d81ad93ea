"""Long runs of ignored words, whole pairs, and steps that must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import lexicons as L
from siftwork.operators import keywords as KW
from siftwork.operators import match as M
from siftwork.operators import rewrite as RW
from siftwork.plans import catalog as CAT
from siftwork.sources import corpus as C


@pytest.fixture(scope="module")
def long_runs(spark):
    """A text with 30,000 ignored words between two phrases; a pattern that recurses ends the executor here."""
    words = F.concat(F.lit("alpha beta "), F.repeat(F.lit("the, "), 15000), F.lit("gamma"))
    return spark.range(2).select(F.col("id").alias("doc_id"), words.alias("text"))


def test_phrases_around_a_long_run_of_ignored_words(long_runs):
    occ = KW.with_phrases(long_runs).select("doc_id", F.explode("_phrases").alias("phrase"))
    got = occ.select("doc_id", "phrase", KW.is_noise(F.col("phrase")).alias("noise")).collect()
    assert sorted(map(tuple, got)) == [(i, p, False) for i in (0, 1) for p in ("alpha beta", "gamma")]


def test_rake_around_a_long_run_of_ignored_words(long_runs):
    got = KW.rake_keywords(long_runs).collect()
    assert sorted(map(tuple, got)) == [(i, *r) for i in (0, 1) for r in ((1, "alpha beta", 4.0), (2, "gamma", 1.0))]


def test_every_document_with_every_target_text(spark):
    docs = spark.createDataFrame([(1, "rust and go"), (2, None), (3, "trust"), (3, "nothing")], "doc_id long, text string")
    targets = spark.createDataFrame([(10, "Rust wanted"), (11, "Cobol only"), (12, " ")], "target_id long, text string")
    chosen = spark.createDataFrame([(1, 10, None), (2, 12, "Data Scientist"), (3, None, None)], "doc_id long, target_id long, role string")
    pairs, texts = C.resolve_targets(chosen, targets, spark)
    role = -1 - L.ROLE_NAMES.index("Data Scientist")
    every = C.every_pair(pairs, docs, texts)
    want = sorted([(d, t) for d in (1, 2, 3) for t in (10, 11)] + [(2, role), (3, None)], key=str)
    assert sorted(((r.doc_id, r.target_id) for r in every.collect()), key=str) == want
    dens = M.assigned_density(docs, texts, every).collect()  # the id 3 has two texts, each with rows of its own
    got = sorted((r.doc_id, r.target_id, r.matched_count) for r in dens if r.target_id in (10, 11))
    assert got == [(1, 10, 1), (1, 11, 0), (2, 10, 0), (2, 11, 0), (3, 10, 0), (3, 10, 1), (3, 11, 0), (3, 11, 0)]
    d, t = M.tfidf_terms(docs.where("doc_id < 3"), "doc_id", spark), M.tfidf_terms(texts, "target_id", spark)
    p = every.where("doc_id < 3")
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "target_id", "tfidf_similarity").collect()), key=str)
    assert rows(M.tfidf_pair_similarity(d, t, p, every=True)) == rows(M.tfidf_pair_similarity(d, t, p))


def test_whole_jobs_of_the_pair_queries():
    """Every document with every target, not the assigned targets alone."""
    for name in ("keyword_density", "tfidf_pair_similarity", "embedding_similarity", "blended_similarity", "skill_gap",
                 "priority_skills", "rank_documents", "screening_verdict", "screening_recommendations", "verdict_rollup"):
        assert (CAT.EVERY_DOC_PAIR in CAT.ORACLE[name]) or (CAT.EVERY_CAND_PAIR in CAT.ORACLE[name]), name


def test_words_are_found_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "xxRustyy a ab abc.net\tC++ABC")], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("rust", "abc", "abc.net", "c++abc", "net", "abd", "abc.nets")], "word string")
    found = M.found_words(docs, words)
    assert sorted(found.collect()[0]._found) == ["abc", "abc.net", "c++abc", "net", "rust"]


def times(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(name)


def test_lines_are_rewritten_and_rendered_once(spark):
    text = "- helped a <team>\n* b\n\n\nplain & simple\n-c"
    d = spark.createDataFrame([(1, text, "helped the team."), (2, None, None)], "doc_id long, text string, line string").cache()
    html = d.select(RW.render_html_lines(F.col("text"), "2024-01-01").alias("html"))
    want = ("<h1>Optimized document</h1>\n<ul>\n<li>helped a &lt;team&gt;</li>\n<li>b</li>\n</ul>\n<p>plain &amp; simple</p>\n"
            "<ul>\n<li>c</li>\n</ul>\n<div class=\"watermark\">Optimized on 2024-01-01</div>\n")
    assert html.collect()[0].html == want and times(html, "split(") <= 2
    line = d.select(RW.rewrite_line(F.col("line")).alias("line"))
    verb = next(v for w, v in L.VERB_UPGRADES if w == "helped")
    assert [r.line for r in line.collect()] == [verb[:1].upper() + verb[1:].lower() + " the team" + L.QUANT_HINT_SUFFIX, None]
    assert times(line, "regexp_extract(") == 1
