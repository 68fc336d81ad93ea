"""Phrases, names, words and terms counted in the task that reads the text."""

from pyspark.sql import functions as F

from siftwork.functions import lexicons as L
from siftwork.functions import text as T
from siftwork.operators import extract as X
from siftwork.operators import match as M

TEXTS = [(1, "Python, Docker\nand machine  learning"), (1, "machine\nlearning kubernetes"), (2, None), (3, ""), (None, "python"),
         (4, "c++ / C# été node.js pythons caféb x_1"), (5, "machine learning machine learning")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexicon_phrases_are_found_in_the_texts_task(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = X.lexicon_match(docs, spark)
    names = {}
    for r in got.collect():
        names.setdefault(r.doc_id, []).append(r.canonical)
    form = F.concat(F.lit(" "), T.token_normal_form(F.col("text")), F.lit(" "))
    forms = [tuple(r) for r in docs.select("doc_id", form).collect()]
    want = {}
    for i, f in forms:
        for _, norm, canonical, _, _ in L.lexicon_rows():
            if f" {norm} " in f:
                want.setdefault(i, set()).add(canonical)
    assert {k: sorted(v) for k, v in names.items()} == {k: sorted(v) for k, v in want.items()}
    fresh = plan(X.lexicon_match(docs, spark))
    assert "MapInArrow" in fresh and fresh.count("Exchange hashpartitioning") == 1


def test_listed_texts_are_looked_up_plainly(spark):
    d = spark.createDataFrame([("work experience",), ("employ",), ("key skills and portfolios",), (None,), ("+1 phone",)], "text string")
    for _, p in L.SECTION_PATTERNS + L.SCREEN_SECTION_PATTERNS:
        low = F.lower(T.col("text"))
        rows = d.select(T.has_any(low, p).alias("a"), low.rlike(p).alias("b")).collect()
        assert all(r.a == r.b for r in rows), p
    assert "RLIKE" not in plan(X.section_presence(d.withColumn("doc_id", F.lit(1)))).upper()


def test_terms_are_counted_in_the_texts_task(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = M.tfidf_terms(docs, "doc_id", spark)
    rows = sorted((tuple(r) for r in terms.where("id = 5").collect()), key=str)
    assert sorted(rows) == [(5, "learning", 2, 15), (5, "learning machine", 1, 15), (5, "learning machine learning", 1, 15), (5, "machine", 2, 15),
                    (5, "machine learning", 2, 15), (5, "machine learning machine", 1, 15)]
    tokens = F.filter(F.regexp_extract_all(F.lower(T.col("text")), F.lit(M.TFIDF_TOKEN), 0), lambda t: ~t.isin(*L.english_stopwords()))
    want = sorted({(r.doc_id, w) for r in docs.select("doc_id", tokens.alias("t")).collect() for w in r.t}, key=str)
    assert sorted({(r.id, r.term) for r in terms.collect() if " " not in r.term}, key=str) == want
    assert "MapInArrow" in plan(terms) and "Generate" not in plan(terms)


def test_words_are_found_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([*TEXTS, (6, "Éclair eclairs")], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in ("python", "learn", "éclair", "clair", "c++", "chi", "xyz", None)], "word string")
    found = lambda: sorted(((r.doc_id, sorted(r._found)) for r in M.found_words(docs, words).collect()), key=str)
    many = found()
    assert "Generate" not in plan(M.found_words(docs, words))
    monkeypatch.setattr(M, "FEW_WORDS", 1)
    assert found() == many and (1, ["chi", "learn", "python"]) in many
