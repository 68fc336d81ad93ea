"""Golden units for the rule operators (hand-computed expectations)."""

from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import extract as X
from siftwork.operators import match as M
from siftwork.operators import rewrite as RW
from siftwork.operators import score as SC


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_clean_text_edges(spark):
    t = F.col("t")
    assert one(spark, T.clean_text(t), "  a\r\nb\r\n\n\n\nc\t\td•e  ") == "a\nb\n\nc d e"
    assert one(spark, T.clean_text(t), "") == ""
    # a lone tab becomes a space in step 4; a blank run collapses in step 3
    assert one(spark, T.clean_text(t), "x\ty") == "x y"
    assert one(spark, T.clean_text(t), "x \ty") == "x y"
    # spaces made by step 4 are not re-collapsed
    assert one(spark, T.clean_text(t), "x \u00e9 y") == "x   y"


def test_quantification_example(spark):
    s = "40% of 2M+ and 100K, 5+ (555) 123-4567 GPA 3.8/4.0 in 2021"
    assert one(spark, T.quant_count(F.col("t")), s) == 10


def test_bullet_rewrite_prefix_order(spark):
    assert one(spark, RW.rewrite_line(F.col("t")), "Worked on APIs.") == \
        "Engineered on APIs, resulting in measurable improvement"
    assert one(spark, RW.rewrite_line(F.col("t")), "fixed 3 bugs") == "Resolved 3 bugs"


def test_rewrite_document_marker_quirk(spark):
    out = one(spark, RW.rewrite_document(F.col("t")), "• worked on the backend API")
    assert out == "• worked on the backend API, resulting in measurable improvement"


def test_gap_regex_edges(spark):
    df = spark.createDataFrame([(1, "javascript and c++ node.js nodejs c# go")], "id long, text string")
    skills = M.gap_skills(df, "id").first()["skills"]
    assert skills == ["go", "javascript", "node.js", "nodejs"]


def test_roadmap_two_way_substring(spark):
    df = spark.createDataFrame([(s,) for s in ["java", "go", "mysql", "nodejs", "rust"]], "skill string")
    got = {r["skill"]: r["roadmap"] for r in M.gap_roadmap(df, spark).collect()}
    assert got == {"java": "javascript", "go": "mongodb", "mysql": "sql", "nodejs": "default", "rust": "default"}


def test_grade_thresholds(spark):
    vals = [(84.9, "Good"), (85.0, "Excellent"), (69.9, "Average"), (70.0, "Good"), (54.9, "Below Average"),
            (55.0, "Average"), (39.9, "Poor"), (40.0, "Below Average")]
    df = spark.createDataFrame([(v,) for v, _ in vals], "s double")
    got = [r["g"] for r in df.select(SC.grade(F.col("s")).alias("g")).collect()]
    assert got == [g for _, g in vals]


def test_length_score_boundaries(spark):
    words = [149, 150, 299, 300, 900, 901, 1200, 1201]
    df = spark.createDataFrame([(w,) for w in words], "w int")
    got = [r["s"] for r in df.select(SC.length_score(F.col("w")).alias("s")).collect()]
    assert got == [0.3, 0.6, 0.6, 1.0, 1.0, 0.8, 0.8, 0.6]


def test_bullets_need_marker_and_space(spark):
    text = "- led the migration of billing\n-nospace line that is long enough\n* short\n• built a data platform at scale"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["bullet"] for r in X.extract_bullets(df).orderBy("bullet_no").collect()]
    assert got == ["led the migration of billing", "built a data platform at scale"]


def test_lexicon_match_overlap_and_case(spark):
    df = spark.createDataFrame([(1, "Used GitHub Actions, Node.js and C++ daily")], "doc_id long, text string")
    got = {(r["category"], r["canonical"]) for r in X.lexicon_match(df, spark).collect()}
    assert ("tools", "Github") in got and ("tools", "Github Actions") in got
    assert ("technical", "Node.js") in got and ("technical", "C++") in got


def test_python_title(spark):
    assert one(spark, T.python_title(F.col("t")), "scikit-learn neo4j ci/cd") == "Scikit-Learn Neo4J Ci/Cd"


def test_tfidf_closed_form_equals_vectors_of_the_pair(spark):
    import math
    docs = {1: {"red": 3, "fox": 1, "red fox": 1}, 2: {"blue": 2}, 3: {f"w{i}": 1 + i % 7 for i in range(1200)}}
    targets = {10: {"red": 1, "w5": 2, "dog": 4}, 11: {"blue": 5}}
    frame = lambda x: spark.createDataFrame([(i, t, c) for i, ts in x.items() for t, c in ts.items()], "id long, term string, c long")
    got = {(r.doc_id, r.target_id): r.tfidf_similarity for r in M.tfidf_pair_similarity(frame(docs), frame(targets)).collect()}
    want = {}
    for i, a in docs.items():
        for j, b in targets.items():
            if a.keys() & b.keys():
                idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in a.keys() | b.keys()}
                x, y = ({t: c * idf[t] for t, c in side.items()} for side in (a, b))
                dot = sum(x[t] * y[t] for t in x.keys() & y.keys())
                want[i, j] = dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_verb_usage_keeps_documents_without_a_verb(spark):
    d = spark.createDataFrame([(1, "Led it, built it and LED it again; helped."), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in X.verb_usage(d, spark).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].strong_verbs == ["led", "built"] and got[1].weak_verbs == ["helped"]
    assert all((got[i].strong_verbs, got[i].weak_verbs, got[i].n_strong, got[i].n_weak) == ([], [], 0, 0) for i in (2, 3, 4))
