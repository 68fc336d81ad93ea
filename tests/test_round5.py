"""Names looked for where a text is read, tokens taken from the text itself, one corpus for both sides of the advice."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import extract as X
from siftwork.operators import match as M
from siftwork.plans import catalog as CT

TEXTS = ["Python, Docker\nand machine  learning", "", None, " \n\n c++ / c# \x0b node.js\r\n", "No Python-like été İ x", "\n", "a\tb\fc"]


def test_name_lists_are_names_in_texts_by_either_way(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(0, "kubernetes again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame([("Python",), ("machine  learning",), ("c",), ("Machine learning",), ("",), ("  ",), (" python",), ("kubernetes",), (None,)], "name string")
    want = {}
    for r in M.names_in_texts(docs, names).collect():
        want.setdefault(r.doc_id, set()).add(r["name"])
    assert want[0] >= {"machine  learning", "kubernetes"}
    for most in (M.FEW_NAMES, 2):
        monkeypatch.setattr(M, "FEW_NAMES", most)
        got = M.name_lists(docs, names).collect()
        assert len({r.doc_id for r in got}) == len(got)
        assert {r.doc_id: set(r["_s"]) for r in got if r["_s"]} == want


def test_few_names_move_no_tokens(spark):
    docs = spark.createDataFrame([(1, "python")], "doc_id long, text string")
    names = spark.createDataFrame([("python",)], "name string")
    plan = M.name_lists(docs, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array_distinct" not in plan and "Generate explode(sequence" not in plan


@pytest.mark.parametrize("lower", [True, False])
def test_tokens_are_those_of_the_normal_form(spark, lower):
    d = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    form = T.token_normal_form(F.col("text")) if lower else X._case_normal_form(F.col("text"))
    text = F.lower(T.col("text")) if lower else T.col("text")
    tokens = F.regexp_extract_all(text, F.lit(X.TOKEN if lower else X.CASE_TOKEN), 0)
    for r in d.select(F.filter(F.split(form, " "), lambda x: x != "").alias("a"), tokens.alias("b")).collect():
        assert r.a == r.b


def test_advice_on_pairs_makes_the_candidates_once(spark, monkeypatch):
    made = []
    real = CT.D.cand
    monkeypatch.setattr(CT.D, "cand", lambda *a: made.append(1) or real(*a))
    CT._pair_adv(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
