"""Numbering, version appends, ranks, vector search, sketches, files and streams."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions.numbering import numbered
from siftwork.operators import score as SC
from siftwork.operators import sketches as SK
from siftwork.operators import vectors as VX
from siftwork.operators import versions as VE
from siftwork.sources import corpus as C
from siftwork.streaming import stream as ST


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + [None, "a", "b", "c"]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x long, i long")
    got = numbered(df, ["g"], [F.col("x"), F.col("i")], "no")
    want = {}
    for g, x, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(g, []).append(i)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.no):
        found.setdefault(r.g, []).append(r.i)
    assert found == want and got.columns == ["g", "x", "i", "no"]
    assert numbered(df.limit(0), ["g"], [F.col("x")], "no").count() == 0


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(5) / 2) for i in range(300)] + [(3, 999, 1.0)]
    df = spark.createDataFrame(rows, "target_id long, doc_id long, final_score double").cache()
    want = {}
    for t in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[1]))
        want |= {(t, d): (n, round((n - 1) / (len(mine) - 1), 6) if len(mine) > 1 else 0.0) for n, (_, d, _) in enumerate(mine, 1)}
    assert {(r.target_id, r.doc_id): (r.rank, r.pct_rank) for r in SC.rank_all(df).collect()} == want
    top = {(r.target_id, r.doc_id): (r.rank, r.pct_rank) for r in SC.rank_documents(df, 7).collect()}
    assert top == {k: v for k, v in want.items() if v[0] <= 7}


def test_version_appends(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["s"] * 4 + [None, "t"]), i, "v", f"text {i}") for i in range(400)]
    rows += [("s", 3, " ", "x"), ("s", 4, "v", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "session_id string, ts long, label string, text string")
    ids = lambda v: {(r.session_id, r.ts, r.text): r.version_id for r in v.collect()}
    once = VE.version_append(df)
    assert once.count() == 400
    first = VE.version_append(df.where("ts < 150"))
    again = VE.version_append(df, existing=first)
    assert ids(first.unionByName(again)) == ids(once) and again.count() == 250
    assert VE.version_append(df, existing=once).count() == 0
    late = spark.createDataFrame([("s", 0, "late", "late")], df.schema)
    added = VE.version_append(late, existing=once).collect()
    assert added[0].version_id == max(v for (s, *_), v in ids(once).items() if s == "s") + 1


# ------------------------------------------------------------------ vectors
def brute_neighbours(rows, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    out = {}
    for q in queries:
        s = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q))[:k]
        out[q] = [i for _, i in s]
    return out


def searched(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_vector_search(spark, spread, monkeypatch):
    monkeypatch.setattr(VX, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(5000 + i, rows[7][1]) for i in range(400)]  # copies of one vector
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)
    index = VX.build_index(df)
    assert index.rows.count() == len(rows) and index.blocks.max() >= 8
    queries = df.where("vec_id % 20 = 0")
    want = brute_neighbours(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert searched(VX.nearest(index, queries, 5)) == want
    few = searched(VX.nearest(index, queries, 5, exact=False))
    recall = np.mean([len(set(few.get(q, [])) & set(want[q])) / 5 for q in want])
    assert recall >= (0.9 if spread < 1 else 0.5)
    assert VX.nearest(index, queries.limit(0), 5).count() == 0


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    for df in (none, none.limit(0)):
        assert VX.nearest(VX.build_index(df), none, 3).count() == 0


# ------------------------------------------------------------------ sketches
def test_merged_parts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xyz"), round(rng.uniform(0, 100), 1), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "lang string, source string, flesch_kincaid_score double, i long")
    parts = SK.readability_parts(df.where("i < 2000"), "lang", "source").unionByName(SK.readability_parts(df.where("i >= 2000"), "lang", "source"))
    for r in SK.merged_readability(parts, "lang", "source").collect():
        mine = sorted(s for a, b, s, _ in rows if r.lang in (None, a) and r.source in (None, b))
        assert r.n_docs == len(mine) and (r.min_fk, r.max_fk) == (mine[0], mine[-1])
        assert abs(r.avg_fk - sum(mine) / len(mine)) < 1e-6
        rank = sum(s <= r.median_fk for s in mine) / len(mine)
        assert abs(rank - 0.5) < 2.3 / SK.K ** 0.9 + 0.005
    none = F.array().cast("array<string>")
    s = df.select((F.col("i") % 3000).alias("doc_id"), "lang", "source").withColumns({"parse_issues": F.array(F.lit("x")), "scan_issues": none, "weak_sections": none})
    v = SK.verdict_parts(s.where("doc_id % 2 = 0"), "lang", "source").unionByName(SK.verdict_parts(s.where("doc_id % 2 = 1"), "lang", "source"))
    whole = SK.merged_verdicts(v, "lang", "source").where("lang is null and source is null").first()
    assert whole.n_pairs == 6000 and whole.n_parse_issues == 6000 and abs(whole.docs_estimate - 3000) < 3000 * 3 * 1.04 / 2 ** (SK.LG / 2)


# ------------------------------------------------------------------ files
def test_files(spark, tmp_path):
    put = {"a.txt": b"Test R\xc3\xa9sum\xc3\xa9\nJohn", "b.TXT": b"ok\xff\xfe\xc3(\xe2\x82A\xf0\x9f\x98\x80 \xef\xbf\xbd end\xc0\xaf\xed\xa0\x80", "c.pdf": b"%PDF-1.4",
           "d.md": b"no", "noending": b"no", "e.txt": b"", "f.txt": b"x" * 101, "sub/g.Txt": b"deep", "h.docx": b"PK"}
    for name, data in put.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    # Spark's file source lists no file of zero bytes
    got = {r.path.rpartition("/")[2]: r for r in C.read_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert {k: v.reason for k, v in got.items()} == {"a.txt": "ok", "b.TXT": "ok", "c.pdf": "no_decoder", "d.md": "type", "noending": "type",
                                                    "f.txt": "too_large", "g.Txt": "ok", "h.docx": "no_decoder"}
    for name in ("a.txt", "b.TXT"):
        assert got[name].text == put[name].decode("utf-8", errors="ignore")
    assert "�" in got["b.TXT"].text and got["f.txt"].text is None and got["f.txt"].n_bytes == 101
    assert {r.path.rpartition("/")[2] for r in C.read_corpus(spark, str(tmp_path), max_bytes=100).collect()} == {"a.txt", "b.TXT", "g.Txt"}


# ------------------------------------------------------------------ streams
T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_lint_stream_in_three_batches_with_a_late_row(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, text string"
    steps = [[(1, at(0), 1, "I helped"), (1, at(3), 2, "I led"), (2, at(1), 3, "made it")],
             [(1, at(20), 4, "did it"), (2, at(9), 5, "worked on")],
             # the first row comes late but within the watermark, and bridges two sessions of user 2; the second is too late
             [(2, at(16), 6, "responsible for"), (3, at(-60), 7, "late"), (9, at(500), 8, "end"), (1, at(21), 9, "helped too")]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        edits = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = ST.lint_stream(edits, str(tmp_path / "out"), "10 minutes", "30 minutes", id_col="event_id")
    batch = ST.debounced_lint(spark.createDataFrame([r for s in steps for r in s if r[2] != 7], schema), "10 minutes", id_col="event_id")
    want = sorted(map(tuple, batch.where("user_id <> 9").collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert [r[3] for r in want if r[0] == 2] == [3]


def test_batch_sessions_of_a_busy_user(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(seconds=rng.randrange(400_000)), i, rng.choice("abc")) for i in range(3000)]
    rows += [(1, None, 9001, "x"), rows[0][:2] + (9002, "z")]
    got = ST.debounced_lint(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, text string"), "5 minutes", ["a"], id_col="event_id")
    want = []
    for u in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == u and r[1])
        run = []
        for e in [*mine, None]:
            if run and (e is None or e[0] >= run[-1][0] + dt.timedelta(minutes=5)):
                want.append((u, run[0][0], run[-1][0] + dt.timedelta(minutes=5), len(run), run[-1][2]))
                run = []
            run.append(e)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)


def test_score_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Email a@b.io phone. Experience 2019. Skills: Python."), (2, None), (3, "plain")], "doc_id long, text string")
    targets = spark.createDataFrame([(10, "Python people wanted")], "target_id long, text string")
    pairs = spark.createDataFrame([(1, 10), (1, None), (2, 10), (3, None)], "doc_id long, target_id long")
    schema = "session_id string, event_id long, ts timestamp, doc_id long"
    steps = [[("s", 1, at(0), 1), ("s", 2, at(5), 3), ("t", 3, at(1), 2)],
             [("s", 2, at(5), 3), ("s", 4, at(3), 2), ("t", 5, at(9), 77)],  # a repeated event, a late one, an unknown document
             [("s", 6, at(300), 3), ("t", 7, at(301), 1)], [("s", 8, at(2), 1), ("t", 9, at(302), 3)]]  # the first is later than the watermark
    base, old = str(tmp_path / "out"), {}
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sub = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = ST.stream_score(sub, base, docs, targets, pairs, "1 hour").collect()
        now = {(r.session_id, r.event_id, r.target_id): (r.version_id, r.ats_score, r.verdict) for r in got}
        assert len(now) == len(got) and old.items() <= now.items()  # nothing is renumbered
        old = now
    assert {e for _, e, _ in old} == {1, 2, 3, 4, 6, 7, 9}
    assert sorted(v[0] for k, v in old.items() if k[0] == "s") == [1, 2, 3, 4, 5]
    # a replay of a batch writes the same rows
    table = f"{base}/versions"
    batch = spark.createDataFrame([("s", 4, at(3), 2)], schema)
    n = next(r.batch_id for r in got if r.event_id == 4)
    ST.append_batch(batch, n, table, docs, targets, pairs)
    assert {(r.session_id, r.event_id, r.target_id): (r.version_id, r.ats_score, r.verdict) for r in ST.read_versions(spark, table).collect()} == old
    # one batch over all gives the scores of the stream
    whole = ST.score_submissions(spark.createDataFrame([r for s in steps for r in s], schema).dropDuplicates(), docs, targets, pairs)
    scores = {(r.session_id, r.event_id, r.target_id): (r.ats_score, r.verdict) for r in whole.collect()}
    assert all(scores[k] == v[1:] for k, v in old.items())


def test_a_stream_of_edits_needs_a_watermark(spark, tmp_path):
    schema = "user_id long, ts timestamp, text string"
    spark.createDataFrame([(1, T0, "x")], schema).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        ST.debounced_lint(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 minutes")
