"""Technologies of a repository beside its rows; shuffles of the deduplications."""

from __future__ import annotations

import __spark_entry__ as entry
from siftwork.operators import repos as RE

REPOS = "owner long, name string, description string, language string, stars long, forks long, topics array<string>"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repo_lines_moves_a_repository_once(spark):
    plan = _plan(entry.queries()["repo_lines"](spark, entry.SMOKE_DIR))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_stack_beside_rows_equals_the_joined_stack(spark):
    rows = [(1, "a-b", "REACT and docker..", "Go", 3, 0, ["aws", "x"]), (1, "a-b", None, None, 0, 2, ["REDIS", None]),
            (1, "a-b", None, None, 0, 2, ["REDIS", None]), (2, "c", "", None, 0, 0, None), (3, "d", "plain", "", 1, 1, []),
            (None, "e", "django", "Go", 1, 1, ["aws"]), (4, None, "django", "Go", 1, 1, ["aws"]), (None, None, None, None, None, None, None)]
    r = spark.createDataFrame(rows, REPOS)
    stacks = RE.tech_stack(r, spark)
    got = {(x.owner, x.name): x.tech_stack for x in stacks.collect()}
    assert got == {(1, "a-b"): ["AWS", "Docker", "Go", "React.js", "Redis"], (3, "d"): [""],
                   (None, "e"): ["AWS", "Django", "Go"], (4, None): ["AWS", "Django", "Go"]}
    joined, beside = RE.repo_lines(r, stacks), RE.repo_lines(RE.tech_stack(r, spark, of_rows=True))
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, beside.collect()))
    assert beside.count() == len(rows)


def test_every_window_belongs_to_one_anchor():
    import random

    from siftwork.llm import substrings as S

    rng = random.Random(5)
    for n in (19, 20, 21, 60, 300):
        buf = " ".join(rng.choice(["a", "b", "cc"]) for _ in range(n)).encode()  # many equal runs
        starts, ends = S.word_places(buf)
        pos, h, first, last = S.anchors(buf, starts, ends, 20)
        g = S.run_hashes(buf, starts, ends, S.ANCHOR)
        got = [p for p, a, b in zip(pos, first, last) for _ in range(a, b + 1)]
        assert got == [min(range(s, s + 16), key=lambda p: (g[p], p)) for s in range(n - 19)]
        assert list(h) == [g[p] for p in pos]


def test_substrings_of_few_words(spark):
    import hashlib
    import random

    from siftwork.llm import substrings as S

    rng = random.Random(6)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 90))] for _ in range(12)]
    texts = [x * 2 if i % 4 == 0 else x + texts[i // 2][5:40] for i, x in enumerate(texts)]
    seen, want = set(), []
    for i, w in enumerate(texts):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if tuple(w[s:s + 20]) in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(tuple(w[s:s + 20]))
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = S.substring_dedup(docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    # the anchors are named once
    assert _plan(got).split("Initial Plan")[0].count("name_anchors") == 1


def test_only_candidate_lines_are_written_down(spark, monkeypatch):
    from siftwork.llm import lines

    written, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: written.append(cut(df)) or written[-1])
    far = ["a lonely line about the sea and ships", "zebras eat 47 pumpkins quickly", "no word recurs hereabouts"]
    docs = spark.createDataFrame([(1, "\n".join(far)), (2, far[0]), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in lines.line_dedup_by_document(docs).collect()}
    assert got == {1: (3, ""), 2: (1, "0"), 3: (0, "")}
    assert written and all(df.isEmpty() for df in written)
