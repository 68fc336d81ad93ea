"""Clusters, contamination and conversations against brute force, with nulls, ties, repeated rows, long texts and no rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import clusters, contamination, conversations

SF = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------------ clusters
def brute_clusters(rows, k, dim, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: ((0, sha(f"1:{r[0]}")) if r[0] is not None else (1, ""), r[1]))
    centres = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = {j: sum(d for _, d, o in last if o == j) for j in range(len(centres))}
    return sorted(((i, j, d, per[j], sum(per.values()), sha(",".join(map(str, centres[j])))) for i, d, j in last), key=repr)


def vectors(n, dim, seed=0):
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centre)]) for i in range(n)]
    same = rows[3][1]
    bad = [(900, None), (901, []), (902, same[:-1]), (903, same + [0.1]), (904, [None] + same[1:]), (905, [float("nan")] + same[1:]),
           (906, [float("inf")] + same[1:]), (None, rows[4][1]), (3, same), (3, same)]
    return rows + bad + [(1000 + i, same) for i in range(n // 3)]


@pytest.mark.parametrize("n, k, dim", [(300, 16, 64), (300, 7, 3), (5, 16, 8), (40, 1, 4), (0, 4, 3)])
def test_clusters(spark, n, k, dim):
    rows = vectors(n, dim) if n else []
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, v string, cluster int")
    got = clusters.centroid_clusters(df.repartition(3), k=k, dim=dim)
    assert got.columns == ["vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"]
    found = got.collect()
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == brute_clusters(rows, k, dim, 3)
    if k == 16 and n == 300:
        assert sum(r.scans for r in found) < 4 * len(found)  # bounds spare scans


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(60):
        k, dim = 5, int(rng.integers(2, 9))
        old = rng.integers(-60, 60, (k, dim))
        new = old + rng.integers(-9, 9, (k, dim))
        radius = rng.uniform(0, 40, k)
        fall = clusters.loosening(old, new, radius)
        for i in range(k):
            step = rng.normal(size=(300, dim))
            x = old[i] + step / np.linalg.norm(step, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1))
            other = [j for j in range(k) if j != i]
            lost = max(np.max(np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)) for j in other)
            assert lost <= fall[i]
            less += fall[i] < max(np.linalg.norm((new - old)[j]) for j in other) * 0.99
    assert less > 100


def test_distances_of_large_numbers_are_exact():
    big = 1 << 26
    x = np.array([[big, -big, 3], [0, 0, 0]])
    c = np.array([[-big, big, 4], [1, 2, 3]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert clusters.squared_distances(x, c).tolist() == want


# ------------------------------------------------------------------ contamination
def plain_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items, window=10, anchors=3, reach=20):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    words = [plain_words(t) for _, t in docs]
    count = {}
    for w in words:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = []
    for (i, _), w in zip(docs, words):
        hit, got, near = set(), set(), set()
        places = {}
        for p, x in enumerate(w):
            places.setdefault(x, []).append(p)
        for win, owners in wins.items():
            for p in places.get(win[0], []):
                if tuple(w[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    got |= owners
            rare = sorted((count.get(x, 0), x) for x in set(win))[:anchors]
            if rare[0][0] and any(all(any(abs(q - p) <= reach for q in places.get(x, [])) for _, x in rare) for p in places.get(rare[0][1], [])):
                near |= owners
        got, near = got - {None}, near - {None}
        out.append((i, len(w), len(hit), len(got), sha(",".join(sorted(map(str, got)))), bool(hit), len(near)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocab = ["the", "of", "Émile", "x1"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(vocab, [30, 20, 5, 5] + [1] * 60, k=n))
    items = [(i, say(rng.randint(10, 30))) for i in range(8)] + [(9, None), (10, ""), (11, " .,\n"), (12, "the"), (13, "The, OF x1"), (14, "the the the"),
                                                               (3, say(15)), (None, say(14)), (15, "zebra never seen")]
    items.append((16, items[0][1]))
    part = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)]
    docs += [(100, say(20) + " " + items[0][1].upper().replace("ÉMILE", "Émile") + " " + say(5)), (101, part(1, 0, 9)), (102, part(1, 0, 10)), (103, items[2][1].replace(" ", "-- \t")),
             (104, None), (105, ""), (106, "\x00 ."), (107, say(3000) + " " + items[4][1] + " " + say(300)), (108, " ".join(reversed(items[5][1].split()))),
             (109, "the " * 5000 + part(6, 0, 10)), (110, items[7][1] + " " + items[7][1]), (110, items[7][1] + " " + items[7][1]), (110, "quite another text"),
             (None, items[0][1]), (None, "clean"), (111, items[17][1] if len(items) > 17 else ""), (112, "w" * 70_000 + " " + items[3][1])]
    docs += [(200 + i, items[1][1]) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, texts, window):
    docs, items = texts
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, k1 int, n int").repartition(4)
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, phrase string, wid int")
    got = contamination.decontaminated_by_document(d, b, window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_contamination(docs, items, window)


def test_contamination_without_broadcasts_or_rows(spark, texts, monkeypatch):
    docs, items = texts
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "FEW_ROWS", 0)
    got = contamination.decontaminated_by_document(d, b)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_contamination(docs, items)
    assert contamination.decontaminate(d.limit(0), b).count() == 0
    clean = contamination.decontaminate(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_near or r.n_items for r in clean)


# ------------------------------------------------------------------ conversations
def brute_edits(codes):
    """Least (cost, letters) by a forward table over rows and states, inserts closed over at every row."""
    table = {0: (0, "")}

    def better(t, st, new):
        if st not in t or new < t[st]:
            t[st] = new
            return True
        return False

    def close(t):
        todo = list(t)
        while todo:
            st = todo.pop()
            for c, to in conversations.NEXT[st].items():
                if c != "s" and better(t, to, (t[st][0] + 5, t[st][1] + "I")):
                    todo.append(to)
        return t

    for x in codes:
        table, new = close(table), {}
        role, fault = divmod(x, 4)
        for st, (c, a) in table.items():
            better(new, st, (c + 2, a + "D"))
            if fault in (conversations.BLANK, conversations.DUPLICATE):
                continue
            c += 5 * (fault == conversations.TRUNCATED)
            for i, to in conversations.NEXT[st].items():
                if role < 3 and "sua"[role] == i:
                    better(new, to, (c, a + "K"))
                if i != "s":
                    better(new, to, (c + 1, a + "R"))
        table = new
    table = close(table)
    return min(v for st, v in table.items() if st in conversations.ENDS)


def test_cheapest_edits_against_a_full_table():
    kinds = [role * 4 + fault for role in range(4) for fault in range(4)]
    assert conversations.cheapest_edits(b"") == (0, "")
    for codes in itertools.chain(*(itertools.product(kinds, repeat=n) for n in (1, 2, 3))):
        assert conversations.cheapest_edits(bytes(codes)) == brute_edits(codes), codes
    rng = random.Random(3)
    for n in [5, 8, 20, 60, 400] * 60:
        codes = bytes(rng.choices(kinds, [rng.choice([1, 8]) for _ in kinds], k=n))
        assert conversations.cheapest_edits(codes) == brute_edits(codes)


def brute_repair(rows):
    """By conversation: the contract read literally."""
    space = lambda x: " " if x is None else x
    out, white = [], " \t\n\x0b\f\r"
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in mine:
            last = text.strip(white)[-1:]
            fault = 3 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 1
            seen.add((role, text))
            codes.append(4 * (("sua".index(role[0])) if role[:1] and role[0] in "sua" else 3) + fault)
        cost, audit = brute_edits(codes)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        written, i = [], 0
        for letter in audit:
            before = written[-1][0][0] if written else ""
            if letter != "D":
                role = mine[i][1] if letter == "K" else "assistant" if before == "u" else "user"
                written.append((role, "" if letter == "I" else mine[i][2]))
            i += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in written))
        counts = [sum(x % 4 == f for x in codes) for f in (3, 2, 1)]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in written))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "no", "", " \n\t", None, "What?", "Well! \r\n", "a\x0b", "é", "x" * 30_000 + ".", "line\nbreak."]
    rows += [(10_000 + rng.randrange(30), rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(77_777, i, rng.choice(["user", "assistant"]), rng.choice(texts + [f"t{i}." for _ in range(20)])) for i in range(1500)]
    rows += [(None, i, "user" if i % 2 else "assistant", "Same.") for i in range(60)] + rows[-20:] + rows[:5]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_conversations(spark, talks, partitions):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, part string, copies int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = conversations.repair_damaged(df)
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert got.columns == names
        assert sorted(map(tuple, got.collect()), key=repr) == brute_repair(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert conversations.repair_damaged(df.limit(0)).count() == 0


def test_all_rows_dropped(spark):
    dropped = [(c, t) for c in range(50) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in dropped], "conv_id long, turn long, role string, text string")
    got = conversations.repair_damaged(df).collect()
    assert {r.conv_id for r in got} == {c for c, _ in dropped}
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for r in got)


def test_repaired_rows_follow_the_letters(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1))
    solution, rows = conversations.repair(df)
    audits = {r.conv_id: r.audit for r in solution.collect()}
    got = {}
    for r in rows.orderBy("part", "no").collect():
        got.setdefault(r.conv_id, []).append(r.edit)
    assert {c: a.replace("D", "") for c, a in audits.items() if a.replace("D", "")} == {c: "".join(e) for c, e in got.items()}
