"""Document x target matching: density, coverage, TF-IDF, embeddings, skill gap.

Scale rule: documents are never crossed with targets. Pair operators take the assignment ``pairs`` (doc_id, target_id;
see ``resolve_targets``) and return each of its pairs once, also one without a common term and one without a target,
for which the neutral values of the rules stand. What a side needs (words, terms, skills) is built once per document
and once per target, and the pairs meet it by equi-joins on the ids. Retrieval over all documents, without an
assignment, goes through an equi-join on a term (word, substring, gram).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import lexicons as L
from ..functions import text as T
from ..functions.search import phrases_found, words_found
from ..sources.corpus import every_pair

#: Characters of a word or name by which it is found at a place in a token; TARGET_WORD has as many at least.
GRAM = 3
TARGET_WORD = r"\b[a-zA-Z][a-zA-Z0-9+#.]{2,}\b"


#: Target rows (words, vectors, skills) of so few targets are sent to the pairs; those of more meet them by a shuffle.
FEW_TARGETS = 2000


#: The same for rows of one term each.
FEW_TERMS = 300_000


#: So few names are looked for in every text where it is read; more are found by their grams.
FEW_NAMES = 1000


#: The same for the words of targets.
FEW_WORDS = 50_000


def few(targets: DataFrame, rows: int = FEW_TARGETS) -> DataFrame:
    """``targets`` (rows of bounded size), to be broadcast if they are counted to be few."""
    return F.broadcast(targets) if targets.limit(rows + 1).count() <= rows else targets


def target_words(targets: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """(target_id, word): distinct lower-cased target words minus the density stopwords."""
    words = targets.select(
        "target_id",
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TARGET_WORD), 0))).alias("word"),
    )
    return words.join(dims.density_stopwords(spark), "word", "left_anti")


def found_words(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs``, which tell its rows apart, and _found: the target words (no white space, GRAM
    characters or more) that are substrings of the row's lower text; no row if there is none.

    Exact without a cross join: a word has no whitespace, so it occurs in a text iff it is a substring of one whitespace
    token. Up to FEW_WORDS words (counted) go to every task as one automaton, through which its texts are streamed. For
    more, a document's distinct tokens are met by the words at every position through the words' first GRAM characters,
    and verified there. Tokens and places stay in the document's task if Catalyst can broadcast the words; what is
    shuffled then are the hits alone.
    """
    keys = [c for c in docs.columns if c != text_col]
    some = [r.word for r in words.select("word").where(F.length("word") >= GRAM).distinct().limit(FEW_WORDS + 1).collect()]
    if len(some) <= FEW_WORDS:
        d = phrases_found(docs, text_col, some, "_found").where(F.size("_found") > 0)
        return d.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"))
    tokens = docs.select(*keys, F.explode(F.array_distinct(F.split(F.lower(T.col(text_col)), T.WS_RUN))).alias("_token"))
    places = F.sequence(F.lit(1), F.length("_token") - GRAM + 1)
    at = tokens.where(F.length("_token") >= GRAM).select(*keys, "_token", F.explode(places).alias("_pos"))
    vocab = words.select("word").distinct()
    begins = F.expr(f"substring(_token, _pos, {GRAM})") == F.substring("word", 1, GRAM)
    found = at.join(vocab, begins).where(F.expr("substring(_token, _pos, length(word)) = word"))
    return found.groupBy(*keys).agg(F.collect_set("word").alias("_found"))


def keyword_density(docs: DataFrame, targets: DataFrame, spark: SparkSession, text_col: str = "text",
                    target_text_col: str = "text") -> DataFrame:
    """Retrieval: every (doc, target) with a matched word: matched, total, percent, missing words.

    Pairs without any match have density 0 and all words missing; they are not materialised.
    """
    tw = target_words(targets, spark, target_text_col)
    totals = tw.groupBy("target_id").agg(F.count(F.lit(1)).alias("total_words"),
                                        F.array_sort(F.collect_list("word")).alias("_words"))
    hits = found_words(docs.select("doc_id", text_col), tw, text_col).select("doc_id", F.explode("_found").alias("word"))
    pairs = (hits.join(tw, "word")
             .groupBy("doc_id", "target_id")
             .agg(F.count(F.lit(1)).alias("matched_count"), F.collect_list("word").alias("_matched")))
    out = pairs.join(totals, "target_id")
    missing = F.array_except(F.col("_words"), F.col("_matched"))
    return out.select(
        "doc_id", "target_id", "matched_count", "total_words",
        F.round(F.col("matched_count") / F.greatest(F.col("total_words"), F.lit(1)) * 100, 1).alias("density_percent"),
        F.array_join(missing, ",").alias("top_missing"),
        missing.alias("top_missing_list"),
    )


def assigned_density(docs: DataFrame, targets: DataFrame, pairs: DataFrame, text_col: str = "text",
                     target_text_col: str = "text") -> DataFrame:
    """Every pair of the assignment: matched, total, percent and missing words (sorted, all of them).

    A target word counts if it is a substring of the document's lower text. A target without a usable word has 0 %; no
    target (or one without a text) has a null percent, which the verdict takes as ``NO_TARGET_DENSITY``. No text moves:
    a document's pairs get the target words found in it, once for all of its targets.
    """
    words = F.array_except(F.regexp_extract_all(F.lower(T.col(target_text_col)), F.lit(TARGET_WORD), 0),
                           F.array(*[F.lit(w) for w in L.DENSITY_STOPWORDS]))
    t = targets.select("target_id", F.array_sort(words).alias("_words"))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", F.md5(T.col(text_col)).alias("_md5"), text_col)  # an id may come with several texts
    found = found_words(d, t.select(F.explode("_words").alias("word")), text_col)
    d = d.select("doc_id", "_md5").join(found, ["doc_id", "_md5"], "left").drop("_md5")
    p = pairs.select("doc_id", "target_id").join(d, "doc_id", "left").join(few(t), "target_id", "left")
    p = p.select("doc_id", "target_id", "_words", F.array_except("_words", F.coalesce("_found", none)).alias("_missing"))
    missing = F.coalesce("_missing", none)
    total = F.when(F.col("_words").isNull(), 0).otherwise(F.size("_words"))
    matched = total - F.size(missing)
    percent = F.when(F.col("_words").isNotNull(), F.round(matched / F.greatest(total, F.lit(1)) * 100, 1))
    return p.select("doc_id", "target_id", matched.alias("matched_count"), total.alias("total_words"), percent.alias("density_percent"),
                    F.array_join(missing, ",").alias("top_missing"), missing.alias("top_missing_list"))


def every_density(docs: DataFrame, targets: DataFrame, pairs: DataFrame, text_col: str = "text", target_text_col: str = "text",
                  beside: DataFrame | None = None, missing: str | None = ",") -> DataFrame:
    """``assigned_density`` of the documents of ``docs`` with every target text, and what else ``pairs`` chose for them
    (see ``every_pair``); joined, if given, with the rows ``beside`` by doc_id. The missing words are one text, put together by ``missing``.

    The pairs are made last, from one row per document: which words of all targets it holds, as bits. So no pair is
    shuffled or joined, and a pair costs its target's words alone. For more than FEW_TARGETS targets, or FEW_TERMS words
    of them, the pairs are joined as ``assigned_density`` does."""
    words = F.array_except(F.regexp_extract_all(F.lower(T.col(target_text_col)), F.lit(TARGET_WORD), 0),
                           F.array(*[F.lit(w) for w in L.DENSITY_STOPWORDS]))
    t = targets.select("target_id", "target_kind", F.array_sort(words).alias("_words"))
    n, size = t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_words")), F.lit(0))).first()
    texts = [F.array_join("top_missing_list", missing).alias("top_missing")] if missing is not None else []
    if n > FEW_TARGETS or size > FEW_TERMS:
        out = assigned_density(docs, targets, every_pair(pairs, docs, targets), text_col, target_text_col)
        out = out.select("doc_id", "target_id", "matched_count", "total_words", "density_percent", *texts)
        return out if beside is None else beside.join(out, "doc_id")
    rows = [(r.target_id, r.target_kind, r["_words"]) for r in t.collect()]
    vocabulary = sorted({w for *_, ws in rows for w in ws})
    # no text moves; each row becomes many, so the rows are dealt to all tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id"] if beside is not None else ["_id", "_none"]
    known = [] if beside is not None else [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    d = words_found(docs.select("doc_id", text_col), text_col, vocabulary, "_bits").where("doc_id is not null")
    if beside is None:  # documents without an id are one, which has no text
        none = docs.where("doc_id is null").select("doc_id").distinct()
        d = d.unionByName(none.select("doc_id", F.lit(None).cast("binary").alias("_bits")))
    d = d.select("*", *known).repartition(tasks, *key)
    more = pairs.where("target_kind != 'text'").select("target_id", "doc_id", *known).groupBy(*key)
    more = more.agg(F.collect_list(F.struct("target_id")).alias("_c")).select(*key, F.transform("_c", lambda x: x["target_id"]).alias("_more"))
    d = d.join(more, key, "left").select("doc_id", "_bits", "_more")
    d = d if beside is None else beside.join(d, "doc_id")
    kept = [c for c in d.columns if c not in ("_bits", "_more")]
    at: dict = {}
    for k, (i, *_) in enumerate(rows):
        at.setdefault(i, []).append(k)
    given = [(i, k) for i in sorted({i for i, kind, _ in rows if kind == "text"}) for k in at[i]]

    def meet(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        place = {w: k for k, w in enumerate(vocabulary)}
        width = (max(1, len(vocabulary)) + 7) // 8

        def block(chosen):
            """Of rows of targets (the one after the last stands for no target): words in a line, their sizes, starts."""
            lists = [rows[k][2] if k < len(rows) else [] for k in chosen]
            size = np.array([len(x) for x in lists], np.int64)
            flat = [w for x in lists for w in x]
            return pa.array(flat, pa.string()), np.array([place[w] for w in flat], np.int64), size, np.cumsum(size) - size

        def pairs_of(held, ids, chosen, made):
            """One list of pairs for each row of ``held``, with the same targets each."""
            texts, word, size, start = made
            lost = ~held[:, word]
            filled = size > 0
            n_lost = np.zeros((len(held), len(ids)), np.int64)
            if filled.any():
                n_lost[:, filled] = np.add.reduceat(lost, start[filled], axis=1, dtype=np.int64)
            known = np.array([k < len(rows) for k in chosen], bool)
            target = pa.array([i for i in ids] * len(held), pa.int64())
            total = np.tile(size, len(held))
            cols = [target, pa.array(total - n_lost.ravel()), pa.array(total), pa.array(np.tile(known, len(held)))]
            if missing is not None:
                ends = pa.array(np.append(0, np.cumsum(n_lost)), pa.int32())
                cols.append(pc.binary_join(pa.ListArray.from_arrays(ends, texts.take(pa.array(np.nonzero(lost)[1]))), missing))
            made = pa.StructArray.from_arrays(cols, ["target_id", "matched", "total", "known", "missing"][:len(cols)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * len(ids), pa.int32()), made)

        all_given = block([k for _, k in given])
        others: dict = {}
        for big in batches:
            for begin in range(0, big.num_rows, 100):
                b = big.slice(begin, 100)
                bits = b"".join(x.as_py() or bytes(width) for x in b.column("_bits"))
                held = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=1, bitorder="little") > 0
                same = {}  # rows with the same choices, which are few in kind, meet them together
                for k, m in enumerate(b.column("_more").to_pylist()):
                    same.setdefault(tuple(m or ()), []).append(k)
                found = [(np.arange(len(held)), pairs_of(held, [i for i, _ in given], [k for _, k in given], all_given))]
                for m, at_rows in same.items():
                    chosen = [(i, k) for i in m for k in at.get(i, [len(rows)])]
                    if chosen:
                        made = others.setdefault(m, block([k for _, k in chosen])) if len(others) < 1000 else block([k for _, k in chosen])
                        found.append((np.array(at_rows), pairs_of(held[at_rows], [i for i, _ in chosen], [k for _, k in chosen], made)))
                part = pa.table({c: b.column(c) for c in kept}).to_batches()[0]
                for at_rows, made in found:
                    of = part.take(pa.array(at_rows))
                    yield pa.record_batch([*of.columns, made], names=[*kept, "_pairs"])

    kind = "target_id:bigint,matched:bigint,total:bigint,known:boolean" + (",missing:string" if missing is not None else "")
    schema = d.select(*kept, F.lit(None).cast(f"array<struct<{kind}>>").alias("_pairs")).schema
    p = d.mapInArrow(meet, schema).select(*kept, F.explode("_pairs").alias("_p"))
    percent = F.when(F.col("_p.known"), F.round(F.col("_p.matched") / F.greatest(F.col("_p.total"), F.lit(1)) * 100, 1))
    return p.select(*kept, "_p.target_id", F.col("_p.matched").cast("int").alias("matched_count"),
                    F.col("_p.total").cast("int").alias("total_words"), percent.alias("density_percent"),
                    *([F.col("_p.missing").alias("top_missing")] if missing is not None else []))


def top_k_per_target(pairs: DataFrame, score_col: str, k: int, id_col: str = "doc_id") -> DataFrame:
    """Best k rows per target by score desc, id asc.  Spark plans the rank filter as a partial
    (map-side) group limit before the shuffle, so a hot target never funnels all its rows."""
    w = Window.partitionBy("target_id").orderBy(F.col(score_col).desc(), F.col(id_col).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ names in texts
def names_in_texts(docs: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, name) for every lower-cased name of ``names`` that is a substring of the document's lower text.

    A name's longest piece without white space lies inside one token of the text. So the distinct tokens of the corpus
    are cut into the grams (GRAM characters, fewer for shorter pieces) at every position, equi-joined with the first
    gram of the pieces, and verified at that position. A name of one piece is then decided; one of several pieces makes
    candidates, for which alone the text is searched. The vocabulary, not the corpus, is cut into grams, and names may
    be as many as the targets bring: Catalyst broadcasts them only while they are small.
    """
    ws = r"[ \t\n\r\f\x0B]+"
    pieces = F.split("name", ws)
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 1)["p"]
    n = _lower_names(names)
    n = n.select("name", longest.alias("piece")).where("piece != ''")
    n = n.withColumn("gram", F.substring("piece", 1, GRAM)).withColumn("glen", F.length("gram"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(T.col(text_col)), ws))).alias("token")).where("token != ''")
    vocabulary = tokens.select("token").distinct()
    grams = vocabulary.select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("pos")).select(
        "token", "pos", F.explode(F.array(*[F.lit(k) for k in range(1, GRAM + 1)])).alias("glen"))
    grams = grams.where(F.col("pos") + F.col("glen") <= F.length("token") + 1).withColumn("gram", F.expr("substring(token, pos, glen)"))
    found = grams.join(n, ["glen", "gram"]).where(F.expr("substring(token, pos, length(piece)) = piece"))
    found = found.select("token", "name", (F.col("name") == F.col("piece")).alias("whole")).distinct()
    hits = tokens.join(found, "token").select("doc_id", "name", "whole").distinct()
    open_ = hits.where(~F.col("whole")).groupBy("doc_id").agg(F.collect_set("name").alias("_names"))
    text = docs.select("doc_id", F.lower(T.col(text_col)).alias("_lt")).join(open_, "doc_id")
    held = text.select("doc_id", F.explode(F.filter("_names", lambda x: F.col("_lt").contains(x))).alias("name"))
    return hits.where("whole").select("doc_id", "name").unionByName(held).distinct()


def _lower_names(names: DataFrame) -> DataFrame:
    return names.select(F.lower("name").alias("name")).where("name != ''").distinct()


def name_lists(docs: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, _s): the names of ``names_in_texts`` as one list per id.

    Up to FEW_NAMES names (counted) go to every task as one automaton, through which each text is streamed where it is
    read; nothing but the lists moves. A name without a character other than white space is found by neither way."""
    n = _lower_names(names)
    few_names = [r.name for r in n.limit(FEW_NAMES + 1).collect()]
    if len(few_names) > FEW_NAMES:
        return names_in_texts(docs, names, text_col).groupBy("doc_id").agg(F.collect_set("name").alias("_s"))
    d = phrases_found(docs.select("doc_id", text_col), text_col, [x for x in few_names if x.strip(" \t\n\r\f\x0b")], "_s")
    return d.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("_s"))).alias("_s"))


# ------------------------------------------------------------------ keyword coverage
def keyword_coverage(doc_terms: DataFrame, target_terms: DataFrame, docs: DataFrame, pairs: DataFrame,
                     text_col: str = "text") -> DataFrame:
    """Every pair of the assignment: coverage of the target's canonical terms K by the document, with the substring bonus.

    coverage = |K & D| / |K|; each missing term whose lower form occurs in the lower raw text adds 0.5/|K| and moves to
    matched; final = min(1, coverage + bonus). Without a target, or with an empty K, the coverage is
    ``NO_TARGET_COVERAGE`` and the counts are null; matched then holds the document's technical terms (no target) or
    nothing (empty K). One row of names per document and per target; the pairs join two such rows.
    """
    none = F.array().cast("array<string>")
    k = target_terms.groupBy("target_id").agg(F.array_sort(F.collect_set("canonical")).alias("_k"))
    tech = F.when(F.col("category") == "technical", F.col("canonical"))
    d = doc_terms.groupBy("doc_id").agg(F.collect_set("canonical").alias("_d"), F.array_sort(F.collect_set(tech)).alias("_tech"))
    names = target_terms.select(F.col("canonical").alias("name")).distinct()
    lower = few(names.select(F.lower("name").alias("_l"), "name"), FEW_NAMES)
    sub = name_lists(docs, names, text_col).select("doc_id", F.explode("_s").alias("_l")).join(lower, "_l")
    sub = sub.groupBy("doc_id").agg(F.collect_set("name").alias("_s"))  # the names as targets spell them, once per document
    j = pairs.select("doc_id", "target_id").join(d, "doc_id", "left").join(sub, "doc_id", "left").join(few(k), "target_id", "left")
    j = j.select("doc_id", "target_id", "_k", F.coalesce("_d", none).alias("_d"), F.coalesce("_s", none).alias("_s"), F.coalesce("_tech", none).alias("_tech"))
    j = T.once(j, "_rest", F.array_except("_k", "_d"))
    j = T.once(j, "_bonus", F.array_intersect("_rest", "_s"))
    j = j.withColumn("_exact", F.array_intersect("_k", "_d")).withColumn("_missing", F.array_except("_rest", "_bonus"))
    known, n, exact, bonus = F.col("_k").isNotNull(), F.size("_k"), F.size("_exact"), F.size("_bonus")
    coverage = exact / n
    final = F.least(F.lit(1.0), coverage + bonus * (F.lit(0.5) / n))
    when = lambda x: F.when(known, x)
    matched = when(F.array_sort(F.concat("_exact", "_bonus"))).otherwise(F.when(F.col("target_id").isNull(), F.col("_tech")).otherwise(none))
    return j.select(
        "doc_id", "target_id", when(n).alias("total_keywords"), when(exact + bonus).alias("matched_count"),
        when(n - exact - bonus).alias("missing_count"), when(F.round(coverage, 3)).alias("coverage_ratio"),
        when(final).otherwise(F.lit(L.NO_TARGET_COVERAGE)).alias("keyword_coverage"),
        matched.alias("matched"), F.coalesce("_missing", none).alias("missing"))


# ------------------------------------------------------------------ TF-IDF pair similarity
TFIDF_TOKEN = r"\b\w\w+\b"
IDF_ONE_SIDE = 1.4054651081081644  # ln(3/2) + 1: smooth idf with n = 2 documents, df = 1


def tfidf_terms(df: DataFrame, id_col: str, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """(id, term, c, n): 1-3 gram counts after lower-casing and stopword removal, with the sum of the id's squared counts
    on each row; one row of ``df`` per id.

    Local to the row: the tokens of a text are counted in its task, so nothing is shuffled to count them. A text of ASCII
    characters alone is cut there; of others, whose word ends Java knows by Unicode, the tokens are sent."""
    low = T.col(text_col)
    plain, low = F.octet_length(low) == F.length(low), F.lower(low)
    toks = F.when(~plain, F.regexp_extract_all(low, F.lit(TFIDF_TOKEN), 0))
    stop = frozenset(L.english_stopwords())

    def count(batches):
        import re
        from collections import Counter

        tokens = re.compile(r"\w\w+", re.ASCII).findall
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b = big.slice(at, 200)
                ids, terms, counts, sizes, squares = b.column("id"), [], [], [], []
                for text, words in zip(b.column("_lt").to_pylist(), b.column("_t")):
                    t = [w for w in (words.as_py() if text is None else tokens(text)) if w not in stop]
                    c = Counter(t)
                    c.update(map(" ".join, zip(t, t[1:])))
                    c.update(map(" ".join, zip(t, t[1:], t[2:])))
                    terms.extend(c)
                    counts.extend(c.values())
                    sizes.append(len(c))
                    squares.append(sum(x * x for x in c.values()))
                    if len(terms) > 500_000:
                        yield rows(ids.slice(0, len(sizes)), terms, counts, sizes, squares)
                        ids, terms, counts, sizes, squares = ids.slice(len(sizes)), [], [], [], []
                yield rows(ids, terms, counts, sizes, squares)

    def rows(ids, terms, counts, sizes, squares):
        import numpy as np
        import pyarrow as pa

        at = np.repeat(np.arange(len(sizes)), sizes)
        return pa.record_batch([ids.take(pa.array(at)), pa.array(terms, pa.string()), pa.array(counts, pa.int64()),
                                pa.array(squares, pa.int64()).take(pa.array(at))], names=["id", "term", "c", "n"])

    d = df.select(F.col(id_col).alias("id"), F.when(plain, low).alias("_lt"), toks.alias("_t"))
    return d.mapInArrow(count, f"id {df.select(id_col).schema[0].dataType.simpleString()}, term string, c long, n long")


def _with_norm(terms: DataFrame) -> DataFrame:
    """Terms as ``tfidf_terms`` gives them; the sum of squared counts is added if they lack it."""
    if "n" in terms.columns:
        return terms
    return terms.join(terms.groupBy("id").agg(F.sum(F.col("c") * F.col("c")).alias("n")), "id")


def tfidf_pair_similarity(doc_terms: DataFrame, target_terms: DataFrame, pairs: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Every pair of the assignment (without one: every pair that shares a term): cosine of TF-IDF vectors fitted on the pair alone, over all terms of both.

    A term of both sides has idf 1, a term of one side ``IDF_ONE_SIDE``. So with N the sum of a side's squared counts
    and S the part of it in shared terms, the squared norm is S + IDF_ONE_SIDE^2 * (N - S): a join on (target, term) of
    the terms of the assigned documents and one aggregate per pair; N comes with the terms. Counts stay integers until the end. A pair without a shared term has 0, one without a target null.
    ``every``: the pairs are nearly all of documents and targets, so the terms are joined first and the pairs then.
    """
    d = _with_norm(doc_terms).select(F.col("id").alias("doc_id"), "term", F.col("c").alias("cd"), F.col("n").alias("nd"))
    t = _with_norm(target_terms).select(F.col("id").alias("target_id"), "term", F.col("c").alias("ct"), F.col("n").alias("nt"))
    sums = [F.sum(F.col("cd") * F.col("ct")).alias("dot"), F.sum(F.col("cd") * F.col("cd")).alias("sd"),
            F.sum(F.col("ct") * F.col("ct")).alias("st"), F.max("nd").alias("nd"), F.max("nt").alias("nt")]
    t = few(t, FEW_TERMS)  # else all grams of all documents would be shuffled to meet them
    if pairs is None or every:
        j = d.join(t, "term").groupBy("doc_id", "target_id").agg(*sums)
    else:
        own = pairs.select("doc_id", "target_id").distinct()
        # only terms that some target has can be shared; most of a document's grams end here
        held = d.join(few(t.select("term").distinct(), FEW_TERMS), "term", "left_semi")
        j = held.join(own.where("target_id is not null"), "doc_id").join(t, ["target_id", "term"]).groupBy("doc_id", "target_id").agg(*sums)
    if pairs is not None:
        j = pairs.select("doc_id", "target_id").distinct().join(j, ["doc_id", "target_id"], "left")
    one_side = F.lit(IDF_ONE_SIDE * IDF_ONE_SIDE)
    norm_d = F.col("sd") + one_side * (F.col("nd") - F.col("sd"))
    norm_t = F.col("st") + one_side * (F.col("nt") - F.col("st"))
    cosine_ = F.coalesce(F.round(F.col("dot") / F.sqrt(norm_d * norm_t), 6), F.lit(0.0))
    return j.select("doc_id", "target_id", F.when(F.col("target_id").isNotNull(), cosine_).alias("tfidf_similarity"))


# ------------------------------------------------------------------ embeddings
def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equal-length arrays (0.0 when either is missing or zero)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
    nb = F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.when(a.isNull() | b.isNull() | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / F.sqrt(na * nb))


def embedding_similarity(pairs: DataFrame, vectors: DataFrame, id_col: str = "vec_id",
                         vec_col: str = "embedding", targets: DataFrame | None = None) -> DataFrame:
    """Cosine of the document vector and the target vector for each pair: 0.0 if either is absent, null without a target.

    ``targets`` has the target_id of all targets of the pairs, if known: then their vectors alone are taken for that side."""
    v = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    tv = v.withColumnRenamed("_id", "target_id").withColumnRenamed("_v", "_tv")
    if targets is not None:
        tv = few(tv.join(targets.select("target_id").distinct(), "target_id", "left_semi"))
    out = pairs.join(v.withColumnRenamed("_id", "doc_id").withColumnRenamed("_v", "_dv"), "doc_id", "left").join(tv, "target_id", "left")
    found = F.when(F.col("target_id").isNotNull(), cosine(F.col("_dv"), F.col("_tv")))
    return out.withColumn("semantic_similarity", found).drop("_dv", "_tv")


def blended_similarity(sem: Column, tfidf: Column, has_target: Column) -> Column:
    """0.7 * semantic + 0.3 * tfidf (not clipped); ``NO_TARGET_SIMILARITY`` when there is no target.

    Inputs are taken at 6 decimals, so the blend is exact at 7 decimals on every engine."""
    s6 = F.round(F.coalesce(sem, F.lit(0.0)), 6)
    t6 = F.round(F.coalesce(tfidf, F.lit(0.0)), 6)
    return F.when(~has_target, F.lit(L.NO_TARGET_SIMILARITY)).otherwise(F.round(F.lit(0.7) * s6 + F.lit(0.3) * t6, 7))


# ------------------------------------------------------------------ skill gap
def gap_skills(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, skills): distinct lower skill names of the ten families, sorted (row-local)."""
    low = F.lower(T.col(text_col))
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in L.SKILL_FAMILY_PATTERNS]))
    return df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.transform(found, F.lower))).alias("skills"))


def skill_gap(doc_skills: DataFrame, target_skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of the assignment: required, present, missing, extra, match percent (0 if nothing is required)."""
    none = F.array().cast("array<string>")
    ds = doc_skills.select(F.col("id").alias("doc_id"), F.col("skills").alias("doc_skills"))
    ts = target_skills.select(F.col("id").alias("target_id"), F.col("skills").alias("required"))
    p = pairs.select("doc_id", "target_id").join(ds, "doc_id", "left").join(few(ts), "target_id", "left")
    p = p.select("doc_id", "target_id", F.coalesce("required", none).alias("required"), F.coalesce("doc_skills", none).alias("doc_skills"))
    present = F.array_intersect("required", "doc_skills")
    missing = F.array_except("required", "doc_skills")
    extra = F.array_except("doc_skills", "required")
    pct = F.round(F.size(present) / F.greatest(F.size("required"), F.lit(1)) * 100, 1)
    return p.select("doc_id", "target_id", "required", present.alias("present"), missing.alias("missing"),
                    extra.alias("extra"), pct.alias("match_percent"))


def gap_roadmap(missing: DataFrame, spark: SparkSession, skill_col: str = "skill") -> DataFrame:
    """First roadmap (in order) whose key contains the skill or is contained in it; else default."""
    rm = dims.roadmaps(spark)
    s = F.col(skill_col)
    hit = missing.join(F.broadcast(rm), F.col("key").contains(s) | s.contains(F.col("key")), "left")
    keys = [c for c in missing.columns]
    best = hit.groupBy(*keys).agg(F.min_by(F.struct("key", "timeline", "resources", "projects"), F.col("ord")).alias("r"))
    d = L.DEFAULT_ROADMAP
    return best.select(
        *keys,
        F.coalesce(F.col("r.key"), F.lit(d[0])).alias("roadmap"),
        F.coalesce(F.col("r.timeline"), F.lit(d[2])).alias("timeline"),
        F.coalesce(F.col("r.resources"), F.array(*[F.lit(x) for x in d[1]])).alias("resources"),
        F.coalesce(F.col("r.projects"), F.array(*[F.lit(x) for x in d[3]])).alias("projects"),
    )


def skill_mentions(targets: DataFrame, text_col: str = "text") -> DataFrame:
    """(target_id, ordered): each target's required skills with their whole-word hits in its text, most hits first,
    then by name; one row per target, from its text alone."""
    ts = gap_skills(targets, "target_id", text_col).withColumnRenamed("id", "target_id")
    t = ts.join(targets.select("target_id", F.lower(T.col(text_col)).alias("_lt")), "target_id")
    hits = lambda s: F.regexp_count(F.col("_lt"), F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E\b")))
    pairs = F.transform("skills", lambda s: F.struct((-hits(s)).alias("neg"), s.alias("skill")))
    return t.select("target_id", F.transform(F.array_sort(pairs), lambda x: F.struct(x["skill"].alias("skill"), (-x["neg"]).alias("mentions"))).alias("ordered"))


def priority_skills(gaps: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """Best k missing skills of every pair by mentions in the target (ties: skill asc); an empty list if none is missing."""
    ordered = few(mentions.select("target_id", F.col("ordered.skill").alias("_names")))
    j = gaps.select("doc_id", "target_id", "missing").join(ordered, "target_id", "left")
    names = F.array_intersect("_names", "missing")  # in the order of the first, by a set of the other
    return j.select("doc_id", "target_id", F.coalesce(F.slice(names, 1, k), F.array().cast("array<string>")).alias("priority_skills"))


def skill_demand(doc_skills: DataFrame, target_skills: DataFrame) -> DataFrame:
    """Per skill: targets asking for it, documents having it, and the gap ratio (full outer join)."""
    t = target_skills.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n_targets"))
    d = doc_skills.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n_docs"))
    j = t.join(d, "skill", "full_outer").na.fill(0, ["n_targets", "n_docs"])
    return j.withColumn("gap_ratio", F.round(F.col("n_targets") / F.greatest(F.col("n_docs"), F.lit(1)), 6))
