"""Keyword phrases: RAKE scores, the noise predicate, repeated phrases and weak terms.

All of it is local to a document's row: phrases, word statistics, scores and counts are arrays made from the text where
it is read, so no text is shuffled. What several expressions use is made once per row (``T.once``).
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

WORDPUNCT = r"\w+|[^\w\s]+"
PUNCTUATION = list(string.punctuation)
SEP = "\u0001"


def rake_ignore() -> list[str]:
    return list(L.english_stopwords()) + PUNCTUATION


def rake_phrases(text: Column) -> Column:
    """Array of candidate phrases: maximal runs of word-punct tokens that are neither stopwords
    nor single punctuation characters (row-local)."""
    toks = F.regexp_extract_all(F.lower(T.col(text)), F.lit(WORDPUNCT), 0)
    marked = F.transform(toks, lambda t: F.when(t.isin(*sorted(set(rake_ignore()))), F.lit(SEP)).otherwise(t))
    # a class, not a repeated group: Java matches a group by recursion, and a long run of ignored words ends its stack
    return F.filter(F.split(F.array_join(marked, " "), f" ?{SEP}[ {SEP}]*"), lambda p: p != "")


def with_phrases(docs: DataFrame, text_col: str = "text", out: str = "_phrases") -> DataFrame:
    return T.once(docs, out, rake_phrases(F.col(text_col)))


def with_keywords(docs: DataFrame, text_col: str = "text", k: int = 20, out: str = "keywords") -> DataFrame:
    """``docs`` and an array column of its best ``k`` phrase occurrences (phrase, score): RAKE score, that is degree /
    frequency summed over the phrase's words in order; ties by phrase descending; score rounded to 2.

    The words of all phrases are sorted with their places: a word's frequency is the length of its run, its degree the
    sum of the run's phrase lengths. Sorted back by place, the words of a phrase are a run again, whose sum is its score.
    So the work is that of two sorts, also in the longest text."""
    d = with_phrases(docs, text_col)
    words = F.flatten(F.transform(F.transform("_phrases", lambda p: F.split(p, " ")), lambda ws, pi: F.transform(ws, lambda w, wi: F.struct(
        w.alias("w"), F.size(ws).alias("n"), pi.alias("pi"), wi.alias("wi")))))
    d = T.once(d, "_words", F.sort_array(words))
    d = T.once(d, "_w", F.col("_words.w"))
    d = T.once(d, "_at", T.starts_of("_w"))
    length = lambda at, of: lambda i, j: F.coalesce(F.get(at, j + 1), F.size(of)) - i
    run = lambda i, j: F.slice("_words", i + 1, length("_at", "_w")(i, j))
    d = T.once(d, "_ratio", F.transform("_at", lambda i, j: F.aggregate(run(i, j), F.lit(0), lambda acc, x: acc + x["n"]) / length("_at", "_w")(i, j)))
    placed = F.transform("_at", lambda i, j: F.transform(run(i, j), lambda x: F.struct(x["pi"].alias("pi"), x["wi"].alias("wi"), F.get("_ratio", j).alias("r"))))
    d = T.once(d, "_placed", F.sort_array(F.flatten(placed)))
    d = T.once(d, "_pi", F.col("_placed.pi"))
    d = T.once(d, "_from", T.starts_of("_pi"))
    score = lambda i, j: F.aggregate(F.slice("_placed", i + 1, length("_from", "_pi")(i, j)), F.lit(0.0), lambda acc, x: acc + x["r"])
    scored = F.transform("_from", lambda i, j: F.struct(score(i, j).alias("s"), F.get("_phrases", j).alias("p")))
    best = F.slice(F.sort_array(scored, asc=False), 1, k)
    found = F.transform(best, lambda x: F.struct(x["p"].alias("phrase"), F.round(x["s"], 2).alias("score")))
    return d.withColumn(out, found).drop("_phrases", "_words", "_w", "_at", "_ratio", "_placed", "_pi", "_from")


def rake_keywords(docs: DataFrame, text_col: str = "text", k: int = 20) -> DataFrame:
    """(doc_id, rank, phrase, score) of ``with_keywords``; a document without a phrase has no row."""
    d = with_keywords(docs.select("doc_id", text_col), text_col, k).select("doc_id", F.posexplode("keywords").alias("rank", "x"))
    return d.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.phrase", "x.score")


def _alternation(words) -> str:
    return r"\b(" + "|".join(re.escape(w) for w in words) + r")\b"


def is_noise(p: Column) -> Column:
    """The strict noise predicate on a lower-cased candidate phrase."""
    stop = list(L.english_stopwords())
    verbs = [v.lower() for v in L.WEAK_VERBS + L.ACTION_VERBS]
    toks = F.split(p, " ")
    return (
        (F.length(p) < 2)
        | p.rlike(_alternation(L.BLACKLIST))
        | p.rlike(_alternation(L.MONTH_ABBREVIATIONS))
        | p.rlike(r"\b(19|20)\d{2}\b")
        | p.rlike(r"^[0-9]+$")
        | (F.regexp_count(p, F.lit("[0-9]")) > F.length(p) * 0.4)
        | p.isin(*verbs)
        | F.forall(toks, lambda t: t.isin(*stop))
    )


def _stripped() -> Column:
    return F.filter(F.transform("_phrases", lambda p: T.py_strip(p)), lambda c: (F.length(c) > 2) & (F.length(c) < 30))


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "candidates", least: int = 1) -> DataFrame:
    """``docs`` and an array column (candidate, n): stripped phrases of length 3..29 that are not noise, with counts;
    those that occur ``least`` times or more."""
    d = with_phrases(docs, text_col)
    d = T.once(d, "_c", F.sort_array(_stripped()))
    d = T.once(d, "_at", T.starts_of("_c"))
    runs = F.transform("_at", lambda i, j: F.struct(F.get("_c", i).alias("candidate"),
                                                    (F.coalesce(F.get("_at", j + 1), F.size("_c")) - i).cast("long").alias("n")))
    return d.withColumn(out, F.filter(F.filter(runs, lambda x: x["n"] >= least), lambda x: ~is_noise(x["candidate"]))).drop("_phrases", "_c", "_at")


def candidates(docs: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """(doc_id, candidate, n), one row per candidate of ``with_candidates``."""
    return with_candidates(docs.select("doc_id", text_col), text_col, least=least).select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.candidate", "c.n")


def repeated_phrases(docs: DataFrame, doc_terms: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """Candidates seen more than once, normalised (map, else title case), minus names already
    extracted (case-insensitive) and minus weak terms; appended as technical skills."""
    cand = candidates(docs, text_col, least=2).where(~F.col("candidate").isin(*L.WEAK_SKILLS))
    norm_map = F.create_map(*[x for k, v in L.NORMALIZATION.items() for x in (F.lit(k), F.lit(v))])
    named = cand.withColumn("canonical", F.coalesce(F.element_at(norm_map, F.col("candidate")),
                                                    T.python_title(F.col("candidate"))))
    have = doc_terms.select("doc_id", F.lower("canonical").alias("_low")).distinct()
    out = named.join(have, (named.doc_id == have.doc_id) & (F.lower(named.canonical) == have._low), "left_anti")
    return out.select("doc_id", "candidate", "canonical")


def with_weak_list(docs: DataFrame, text_col: str = "text", out: str = "weak_skills") -> DataFrame:
    """``docs`` and an array column of its candidates that equal or contain a filler term, title-cased and sorted."""
    filler = "|".join(re.escape(w) for w in L.WEAK_SKILLS)
    d = with_phrases(docs, text_col)
    hit = F.filter(F.array_distinct(F.filter(_stripped(), lambda c: c.rlike(filler))), lambda c: ~is_noise(c))
    return d.withColumn(out, F.array_sort(F.array_distinct(F.transform(hit, lambda c: T.python_title(c))))).drop("_phrases")


def weak_terms(docs: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """(doc_id, weak): candidates equal to or containing a filler term, title-cased, distinct."""
    d = with_weak_list(docs.select("doc_id", text_col), text_col)
    return d.select("doc_id", F.explode("weak_skills").alias("weak"))
