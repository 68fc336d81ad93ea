"""Text -> relational tables: lines, bullets, sentences, lexicon terms, sections,
verbs, readability, counts, contact signals, domain.

Per-document features are row-local projections (one stage, no shuffle): the
text never leaves its partition.  Operators that need the lexicons explode
token n-grams and equi-join a broadcast dimension; only the (small) hits are
shuffled, after map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import lexicons as L
from ..functions import text as T
from ..functions.search import phrases_found

BULLET_MARK = "[-*•‣◦]"          # analysis bullets (marker and whitespace required)
SCREEN_BULLET = "[-*•]"           # screening line count
FEEDBACK_BULLET = "[-*•‣◦]"       # feedback line count
SENTENCE_SPLIT = r"[.!?][ \t\n\r\f\x0B]+|\n+"
WORD = r"[A-Za-z0-9]+"
#: A whole word of [a-z0-9]+ without one of aeiouy.
WITHOUT_VOWEL = r"(?<![a-z0-9])[b-df-hj-np-tv-xz0-9]++(?![a-z0-9])"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?\d[\d \t\n\r\f\x0B\-().]{7,}\d"
YEAR = r"\b(19|20)\d{2}\b"
DATE = r"(?i)\b(19|20)\d{2}\b|\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?[ \t\n\r\f\x0B]*(19|20)\d{2}\b"


# ------------------------------------------------------------------ lines / bullets / sentences
def explode_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line): split on newline, position kept (0-based), each line stripped."""
    return docs.select("doc_id", F.posexplode(F.split(T.col(text_col), "\n")).alias("pos", "raw")).select(
        "doc_id", "pos", T.py_strip("raw").alias("line"))


def bullets_array(text: Column, limit: int | None = None) -> Column:
    """Bullet lines (marker plus whitespace), marker removed, longer than 15 chars, in order."""
    lines = F.transform(F.split(T.col(text), "\n"), lambda x: T.py_strip(x))
    marked = F.filter(lines, lambda x: x.rlike(f"^{BULLET_MARK}[ \\t\\n\\r\\f\\x0B]+"))
    bodies = F.transform(marked, lambda x: T.py_strip(F.regexp_replace(x, f"^{BULLET_MARK}[ \\t\\n\\r\\f\\x0B]+", "")))
    kept = F.filter(bodies, lambda x: F.length(x) > 15)
    return F.slice(kept, 1, limit) if limit else kept


def extract_bullets(docs: DataFrame, text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(doc_id, bullet_no, bullet): all bullets of each document, or its first ``limit`` (row-local)."""
    return docs.select("doc_id", F.posexplode(bullets_array(F.col(text_col), limit)).alias("bullet_no", "bullet")) \
        .withColumn("bullet_no", F.col("bullet_no") + 1)


def bullet_line_count(text: Column, marker_class: str) -> Column:
    """Lines whose first non-blank character is a marker (no whitespace needed after it)."""
    return F.regexp_count(T.col(text), F.lit(f"(?m)^[ \\t\\n\\r\\f\\x0B]*{marker_class}"))


def sentences_array(text: Column, limit: int | None = None) -> Column:
    parts = F.transform(F.split(T.col(text), SENTENCE_SPLIT), lambda x: T.py_strip(x))
    kept = F.filter(parts, lambda x: F.length(x) > 20)
    return F.slice(kept, 1, limit) if limit else kept


def extract_sentences(docs: DataFrame, text_col: str = "text", limit: int | None = None) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences_array(F.col(text_col), limit)).alias("sent_no", "sentence")) \
        .withColumn("sent_no", F.col("sent_no") + 1)


# ------------------------------------------------------------------ lexicon terms
def _gram_at(toks: Column, n: int):
    return lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(toks, i, n), " ").alias("gram"))


#: The tokens of the token normal form, and of the same without lower-casing, as they stand in the text.
TOKEN = r"[a-z0-9]+|\n|[^a-z0-9 \t\n\r\f\x0B]"
CASE_TOKEN = r"[A-Za-z0-9]+|\n|[^A-Za-z0-9 \t\n\r\f\x0B]"


def _with_grams(docs: DataFrame, text_col: str, norms: list[str], lower: bool = True, out: str = "_grams") -> DataFrame:
    """``docs`` and an array (pos, gram) of the token n-grams that begin with the first token of a phrase of as many
    tokens in ``norms``, with their start position."""
    tokens = F.regexp_extract_all(F.lower(T.col(text_col)) if lower else T.col(text_col), F.lit(TOKEN if lower else CASE_TOKEN), 0)
    toks = T.once(docs, "_toks", tokens)
    t = F.col("_toks")
    first: dict[int, set] = {}
    for x in norms:
        first.setdefault(len(x.split(" ")), set()).add(x.split(" ")[0])
    starts = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))),
                                lambda i: F.get(t, i - 1).isin(*sorted(first[n])))
    parts = [F.transform(starts(n), _gram_at(t, n)) for n in sorted(first)]
    return toks.withColumn(out, F.flatten(F.array(*parts))).drop("_toks")


def _gram_rows(docs: DataFrame, text_col: str, norms: list[str], lower: bool = True) -> DataFrame:
    """(doc_id, pos, gram) of ``_with_grams``: few rows more than there are hits leave the document's row."""
    grams = _with_grams(docs.select("doc_id", text_col), text_col, norms, lower)
    return grams.select("doc_id", F.explode("_grams").alias("g")).select("doc_id", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))


def _case_normal_form(c: Column) -> Column:
    """Token normal form without lower-casing (for case-sensitive names)."""
    t = F.regexp_replace(T.col(c), r"([^A-Za-z0-9 \t\n\r\f\x0B])", " $1 ")
    t = F.regexp_replace(t, r"\n", " \n ")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(t, r"^ +| +$", "")


def lexicon_match(docs: DataFrame, spark: SparkSession, text_col: str = "text",
                  lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, canonical): distinct lexicon terms of each document.

    Local to the row: each text's tokens, joined by blanks, are streamed through an automaton of the phrases. An id's rows
    meet as lists of phrases, one list a text, and the broadcast lexicon (a dimension of bounded rows) names them after.
    """
    lex = lexicon if lexicon is not None else dims.lexicon(spark)
    norms = [r.norm for r in lex.select("norm").collect()] if lexicon is not None else [r[1] for r in L.lexicon_rows()]
    d = phrases_found(docs.select("doc_id", text_col), text_col, [x for x in norms if x], "_found", TOKEN).where(F.size("_found") > 0)
    d = d.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("_found"))).alias("_found"))
    hits = d.select("doc_id", F.explode("_found").alias("norm")).join(F.broadcast(lex.select("norm", "canonical", "category")), "norm")
    return hits.select("doc_id", "category", "canonical").distinct()


def term_frequency_by_category(doc_terms: DataFrame) -> DataFrame:
    return doc_terms.groupBy("category", "canonical").agg(F.countDistinct("doc_id").alias("n_docs"))


def gazetteer_entities(docs: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """(doc_id, entities): case-sensitive names longer than 2 chars, distinct, in order of first use."""
    gaz = dims.gazetteer(spark).where(F.length("name") > 2) \
        .withColumn("norm", _case_normal_form(F.col("name")))
    norms = [r.norm for r in gaz.select("norm").collect()]
    grams = _gram_rows(docs, text_col, norms, lower=False)
    hits = grams.join(F.broadcast(gaz), F.col("gram") == F.col("norm")) \
        .groupBy("doc_id", "name", "ord").agg(F.min("pos").alias("first_pos"))
    ordered = hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("first_pos", "ord", "name"))).alias("_e"))
    return ordered.select("doc_id", F.array_join(F.transform("_e", lambda x: x["name"]), "|").alias("entities"))


# ------------------------------------------------------------------ sections
def section_columns(text: Column, patterns=L.SECTION_PATTERNS, prefix: str = "has_") -> list[Column]:
    low = F.lower(T.col(text))
    return [T.has_any(low, p).alias(f"{prefix}{k}") for k, p in patterns]


def section_presence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", *section_columns(F.col(text_col)))


def section_coverage(presence: DataFrame) -> DataFrame:
    """Share of documents with each section (long form via stack)."""
    names = [k for k, _ in L.SECTION_PATTERNS]
    stacked = presence.select(F.expr(
        f"stack({len(names)}, " + ", ".join(f"'{n}', cast(has_{n} as int)" for n in names) + ") as (section, present)"))
    return stacked.groupBy("section").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("present").alias("n_present"),
                                          F.round(F.avg("present"), 6).alias("share"))


# ------------------------------------------------------------------ verbs
def verb_usage(docs: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """(doc_id, strong_verbs, weak_verbs, n_strong, n_weak): distinct verbs in order of first use.

    Part of speech is replaced by lexicon membership of the surface token. Row-local; a document without a verb has
    empty lists.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(T.col(text_col)), F.lit(r"[a-z]+"), 0))
    found = docs.select("doc_id", words.alias("words")).select(
        "doc_id",
        F.filter("words", lambda w: w.isin(*L.ACTION_VERBS)).alias("strong_verbs"),
        F.filter("words", lambda w: w.isin(*L.WEAK_VERBS)).alias("weak_verbs"),
    )
    return found.select("*", F.size("strong_verbs").alias("n_strong"), F.size("weak_verbs").alias("n_weak"))


# ------------------------------------------------------------------ readability and counts
def readability_columns(text: Column) -> list[Column]:
    """word_count, sentence_count, avg_words_per_sentence, flesch_kincaid_score, readability_grade."""
    norm = F.regexp_replace(T.col(text), f"{FEEDBACK_BULLET}[ \\t\\n\\r\\f\\x0B]*", "\n")
    n_sent = F.size(F.filter(F.split(norm, SENTENCE_SPLIT), lambda s: F.length(T.py_strip(s)) > 5))
    low = F.lower(norm)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    n_words_raw = F.size(words)
    syllables = F.regexp_count(low, F.lit("[aeiouy]+")) + F.regexp_count(low, F.lit(WITHOUT_VOWEL))
    s = F.greatest(n_sent, F.lit(1))
    w = F.greatest(n_words_raw, F.lit(1))
    avg = w / s
    fk = F.lit(206.835) - F.lit(1.015) * avg - F.lit(84.6) * (syllables / w)
    fk = F.greatest(F.lit(0.0), F.least(F.lit(100.0), fk))
    grade = (F.when(fk >= 70, "Easy").when(fk >= 50, "Standard").when(fk >= 30, "Difficult")
             .otherwise("Very Difficult"))
    return [w.alias("word_count"), s.alias("sentence_count"), F.round(avg, 1).alias("avg_words_per_sentence"),
            F.round(fk, 1).alias("flesch_kincaid_score"), grade.alias("readability_grade")]


def readability(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", *readability_columns(F.col(text_col)))


def readability_by_group(read: DataFrame, *group_cols: str) -> DataFrame:
    """Average and percentiles of the score per group, with rollup subtotals."""
    return read.rollup(*group_cols).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("flesch_kincaid_score"), 6).alias("avg_fk"),
        F.percentile("flesch_kincaid_score", 0.5).alias("median_fk"),
        F.round(F.avg("avg_words_per_sentence"), 6).alias("avg_wps"),
        F.min("flesch_kincaid_score").alias("min_fk"),
        F.max("flesch_kincaid_score").alias("max_fk"),
    )


def contact_columns(text: Column) -> list[Column]:
    text = T.col(text)
    low = F.lower(text)
    return [
        text.rlike(EMAIL).alias("has_email"),
        text.rlike(PHONE).alias("has_phone"),
        F.regexp_count(text, F.lit(DATE)).alias("n_dates"),
        low.contains("linkedin").alias("has_linkedin"),
        low.contains("github").alias("has_github"),
        F.array_contains(F.array(*[low.contains(w) for w in L.SOFTWARE_ROLE_WORDS]), True).alias("software_role"),
    ]


def contact_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", *contact_columns(F.col(text_col)))


def quantification_count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", T.quant_count(text_col).alias("quant_count"))


# ------------------------------------------------------------------ domain
def domain_inference(doc_terms: DataFrame, spark: SparkSession, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, domain, domain_score): best domain from technical skills; default when all zero.

    Weight per (skill, domain): 1 if the lower skill is a keyword, else 0.5 if a keyword longer
    than 3 chars is a substring of it.  The keyword dimension is tiny and broadcast.
    """
    tech = doc_terms.where(F.col("category") == "technical").select("doc_id", F.lower("canonical").alias("skill"))
    kw = dims.domains(spark)
    cand = tech.join(F.broadcast(kw), (F.col("skill") == F.col("keyword"))
                     | ((F.length("keyword") > 3) & F.col("skill").contains(F.col("keyword"))))
    w = cand.select("doc_id", "skill", "domain", "ord",
                    F.when(F.col("skill") == F.col("keyword"), 1.0).otherwise(0.5).alias("w"))
    per_skill = w.groupBy("doc_id", "skill", "domain", "ord").agg(F.max("w").alias("w"))
    per_domain = per_skill.groupBy("doc_id", "domain", "ord").agg(F.sum("w").alias("score"))
    best = per_domain.groupBy("doc_id").agg(
        F.min_by(F.struct("domain", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("b"))
    best = best.select("doc_id", F.col("b.domain").alias("domain"), F.col("b.score").alias("domain_score"))
    if docs is None:
        return best
    return docs.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.coalesce("domain", F.lit(L.DEFAULT_DOMAIN)).alias("domain"),
        F.coalesce("domain_score", F.lit(0.0)).alias("domain_score"))
