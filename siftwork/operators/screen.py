"""Rule-based screening over the corpus: top-third scan, parse issues, weak
sections, verdict, recommendations, rollup.

Rules are ordered arrays of ``when(condition, value)`` filtered for nulls, so
each document's issue lists are built inside one projection (no shuffle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import extract as X

SCAN_CONTACT = r"(?i)@|phone|mobile|\+\d{5,}"
SCAN_SUMMARY = r"(?i)summary|objective|profile|about"


def rule_array(*pairs: tuple[Column, Column | str]) -> Column:
    """Ordered list of the values whose condition holds."""
    vals = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    return F.filter(F.array(*vals), lambda x: x.isNotNull())


def screening_features(text: Column) -> list[Column]:
    """Per-document screening inputs (one projection); null is the empty text."""
    text = T.col(text)
    low = F.lower(text)
    n = F.length(text)
    third = F.substring(text, 1, F.floor(n / 3).cast("int"))
    first_line = F.regexp_extract(third, r"^[ \t\n\r\f\x0B]*([^\n]*)", 1)
    cols = [
        T.word_count(text).alias("ws_words"),
        third.rlike(SCAN_CONTACT).alias("scan_contact"),
        ((F.length(T.py_strip(first_line)) > 0) & (T.word_count(first_line) <= 5)).alias("scan_title"),
        third.rlike(SCAN_SUMMARY).alias("scan_summary"),
        X.bullet_line_count(text, X.SCREEN_BULLET).alias("screen_bullets"),
        T.quant_count(text).alias("quant_count"),
        text.rlike(X.YEAR).alias("has_year"),
    ]
    cols += [text.rlike(p).alias(f"parse_{k}") for k, p, _ in L.PARSE_RULES if p is not None]
    cols += [low.rlike(p).alias(f"sec_{k}") for k, p in L.SCREEN_SECTION_PATTERNS]
    return cols


def scan_result(df: DataFrame) -> DataFrame:
    m = L.SCAN_MESSAGES
    words = F.col("ws_words")
    issues = rule_array(
        (~F.col("scan_contact"), m["contact_bad"]),
        (~F.col("scan_title"), m["title_bad"]),
        (~F.col("scan_summary"), m["summary_bad"]),
        (words < 200, m["sparse"]),
        (words > 1200, m["long"]),
    )
    strengths = rule_array(
        (F.col("scan_contact"), m["contact_ok"]),
        (F.col("scan_title"), m["title_ok"]),
        (F.col("scan_summary"), m["summary_ok"]),
        ((words >= 200) & (words <= 1200),
         T.filled(m["length_ok"], words=words)),
    )
    return df.withColumn("scan_issues", issues).withColumn("scan_strengths", strengths) \
        .withColumn("scan_passed", F.size("scan_issues") == 0)


def parse_issues(df: DataFrame) -> DataFrame:
    msgs = {k: msg for k, _, msg in L.PARSE_RULES}
    pairs = [(F.col(f"parse_{k}"), msgs[k]) for k, p, _ in L.PARSE_RULES if p is not None]
    pairs += [(~F.col("has_year"), msgs["no_dates"]), (F.col("screen_bullets") < 3, msgs["few_bullets"])]
    return df.withColumn("parse_issues", rule_array(*pairs))


def weak_sections(df: DataFrame) -> DataFrame:
    r = {k: (sec, reason, sev) for k, sec, reason, sev in L.WEAK_SECTION_RULES}
    conds = {
        "no_contact": ~F.col("sec_contact"),
        "no_experience": ~F.col("sec_experience"),
        "few_exp_bullets": F.col("sec_experience") & (F.col("screen_bullets") < 4),
        "no_skills": ~F.col("sec_skills"),
        "no_education": ~F.col("sec_education"),
        "no_summary": ~F.col("sec_summary"),
        "few_numbers": F.col("quant_count") < 3,
    }
    items = [(conds[k], F.struct(F.lit(r[k][0]).alias("section"), F.lit(r[k][1]).alias("reason"),
                                 F.lit(r[k][2]).alias("severity")))
             for k, *_ in L.WEAK_SECTION_RULES]
    return df.withColumn("weak_sections", rule_array(*items))


def verdict_parts(df: DataFrame) -> DataFrame:
    """What the verdict needs of the document alone: its score before the density and the reasons before it."""
    m = L.VERDICT_MESSAGES
    crit = ["experience", "skills", "education", "contact"]
    missing = F.filter(F.array(*[F.when(~F.col(f"sec_{s}"), F.lit(s)) for s in crit]), lambda x: x.isNotNull())
    n_crit_weak = F.size(F.filter("weak_sections", lambda w: w["severity"] == "critical"))
    own = (F.lit(100) - F.size(missing) * 20 - F.size("parse_issues") * 8 - F.size("scan_issues") * 5 - n_crit_weak * 10)
    reasons = rule_array(
        (F.size(missing) > 0, T.filled(m["missing"], sections=F.array_join(missing, ", "))),
        (F.size("parse_issues") > 0, T.filled(m["parse"], n=F.size("parse_issues"))),
        (F.size("scan_issues") > 0, m["scan"]),
    )
    return df.withColumn("_own_score", own).withColumn("_reasons", reasons)


def verdict(df: DataFrame, density_col: str = "density_percent") -> DataFrame:
    """Score, verdict and ordered reasons.  A NULL density (no target) counts as ``NO_TARGET_DENSITY``."""
    m = L.VERDICT_MESSAGES
    df = df if "_reasons" in df.columns else verdict_parts(df)
    density = F.coalesce(F.col(density_col).cast("double"), F.lit(L.NO_TARGET_DENSITY))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("_own_score") - F.when(density < 30, 15).when(density < 50, 5).otherwise(0)))
    density_txt = F.regexp_replace(F.format_number(density, 1), ",", "")
    low = F.when(density < 30, F.array(T.filled(m["density"], density=density_txt))).otherwise(F.array().cast("array<string>"))
    v = F.when(score >= 70, "PASS").when(score >= 45, "CONDITIONAL").otherwise("FAIL")
    none = (F.size("_reasons") == 0) & ~(density < 30)
    tail = (F.when(score >= 70, F.when(none, F.array(F.lit(m["pass_default"]))).otherwise(F.array()))
            .when(score >= 45, F.array(F.lit(m["conditional"]))).otherwise(F.array(F.lit(m["fail"]))))
    return df.withColumn("ats_score", score).withColumn("verdict", v) \
        .withColumn("reasoning", F.concat("_reasons", low, tail.cast("array<string>"))).drop("_own_score", "_reasons")


def recommendations(df: DataFrame, missing_col: str = "top_missing_list") -> DataFrame:
    """All parse issues (high), critical weak sections, one missing-keyword line with all words (medium), high weak
    sections; nothing is cut. The missing words come as a list, or as ``top_missing`` with ", " between them."""
    def rec(priority, action):
        return F.struct(F.lit(priority).alias("priority"), action.alias("action"))
    parse = F.transform(F.col("parse_issues"), lambda x: rec("high", x))
    crit = F.transform(F.filter("weak_sections", lambda w: w["severity"] == "critical"),
                       lambda w: rec("critical", w["reason"]))
    words = F.coalesce(F.col("top_missing") if "top_missing" in df.columns else F.array_join(missing_col, ", "), F.lit(""))
    kw = F.when(words != "", F.array(rec("medium", T.filled(L.VERDICT_MESSAGES["missing_keywords"], words=words)))).otherwise(
        F.array().cast("array<struct<priority:string,action:string>>"))
    high = F.transform(F.filter("weak_sections", lambda w: w["severity"] == "high"), lambda w: rec("high", w["reason"]))
    return df.withColumn("recommendations", F.concat(parse, crit, kw, high))


def screen(docs: DataFrame, text_col: str = "text", density: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Full screening per document (and per target when ``density`` pairs are given, or a function that makes them from
    the documents' rows)."""
    base = docs.select("doc_id", *screening_features(F.col(text_col)))
    base = weak_sections(parse_issues(scan_result(base)))
    if callable(density):  # what depends on the document alone is made before its pairs
        base = density(verdict_parts(base).select("doc_id", "parse_issues", "scan_issues", "weak_sections", "_own_score", "_reasons"))
    elif density is not None:
        base = base.join(density, "doc_id")
    else:
        base = base.withColumn("density_percent", F.lit(None).cast("double")) \
            .withColumn("top_missing_list", F.lit(None).cast("array<string>"))
    if callable(density) and "top_missing" not in base.columns:
        return verdict(base)
    return recommendations(verdict(base))


def verdict_rollup(screened: DataFrame, *dims_cols: str) -> DataFrame:
    """Verdict counts with issue averages over all combinations of the given columns (cube)."""
    return screened.cube(*dims_cols).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("parse_issues")).alias("n_parse_issues"),
        F.sum(F.size("scan_issues")).alias("n_scan_issues"),
        F.sum(F.size("weak_sections")).alias("n_weak_sections"),
    )
