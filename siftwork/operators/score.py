"""Scoring: five dimensions, weighted composite, grade, ranking.

All dimension scores are Column arithmetic on per-document / per-pair rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbering import numbered


def _b(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def section_score() -> Column:
    """0.8 * required/3 + 0.2 * bonus/4 over has_<section> columns."""
    req = sum((_b(f"has_{s}") for s in L.REQUIRED_SECTIONS), F.lit(0))
    bonus = sum((_b(f"has_{s}") for s in L.BONUS_SECTIONS), F.lit(0))
    return F.lit(0.8) * (req / F.lit(len(L.REQUIRED_SECTIONS))) + F.lit(0.2) * (bonus / F.lit(len(L.BONUS_SECTIONS)))


def length_score(word_count: Column) -> Column:
    return (F.when(word_count < 150, 0.3).when(word_count < 300, 0.6).when(word_count <= 900, 1.0)
            .when(word_count <= 1200, 0.8).otherwise(0.6))


def content_strength(n_strong: Column, n_weak: Column, quant: Column, word_count: Column) -> Column:
    verb = F.least(F.lit(1.0), n_strong / F.lit(10.0))
    q = F.least(F.lit(1.0), quant / F.lit(10.0))
    weak_pen = F.least(F.lit(0.3), n_weak * F.lit(0.05))
    v = F.lit(0.35) * verb + F.lit(0.25) * q + F.lit(0.25) * length_score(word_count) - weak_pen
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def readability_score(fk_rounded: Column, avg_rounded: Column) -> Column:
    fk = (F.when((fk_rounded >= 50) & (fk_rounded <= 70), 1.0)
          .when(((fk_rounded >= 30) & (fk_rounded < 50)) | ((fk_rounded > 70) & (fk_rounded <= 80)), 0.75)
          .otherwise(0.5))
    ln = (F.when((avg_rounded >= 10) & (avg_rounded <= 20), 1.0)
          .when(((avg_rounded >= 8) & (avg_rounded < 10)) | ((avg_rounded > 20) & (avg_rounded <= 25)), 0.75)
          .otherwise(0.5))
    return F.lit(0.6) * fk + F.lit(0.4) * ln


def grade(score: Column) -> Column:
    return (F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 55, "Average")
            .when(score >= 40, "Below Average").otherwise("Poor"))


def composite(sem: Column, kw: Column, sec: Column, cs: Column, rd: Column) -> Column:
    """Weighted sum x 100, clamped and rounded to 1 (terms added in a fixed order)."""
    w = dict((k, v) for k, v, _ in L.DIMENSIONS)
    total = (sem * w["semantic_similarity"] + kw * w["keyword_coverage"] + sec * w["section_completeness"]
             + cs * w["content_strength"] + rd * w["readability"]) * 100
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)


def dimension_map(sem: Column, kw: Column, sec: Column, cs: Column, rd: Column) -> Column:
    names = [k for k, _, _ in L.DIMENSIONS]
    vals = [F.round(x * 100, 1) for x in (sem, kw, sec, cs, rd)]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*vals))


def rank_documents(scored: DataFrame, k: int, score_col: str = "final_score") -> DataFrame:
    """Top-k documents per target with rank and percent rank among that target's scored pairs.

    The rank filter is cut to k rows in every task before the shuffle, and the pairs of a target are only counted, so
    no task holds a target; the percent rank is (rank - 1) / (pairs - 1), 0 for a single pair."""
    w = Window.partitionBy("target_id").orderBy(F.col(score_col).desc(), F.col("doc_id").asc())
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _percent(best, scored)


def rank_all(scored: DataFrame, score_col: str = "final_score") -> DataFrame:
    """Every scored pair with its rank (score descending, then doc_id) and percent rank within its target; ranks are
    counted over ranges of the score, so a target may hold a third of all pairs."""
    ranked = numbered(scored, ["target_id"], [-F.col(score_col), F.col("doc_id")], "rank")
    return _percent(ranked, scored)


def _percent(ranked: DataFrame, scored: DataFrame) -> DataFrame:
    pairs = scored.groupBy(F.col("target_id").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(pairs, F.col("target_id").eqNullSafe(F.col("_t")))
    pct = F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return j.withColumn("pct_rank", F.round(pct, 6)).drop("_t", "_n")


def grade_histogram(scored: DataFrame) -> DataFrame:
    grades = ["Excellent", "Good", "Average", "Below Average", "Poor"]
    return scored.groupBy("target_id").pivot("grade", grades).count().na.fill(0, grades)
