"""The per-document feature row shared by scoring, screening and feedback.

One projection over the document table (row-local, one stage): sections,
readability, counts, contact signals, bullet counts and the first bullets.
Lexicon-derived columns (verbs, skills) come from joins and are attached by
``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import extract as X
from ..operators import keywords as KW
from ..operators import rewrite as R


def doc_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    t = T.col(text_col)
    d = KW.with_weak_list(docs.select("doc_id", text_col), text_col)
    return d.select(
        "doc_id",
        *X.section_columns(t),
        *X.readability_columns(t),
        T.quant_count(t).alias("quant_count"),
        *X.contact_columns(t),
        X.bullet_line_count(t, X.FEEDBACK_BULLET).alias("feedback_bullets"),
        X.bullets_array(t).alias("bullets"),
        "weak_skills",
        F.when(F.length(t) > L.PREVIEW_CHARS, F.concat(F.substring(t, 1, L.PREVIEW_CHARS), F.lit("..."))).otherwise(t).alias("preview"),
    )


def with_verbs(feats: DataFrame, docs: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    v = X.verb_usage(docs, spark, text_col)
    out = feats.join(v, "doc_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("strong_verbs", F.coalesce("strong_verbs", empty)) \
        .withColumn("weak_verbs", F.coalesce("weak_verbs", empty)) \
        .withColumn("n_strong", F.coalesce("n_strong", F.lit(0))) \
        .withColumn("n_weak", F.coalesce("n_weak", F.lit(0)))


def with_skills(feats: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """Attach sorted technical skill names (the 'strong' list) per document."""
    tech = doc_terms.where(F.col("category") == "technical").groupBy("doc_id").agg(
        F.array_sort(F.collect_list("canonical")).alias("tech_skills"))
    return feats.join(tech, "doc_id", "left").withColumn(
        "tech_skills", F.coalesce("tech_skills", F.array().cast("array<string>")))


def with_skill_lists(feats: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """Attach a struct of sorted names by category."""
    names = lambda k: F.array_sort(F.collect_set(F.when(F.col("category") == k, F.col("canonical")))).alias(k)
    kinds = sorted({r[3] for r in L.lexicon_rows()})
    per = doc_terms.groupBy("doc_id").agg(*[names(k) for k in kinds])
    return feats.join(per.select("doc_id", F.struct(*kinds).alias("skills")), "doc_id", "left")


def with_project_strength(feats: DataFrame) -> DataFrame:
    return feats.select("*", *R.project_strength(F.col("bullets")))
