"""Composed plans: per-document dimension scores, pair scoring, and the nested
analysis report (the flagship).

Shuffle map of ``score_pairs``: lexicon hits and TF-IDF grams shuffle by
(doc, term) after map-side partial aggregation; what the pairs need is one row
per document and one per target, joined by id to the assigned pairs. Text is
projected once and is not carried through any shuffle except the final report join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import advise as A
from ..operators import extract as X
from ..operators import keywords as KW
from ..operators import match as M
from ..operators import score as SC
from ..session import materialise
from . import features as FE


def doc_dimensions(docs: DataFrame, spark: SparkSession, text_col: str = "text") -> DataFrame:
    """Per document: feature row + verbs + the three document-only dimension scores."""
    feats = FE.with_verbs(FE.doc_features(docs, text_col), docs, spark, text_col)
    return feats.select(
        "*",
        SC.section_score().alias("section_completeness"),
        SC.content_strength(F.col("n_strong"), F.col("n_weak"), F.col("quant_count"), F.col("word_count"))
        .alias("content_strength"),
        SC.readability_score(F.col("flesch_kincaid_score"), F.col("avg_words_per_sentence")).alias("readability_score"),
    )


def all_terms(docs: DataFrame, spark: SparkSession, text_col: str = "text", phrases: bool = True) -> DataFrame:
    """(doc_id, category, canonical): lexicon terms and, if ``phrases``, the repeated phrases as technical terms."""
    terms = X.lexicon_match(docs, spark, text_col)
    if not phrases:
        return terms
    terms = materialise(terms)  # read twice
    more = KW.repeated_phrases(docs, terms, spark, text_col)
    return terms.unionByName(more.select("doc_id", F.lit("technical").alias("category"), "canonical")).distinct()


def target_terms(targets: DataFrame, spark: SparkSession, text_col: str = "text", phrases: bool = True) -> DataFrame:
    named = targets.select(F.col("target_id").alias("doc_id"), text_col)
    return all_terms(named, spark, text_col, phrases).withColumnRenamed("doc_id", "target_id")


def score_pairs(docs: DataFrame, targets: DataFrame, spark: SparkSession, pairs: DataFrame,
                vectors: DataFrame | None = None, text_col: str = "text", phrases: bool = True, every: bool = False) -> DataFrame:
    """Composite score of every pair of the assignment; without a target the neutral similarity and coverage stand.
    ``every``: the pairs are nearly all of documents and targets (see ``tfidf_pair_similarity``).

    The terms of both sides are used several times, so they are materialised once."""
    dterms = materialise(all_terms(docs, spark, text_col, phrases))
    tterms = materialise(target_terms(targets, spark, text_col, phrases))
    cov = M.keyword_coverage(dterms, tterms, docs, pairs, text_col)
    tf = M.tfidf_pair_similarity(M.tfidf_terms(docs, "doc_id", spark, text_col),
                                 M.tfidf_terms(targets, "target_id", spark, text_col), pairs, every)
    scored = cov.join(tf, (cov.doc_id == tf.doc_id) & cov.target_id.eqNullSafe(tf.target_id), "left").drop(tf.doc_id).drop(tf.target_id)
    if vectors is not None:
        scored = M.embedding_similarity(scored, vectors)
    else:
        scored = scored.withColumn("semantic_similarity", F.lit(0.0))
    dd = FE.with_skill_lists(FE.with_skills(doc_dimensions(docs, spark, text_col), dterms), dterms)
    j = scored.join(dd, "doc_id")
    sem = M.blended_similarity(F.col("semantic_similarity"), F.col("tfidf_similarity"), F.col("target_id").isNotNull())
    j = j.withColumn("blended_similarity", sem)
    dims5 = [F.col("blended_similarity"), F.col("keyword_coverage"), F.col("section_completeness"),
             F.col("content_strength"), F.col("readability_score")]
    final = SC.composite(*dims5)
    return j.withColumn("final_score", final).withColumn("grade", SC.grade(F.col("final_score"))) \
        .withColumn("dimension_scores", SC.dimension_map(*dims5))


def analysis_report(docs: DataFrame, targets: DataFrame, spark: SparkSession, pairs: DataFrame,
                    vectors: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """One nested row per assigned (document, target) pair: preview, extracted facts, scores, coverage and feedback."""
    scored = score_pairs(docs, targets, spark, pairs, vectors, text_col)
    dims = [F.element_at("dimension_scores", k) for k, _, _ in L.DIMENSIONS]
    sections = A.missing_section_advice()
    content = A.content_advice(F.col("quant_count"), F.col("word_count"), F.size("tech_skills"), F.col("has_email"),
                               F.col("has_phone"))
    structure = A.structure_advice(F.col("n_dates"), F.col("has_linkedin"), F.col("has_github"),
                                   F.col("software_role"), F.col("feedback_bullets"))
    avg, fk = F.col("avg_words_per_sentence"), F.col("flesch_kincaid_score")
    kw = A.keyword_suggestions(F.col("missing"))
    top = A.top_suggestions(sections, content, kw, F.col("n_strong"), structure)
    kw_score = F.element_at("dimension_scores", "keyword_coverage")
    flagged = F.col("target_id").isNotNull()
    none = F.array().cast("array<string>")
    out = scored.select(
        "doc_id", "target_id", "final_score", "grade", "dimension_scores", "preview", "skills", "tech_skills", "bullets",
        F.struct("total_keywords", "matched_count", "missing_count", "coverage_ratio", "matched", "missing")
        .alias("keyword_detail"),
        F.struct("word_count", "sentence_count", "avg_words_per_sentence", "flesch_kincaid_score",
                 "readability_grade").alias("readability"),
        F.struct("strong_verbs", "weak_verbs").alias("verbs"),
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in L.SECTION_PATTERNS]), F.array(*[F.col(f"has_{k}") for k, _ in L.SECTION_PATTERNS])).alias("sections"),
        F.transform("bullets", lambda b: F.struct(b.alias("original"), FE.R.rewrite_line(b).alias("improved"), FE.R.bullet_issues(b).alias("issues"),
                                                  FE.R.bullet_suggestions(b).alias("suggestions"), FE.R.has_quantification(b).alias("has_quantification"),
                                                  FE.R.has_strong_verb(b).alias("has_strong_verb"))).alias("bullet_analysis"),
        *FE.R.project_strength(F.col("bullets")),
        A.overall_summary(F.col("final_score"), F.col("grade"), dims).alias("overall_summary"),
        sections.alias("missing_sections"),
        F.struct(F.col("n_strong").alias("action_verb_count"), A.verb_strength(F.col("n_strong")).alias("verb_strength"),
                 A.verb_upgrade_advice(F.col("weak_verbs"), F.coalesce("weak_skills", none)).alias("upgrade_suggestions"),
                 A.verb_tip(F.col("n_strong")).alias("tip")).alias("action_verb_feedback"),
        F.struct(F.when(~flagged, F.lit(L.KEYWORD_MESSAGES["no_target"])).alias("note"), F.when(flagged, kw_score).alias("keyword_score"),
                 kw.alias("suggestions"), A.keyword_examples(F.col("missing")).alias("actionable_suggestions"),
                 F.when(flagged, A.keyword_tip(kw_score)).alias("tip")).alias("keyword_feedback"),
        content.alias("content_feedback"),
        F.struct(A.readability_tips(avg, fk).alias("tips"), A.readability_fixes(avg, fk).alias("actionable_fixes")).alias("readability_feedback"),
        structure.alias("structure_feedback"), top.alias("top_suggestions"),
    )
    per_doc = KW.with_keywords(docs.select("doc_id", text_col), text_col).select("doc_id", "keywords", X.sentences_array(F.col(text_col)).alias("sentences"))
    per_doc = per_doc.join(X.gazetteer_entities(docs, spark, text_col), "doc_id", "left")
    return out.join(per_doc, "doc_id")
