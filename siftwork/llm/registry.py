"""Queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, clusters, contamination, conversations, exact_dedup, language, licenses, lines, mix, secrets, simhash, spotsigs, substrings
from .common import documents, table

EXACT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select distinct doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256
from d join g using (t)
"""

QUERIES = {
    "op1_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)),
    "op2_simhash_dedup": lambda spark, d: simhash.simhash_dedup(documents(spark, d), shingle_words=4, max_distance=4),
    "op3_substring_dedup": lambda spark, d: substrings.substring_dedup(documents(spark, d), window=20),
    "op4_bpe": lambda spark, d: bpe.encode_decode(documents(spark, d)),
    "op5_line_dedup": lambda spark, d: lines.line_dedup_by_document(documents(spark, d)),
    "op6_secrets": lambda spark, d: secrets.find_secrets(documents(spark, d)).drop("found"),
    "op7_mix": lambda spark, d: mix.mix(documents(spark, d)),
    "op8_spotsigs": lambda spark, d: spotsigs.edited_fingerprints(documents(spark, d)),
    "op9_licenses": lambda spark, d: licenses.license_scan(documents(spark, d)),
    "op10_language": lambda spark, d: language.identify(documents(spark, d)),
    "op11_clusters": lambda spark, d: clusters.centroid_clusters(table(spark, d, "embeddings")).drop("v", "scans"),
    "op12_contamination": lambda spark, d: contamination.decontaminated_by_document(documents(spark, d), table(spark, d, "benchmark")),
    "op13_conversations": lambda spark, d: conversations.repair_damaged(table(spark, d, "conversations")),
    "pipeline": corpus_pipeline.run,
}

ORACLE = {"op1_exact_dedup": EXACT_SQL, "op7_mix": mix.MIX_SQL, "op11_clusters": clusters.clusters_sql(),
          "op12_contamination": contamination.contamination_sql()}
