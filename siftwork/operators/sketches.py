"""Group figures kept up to date: parts that are stored per group and merged over grouping sets.

A part is one row per finest group of one load (a day, a source): counts, sums and sketches. Figures of any coarser
group, and of all loads, come from the parts alone; so a new load costs its own documents and as many rows as it has
groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches (rank error about 2.3 / K ** 0.9) and log2 of the registers of the distinct counts
#: (relative error about 1.04 / sqrt(2 ** LG)).
K, LG = 400, 12


def readability_parts(read: DataFrame, *by: str) -> DataFrame:
    """One row per group of ``by``: n, sums, extremes and a quantile sketch of the readability score."""
    s = F.col("flesch_kincaid_score")
    return read.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(s.cast("decimal(18,1)")).alias("total"), F.min(s).alias("low"),
                                 F.max(s).alias("high"), F.kll_sketch_agg_double(s, F.lit(K)).alias("sketch"))


def merged_readability(parts: DataFrame, *by: str) -> DataFrame:
    """n_docs, avg_fk, median_fk, min_fk, max_fk of every rollup group; all exact but the median, whose rank is off by
    the sketch's error."""
    g = parts.rollup(*by).agg(F.sum("n").alias("n_docs"), F.sum("total").alias("_t"), F.min("low").alias("min_fk"),
                              F.max("high").alias("max_fk"), F.kll_merge_agg_double("sketch").alias("_s"))
    return g.select(*by, "n_docs", (F.col("_t").cast("double") / F.col("n_docs")).alias("avg_fk"),
                    F.kll_sketch_get_quantile_double("_s", F.lit(0.5)).alias("median_fk"), "min_fk", "max_fk")


def verdict_parts(screened: DataFrame, *by: str) -> DataFrame:
    """One row per group of ``by``: pairs, issues, and a sketch of the distinct documents."""
    return screened.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.size("parse_issues")).alias("n_parse_issues"),
        F.sum(F.size("scan_issues")).alias("n_scan_issues"), F.sum(F.size("weak_sections")).alias("n_weak_sections"),
        F.hll_sketch_agg("doc_id", F.lit(LG)).alias("sketch"))


def merged_verdicts(parts: DataFrame, *by: str) -> DataFrame:
    """The cube over ``by``: sums, exact, and docs_estimate, the number of distinct documents within the sketch's error."""
    names = ["n_pairs", "n_parse_issues", "n_scan_issues", "n_weak_sections"]
    g = parts.cube(*by).agg(*[F.sum(c).alias(c) for c in names], F.hll_union_agg("sketch").alias("_s"))
    return g.select(*by, *names, F.hll_sketch_estimate("_s").alias("docs_estimate"))
