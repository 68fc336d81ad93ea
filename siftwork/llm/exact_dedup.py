"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, cut, packed, text_of, unpacked


def normalised(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), WS, " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of white space become one space; of equal texts the smallest
    doc_id stays. The hash only routes: rows are grouped by (hash, text), which compares whole texts, so a
    collision gives two groups. Copies collapse before the shuffle, so each distinct text moves once per task.
    Rows then find their group by the hash alone; only a hash that holds two different texts (``variants``)
    is matched by text again. ``hashed`` can be replaced, as tests do to force collisions.

    Null text counts as empty, and empty texts form one group. Rows that repeat a doc_id with an equal text are
    one document (one result row) but count in group_size; a doc_id with two texts is two documents. A null
    doc_id is kept only if its group has no other id. No rows give no rows; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id"), normalised(docs).alias("t")).withColumn("h", hashed(F.col("t")))
    classes = keyed.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(classes.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.min("keep_id").alias("keep_id"),
                                          F.max("group_size").alias("group_size")))
    sha = F.sha2(F.col("t"), 256).alias("text_sha256")
    rows = keyed.select("doc_id", "h", sha).distinct()
    out = rows.join(groups.where("variants = 1"), "h")
    clash = groups.where("variants > 1").select("h")
    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    out = out.select(*names)
    if not clash.isEmpty():
        again = keyed.join(clash, "h")
        again = again.join(classes.join(clash, "h", "left_semi"), ["h", "t"])
        out = out.union(again.select("doc_id", "keep_id", "group_size", sha).distinct())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, one per group, with all their columns; the columns may have any
    names. Of rows that repeat the kept id with an equal text, any one stays."""
    def key(i, sha):
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), sha)

    kept = exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    rows = packed(docs, key=key(docs["doc_id"], F.sha2(normalised(docs), 256))).join(kept, "key", "left_semi")
    # repeated rows: one of them; the join's partitioning and order serve the window as they are
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return unpacked(rows.withColumn("n", first).where("n = 1"))
