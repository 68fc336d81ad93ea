"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: One run of the white space that separates words, as a Java and Python regular expression.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(docs: DataFrame) -> Column:
    """The text, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is made once: as the output of a generator it is not put into the expressions that use
    it, as Catalyst does with plain projections below a filter. Lambdas look into such arrays without making them anew."""
    return df.withColumn(name, F.explode(F.array(value)))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with all its columns in one, ``row``, beside ``columns``: whatever their names, they can't clash."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(whole, *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage: a reliable checkpoint in the shared folder of the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks that it runs one after another."""
    home = sys.modules.setdefault("_siftwork_worker", types.ModuleType("_siftwork_worker"))
    return home.__dict__.setdefault(name, {})


def forget_worker_caches() -> None:
    """Frees what operators before have left in this Python worker, as workers are used again by later stages."""
    home = sys.modules.get("_siftwork_worker")
    for kept in list(vars(home).values()) if home else []:
        if isinstance(kept, dict):
            kept.clear()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps; every step is a min per node and an equi-join on the node, so
    only (node, node) rows move and hub nodes are pre-aggregated or split as skewed join keys.
    Each round is checkpointed; the loop ends when a round changes nothing. Nodes without an edge are absent,
    null ends are ignored, an empty input gives an empty result.
    """
    def key(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now = key(e)
    while now[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, key(e)
        if before == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
