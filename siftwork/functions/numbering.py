"""Consecutive numbers within groups, whatever a group's size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the place of each row (from 1) within its group ``by`` in the total order ``order``, in column ``out``.

    A window over the group alone would sort a group of a third of all rows in one task. Here rows are dealt to ranges
    of (group, order), so a large group lies in many partitions; they are numbered within their part, and the rows of a
    group's earlier parts, counted first, are added. Null groups are a group. The dealt rows are materialised, since
    their parts must not change between the two uses.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    ordered = df.select("*", *keys)
    names = [f"_o{i}" for i in range(len(order))]
    dealt = materialise(ordered.repartitionByRange(parts, *by, *names).withColumn("_part", F.spark_partition_id()))
    group = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))  # a row for each group and part
    counts = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_before")
    same = reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(counts[f"_g_{c}"]) for c in group])
    within = F.row_number().over(Window.partitionBy(*group).orderBy(*names))
    placed = dealt.withColumn("_at", within).join(counts, same)
    return placed.withColumn(out, (F.col("_at") + F.col("_before")).cast("long")).select(*df.columns, out)
