"""Ranks and running totals over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.cluster import cut


def running(df: DataFrame, order: list[Column], totals: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows up to and including this one, in the given order.

    With ``by``, totals run within its values.  The rows are dealt by range of (by, order), each range is
    summed alone, and the totals of the ranges before it are added: one row a range is all that is gathered."""
    by = by or []
    dealt = df.withColumns({f"__v_{n}": c for n, c in totals.items()})
    dealt = cut(dealt.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    local = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__range", *by).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    ahead = sums.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__b_{c}") for c in by], *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals])
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    out = dealt.join(ahead, same)
    return out.select(*df.columns, *[(F.sum(f"__v_{n}").over(local) + F.col(f"__o_{n}")).alias(n) for n in totals])


def row_numbers(df: DataFrame, order: list[Column], name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Adds each row's place, from 1, in the given order (which should have no ties)."""
    return running(df, order, {name: F.lit(1).cast("long")}, by)
