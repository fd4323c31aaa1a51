"""Orders of whole tables without a task that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.sources.shared import stored


def ranked(df: DataFrame, keys: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with name: each row's place, from 1, in the order of keys, which tell all rows apart.

    Rows are dealt by ranges of the keys and written; a range's first place is the sum of the sizes of those before it, one number
    for each range."""
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + F.col("_before")
    # as many rows as ranges, so a broadcast is bounded by the number of shuffle partitions
    return rows.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")


def earliest(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group in an order that has no ties; tasks drop the others before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
