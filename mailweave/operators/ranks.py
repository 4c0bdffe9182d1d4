"""Places of rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed


def with_rank(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """The rows with their place in the order, from 1; the order should leave no ties."""
    # the high bits of a row's number are its range of the sort, the low 33 its place there
    placed = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_before", "_at")
