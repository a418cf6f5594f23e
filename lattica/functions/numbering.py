"""Positions in a global order without one task for all rows: ranks within ranges, and where each range starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import checkpointed


def numbered(rows: DataFrame, keys: list[str], name: str = "pos", first: int = 1) -> DataFrame:
    """rows with their position by the key columns, ascending. The ranges are drawn once and kept, so they hold for both the
    ranks within them and their starts."""
    ranged = checkpointed(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range")  # a row for each range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", (F.sum("_rows").over(before) - F.col("_rows")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    placed = ranged.withColumn("_within", within).join(starts, "_range")
    return placed.withColumn(name, (F.col("_start") + F.col("_within") + (first - 1)).cast("int")).drop("_range", "_start", "_within")
