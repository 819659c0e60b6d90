"""Global order without a single task: range partitions, each counted, then numbered from its offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name`` = 1.. in the given total order. The sorted ranges are checkpointed, so that the two
    passes (count, number) see the same partitions even if an executor is lost in between."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + row + 1).drop("_id", "_part", "_start")
