"""Catch logs as folders of text: <root>/maps/<map>/<point>/..., written by map and point, read with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catches import file_time

COLUMNS = "name string, test string, timestamp string, mass bigint, long bigint, exp bigint, exp_l bigint, exp_happy bigint, exp_prem bigint, exp_sum bigint, exp_drink bigint, device string, exp_real bigint"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def write_maps(df: DataFrame, root: str, mode: str = "append") -> None:
    """One folder per map and point; ``timestamp`` is text yyyyMMdd_HHmmss. A writer per map and point would make as many
    files as tasks, so rows are gathered by both first."""
    df.repartition("map", "point").select(*NAMES, "map", "point").write.mode(mode).partitionBy("map", "point").option("sep", ";").option("header", True).csv(f"{root}/maps")


def read_maps(spark: SparkSession, root: str, maps: list[str] | None = None, since: int | None = None) -> DataFrame:
    """All point files of all or the listed maps as one log; catches before ``since`` (ms, inclusive bound) are left out.

    The maps are a partition filter: folders of other maps are not opened."""
    r = spark.read.csv(f"{root}/maps", sep=";", header=True, schema=COLUMNS + ", map string, point string")
    if maps is not None:
        r = r.where(F.col("map").isin(*maps))
    r = r.withColumn("at", file_time(F.col("timestamp")))
    return r if since is None else r.where(F.col("at") >= since)


def ingest(df: DataFrame, stats: DataFrame, root: str) -> DataFrame:
    """Appends a batch to the log and returns the statistics (name, mass, total, n) refreshed by it, in one pass over the batch."""
    from tidemark.operators.catches import bucket_stats, merge_stats

    write_maps(df, root)
    return merge_stats(stats, bucket_stats(df, "name", "mass", "exp_sum"))
