"""As-of lookups as plans: union and running maximum inside time chunks, or a lag over a compact key table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPAN = 4096


def before_max(chunks: DataFrame, chunk: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the largest ``value`` of all earlier chunks. chunks has one row per (integer) chunk.

    Two levels: inside spans of chunks, and over one row per span, which alone stand in one order."""
    c = chunks.withColumn("_s", F.floor(F.col(chunk) / SPAN))
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    spans = c.groupBy("_s").agg(F.max(value).alias("_m")).select("_s", F.max("_m").over(earlier).alias("_far"))
    near = F.max(value).over(Window.partitionBy("_s").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("_near", near).join(spans, "_s").withColumn(out, F.greatest("_near", "_far")).drop("_s", "_near", "_far")


def before_last(chunks: DataFrame, chunk: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the ``value`` of the chunk before, in the same two levels; values are not null."""
    c = chunks.withColumn("_s", F.floor(F.col(chunk) / SPAN))
    spans = c.groupBy("_s").agg(F.max_by(value, chunk).alias("_m")).select("_s", F.lag("_m").over(Window.orderBy("_s")).alias("_far"))
    near = F.lag(value).over(Window.partitionBy("_s").orderBy(chunk))
    return c.withColumn("_near", near).join(spans, "_s").withColumn(out, F.coalesce("_near", "_far")).drop("_s", "_near", "_far")


def last_before(probes: DataFrame, probe_at: str, events: DataFrame, event_at: str, value: str, default: Column, chunk: int = 3_600_000) -> DataFrame:
    """Probes with ``value`` of the last event strictly before their time (ties: the larger value), else default.

    Times are integers. Work is split by time chunk; what earlier chunks leave behind is one row per chunk,
    so neither side gathers in one task."""
    e = events.where(F.col(event_at).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(event_at).alias("t")).agg(F.max(value).alias("v"))
    e = e.withColumn("c", F.floor(F.col("t") / chunk))
    p = probes.withColumn("c", F.floor(F.col(probe_at) / chunk))
    ends = e.groupBy("c").agg(F.max(F.struct("t", "v")).alias("m"))
    chunks = p.select("c").distinct().withColumn("m", F.lit(None).cast(ends.schema["m"].dataType)).unionByName(ends).groupBy("c").agg(F.max("m").alias("m"))
    carry = before_max(chunks, "c", "m", "carry").select("c", "carry")
    both = p.select(F.struct(*p.columns).alias("p"), F.col(probe_at).alias("t"), "c", F.lit(0).alias("o"), F.lit(None).cast(ends.schema["m"].dataType).alias("e")).unionByName(
        e.select(F.lit(None).cast(p.select(F.struct(*p.columns)).schema[0].dataType).alias("p"), "t", "c", F.lit(1).alias("o"), F.struct("t", "v").alias("e")))
    inside = Window.partitionBy("c").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("e", F.max("e").over(inside)).where(F.col("p").isNotNull()).join(carry, "c", "left")
    return seen.select("p.*", F.coalesce("e.v", "carry.v", default).alias(value)).drop("c")


def two_before(asked: DataFrame, key: str, at: str, table: DataFrame, table_key: str, table_at: str, value: str) -> DataFrame:
    """Distinct (key, at) of ``asked`` with the largest table key <= at and the one below it.

    Columns k0, v0, k1, v1; null where there is none. The table and the distinct probes are both compact (one
    row per key and distinct value), so the window runs over those, not over the rows."""
    t = table.select(F.col(table_key).alias("g"), F.col(table_at).alias("t"), F.col(value).alias("v"))
    w = Window.partitionBy("g").orderBy("t")
    t = t.select("g", "t", F.struct(F.col("t").alias("k0"), F.col("v").alias("v0"), F.lag("t").over(w).alias("k1"), F.lag("v").over(w).alias("v1")).alias("s"))
    p = asked.select(F.col(key).alias("g"), F.col(at).alias("t")).where(F.col("t").isNotNull() & F.col("g").isNotNull()).distinct()
    both = p.select("g", "t", F.lit(1).alias("o"), F.lit(None).cast(t.schema["s"].dataType).alias("s")).unionByName(t.select("g", "t", F.lit(0).alias("o"), "s"))
    run = Window.partitionBy("g").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("s", F.last("s", True).over(run)).where("o = 1").select(F.col("g").alias(key), F.col("t").alias(at), "s.*")


def first_within(probes: DataFrame, probe_at: str, events: DataFrame, event_at: str, limit: int, keys: list[str]) -> DataFrame:
    """Probes with ``next_at``: the earliest event of equal keys in [at, at + limit]; an interval join by buckets."""
    w = limit + 1
    e = events.select(*keys, F.col(event_at).alias("_t"), F.floor(F.col(event_at) / w).alias("_b"))
    p = probes.withColumn("_b", F.explode(F.array(F.floor(F.col(probe_at) / w), F.floor(F.col(probe_at) / w) + 1)))
    near = p.join(e, [*keys, "_b"]).where((F.col("_t") >= F.col(probe_at)) & (F.col("_t") <= F.col(probe_at) + limit))
    best = near.groupBy(*probes.columns).agg(F.min("_t").alias("next_at"))
    return probes.join(best, probes.columns, "left")
