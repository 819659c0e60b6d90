"""Process monitor: every process ever seen at every tick, last known values, zeros once it is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


METRICS = ("memory", "cpu", "cpu_time", "virtual")


def _clean(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("tick").isNotNull() & F.col("pid").isNotNull()).groupBy("tick", "pid").agg(*[F.max(c).alias(c) for c in METRICS])


def process_samples(samples: DataFrame) -> DataFrame:
    """samples (tick LONG, pid LONG, memory, cpu, cpu_time, virtual) -> one row per pid and tick since it first appeared.

    Gone processes have zero metrics but keep cpu_time. Repeated samples of a tick: the largest values count.
    The run's ticks are one sorted array, that every pid unfolds; a pid's rows number at most
    the ticks, so the window per pid is bounded by the run's length."""
    s = _clean(samples)
    ticks = s.agg(F.array_sort(F.collect_set("tick"))).scalar()
    grid = s.groupBy("pid").agg(F.min("tick").alias("born")).select("pid", "born", F.explode(ticks).alias("tick")).where("tick >= born").drop("born")
    w = Window.partitionBy("pid").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    j = grid.join(s, ["pid", "tick"], "left").withColumn("alive", F.col("memory").isNotNull())
    zero = lambda c: F.when(F.col("alive"), F.col(c)).otherwise(0)
    return j.select("tick", "pid", zero("memory").alias("memory"), zero("cpu").alias("cpu"), F.last("cpu_time", True).over(w).alias("cpu_time"), F.col("alive").alias("was_in_time"), zero("virtual").alias("virtual_memory"))


def process_totals(samples: DataFrame) -> DataFrame:
    """Per tick: totals of the sampled processes, processes seen so far (``pids``) and those sampled now.

    The totals need no row for a process that is gone: they add up the samples, and the processes seen are a running
    count of first ticks over one row per tick."""
    s = _clean(samples)
    births = s.groupBy("pid").agg(F.min("tick").alias("tick")).groupBy("tick").agg(F.count("*").alias("_new"))
    live = F.col("memory").isNotNull()
    sums = s.groupBy("tick").agg(*[F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)).alias(n) for c, n in (("memory", "memory"), ("virtual", "virtual_memory"), ("cpu", "cpu"))], F.count_if(live).alias("alive"))
    so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return sums.join(births, "tick", "left").select("tick", "memory", "virtual_memory", "cpu", F.sum(F.coalesce("_new", F.lit(0))).over(so_far).alias("pids"), "alive")


def tick_rows(rows: DataFrame) -> DataFrame:
    """The monitor's text rows, one per tick and process: ``tick;pid;memory;cpu;cpu_time;virtual``."""
    return rows.select(F.concat_ws(";", *[F.col(c).cast("string") for c in ("tick", "pid", "memory", "cpu", "cpu_time", "virtual_memory")]).alias("value"))
