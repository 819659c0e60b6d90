"""Sinks: snapshots, legacy text rows, change logs, partitioned appends, day upserts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kv_text(columns: list[str], flags: tuple[str, ...] = ()) -> Column:
    """``k:v,k:v`` text of a row; nulls are left out and flags appear as ``name:1`` only when true."""
    plain = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws(",", *plain, *[F.when(F.col(f), F.lit(f"{f}:1")) for f in flags])


def write_snapshot(df: DataFrame, path: str) -> None:
    """Overwrites one snapshot; readers of the old files finish, as the format is immutable per file."""
    df.write.mode("overwrite").parquet(path)


def write_kv(df: DataFrame, columns: list[str], path: str, flags: tuple[str, ...] = ()) -> None:
    df.select(kv_text(columns, flags).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """';'-separated with header; NaN and null become empty."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode(mode).option("header", True).option("sep", ";").csv(path)


def change_log(df: DataFrame, opponents: str) -> DataFrame:
    """Change rows with the opponents' (kind, rating) array as JSON text."""
    return df.withColumn(opponents, F.to_json(opponents))


def route(df: DataFrame, column: str, path: str) -> None:
    """One folder per value of ``column``: the change router and the per-species, per-point, per-test logs."""
    df.write.mode("append").partitionBy(column).parquet(path)


def add_catches(df: DataFrame, root: str) -> None:
    """Three appends of one cached batch: by species, by (map, point), by test."""
    batch = df.persist()
    batch.write.mode("append").partitionBy("name").parquet(f"{root}/fishes")
    batch.write.mode("append").partitionBy("map_name", "point").parquet(f"{root}/maps")
    batch.write.mode("append").partitionBy("test").parquet(f"{root}/tests")
    batch.unpersist()


def upsert_days(df: DataFrame, day: str, path: str) -> None:
    """Replaces the days that occur in ``df`` and keeps all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def bucket_json(stats: DataFrame) -> DataFrame:
    """(group, json) of exact-key statistics: key -> [total, n]."""
    g = [c for c in stats.columns if c not in ("key", "total", "n")]
    entry = F.struct(F.col("key").cast("string"), F.array("total", "n"))
    return stats.groupBy(*g).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def plot_rows(members: DataFrame, cluster: str, n: int = 10, seed: int = 0) -> DataFrame:
    """At most ``n`` drawn members per cluster, as a plot would show them."""
    from pyspark.sql import Window

    w = Window.partitionBy(cluster).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def write_config(config: dict, path: str) -> None:
    Path(path).write_text(json.dumps(config, indent=2, ensure_ascii=False))


def to_ron(v) -> str:
    """RON text of dicts (named structs), tuples (name, args) as enums, lists, texts, numbers and booleans; ``parse_ron`` reads it."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        return "(" + ", ".join(f"{k}: {to_ron(x)}" for k, x in v.items()) + ")"
    if isinstance(v, tuple):
        return f"{v[0]}({', '.join(to_ron(x) for x in v[1])})"
    if isinstance(v, list):
        return "[" + ", ".join(to_ron(x) for x in v) + "]"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else repr(v)


def write_duties(duties: DataFrame, path: str) -> None:
    """Duties of a roster as RON text, one line per duty, one folder per day."""
    part = lambda n, c: F.concat(F.lit(f"{n}: "), c)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.concat(F.lit("("), F.concat_ws(", ", part("depot", quoted("depot")), part("train", F.col("train").cast("string")), part("seq", F.col("seq").cast("string")), part("kind", quoted("kind")), part("shift", F.coalesce(F.col("shift_id").cast("string"), F.lit("-1")))), F.lit(")"))
    duties.select("day", line.alias("value")).repartition("day").sortWithinPartitions("day", "value").write.mode("overwrite").partitionBy("day").text(path)


def result_rows(df: DataFrame, columns: str) -> DataFrame:
    """A table in the columns of a DDL schema: missing ones null, others left out (the 20-column result format)."""
    names = [c.strip().split() for c in columns.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])
