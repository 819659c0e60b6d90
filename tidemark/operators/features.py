"""Per-entity feature table: counts, recency and totals for each of an explicit list of event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_long(events: DataFrame, entity: str, kind: str, at: str, totals: dict[str, Column], now: Column | int) -> DataFrame:
    """The compact long table: one row per (entity, kind) with battles, since and one sum per total.

    Partial aggregation runs before the only shuffle, so an entity that fills a third of all rows sends
    one row per kind and input task. ``since`` is now minus the last non-null time. Null totals count as 0.
    """
    now = F.lit(now) if isinstance(now, int) else now
    return events.groupBy(entity, kind).agg(
        F.count("*").alias("battles"),
        (now - F.max(at)).alias("since"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in totals.items()],
    )


def column_name(kind: str, metric: str) -> str:
    return f"{kind}_{metric}"


def numbered(rows: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """``kind`` replaced by its place in the explicit list; unlisted and null kinds become -1. The list is an argument, so it is small."""
    if len(set(kinds)) != len(kinds):
        raise ValueError("kinds repeat")
    listed = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kinds)], f"`{kind}` string, _place int")
    return rows.join(F.broadcast(listed), kind, "left").withColumn(kind, F.coalesce("_place", F.lit(-1))).drop("_place")


def feature_table(long: DataFrame, entity: str, kind: str, kinds: list[str], metrics: list[str], recency: str = "since") -> DataFrame:
    """One row per entity; for each kind of ``kinds`` the columns <kind>_<metric>.

    ``kind`` holds names, or already their places in the list (see ``numbered``). The long table is partitioned by
    entity once; the pivot over the explicit list then runs inside the partitions, one array slot per long row (no
    search for distinct kinds, no second exchange). Absent kinds give 0, and null for the recency. Entities whose
    events are all of unlisted or null kind keep a row of zeros; a null entity is no entity and is left out. Kinds
    and metrics name the columns, so they must not repeat. For lists that no table can have as columns
    there are ``feature_tables`` and ``feature_maps``.
    """
    if long.schema[kind].dataType.simpleString() == "string":
        long = numbered(long, kind, kinds)
    elif len(set(kinds)) != len(kinds):
        raise ValueError("kinds repeat")
    slim = long.where(F.col(entity).isNotNull()).select(F.col(entity), F.col(kind).alias("_kind"), *metrics).repartition(F.col(entity))
    wide = slim.groupBy(entity).pivot("_kind", list(range(len(kinds))) or [0]).agg(*[F.first(m).alias(m) for m in metrics])
    named = (lambda i, m: f"{i}_{m}") if len(metrics) > 1 else (lambda i, m: str(i))  # as pivot names them
    return wide.select(
        F.col(entity),
        *[
            (F.col(named(i, m)) if m == recency else F.coalesce(F.col(named(i, m)), F.lit(0).cast("long"))).alias(column_name(k, m))
            for i, k in enumerate(kinds) for m in metrics
        ],
    )


def feature_tables(long: DataFrame, entity: str, kind: str, kinds: list[str], metrics: list[str], most: int = 2000, recency: str = "since") -> list[DataFrame]:
    """The wide table in parts of at most ``most`` columns: all entities, and consecutive ranges of the kinds."""
    step = max(1, most // max(1, len(metrics)))
    return [feature_table(long, entity, kind, kinds[i : i + step], metrics, recency) for i in range(0, max(1, len(kinds)), step)]


def feature_maps(long: DataFrame, entity: str, kind: str, metrics: list[str]) -> DataFrame:
    """One row per entity with ``features``: kind -> struct of the metrics, for any number of kinds and no list.

    Absent kinds are absent from the map; a null kind leaves the entity a row and no entry."""
    entry = F.when(F.col(kind).isNotNull(), F.struct(F.col(kind), F.struct(*metrics)))
    return long.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.map_from_entries(F.collect_list(entry)).alias("features"))
