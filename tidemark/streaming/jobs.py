"""Structured Streaming forms: session closing, running board statistics, last known process values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_sessions(rows: DataFrame, at: str = "commit_time", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, opened, closed, seats, score, won): a session closes once its gap has passed the watermark.

    State per open session only; rows later than the watermark are dropped by Spark."""
    t = rows.withColumn("event_at", F.timestamp_millis(F.col(at))).withWatermark("event_at", late)
    s = t.groupBy("session_id", F.session_window("event_at", gap)).agg(F.count("*").alias("seats"), F.sum("battle_score").alias("score"), F.max(F.coalesce("victories", F.lit(False)).cast("int")).alias("won"))
    return s.select("session_id", F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "seats", "score", (F.col("won") == 1).alias("won"))


def hourly_catches(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Catches and mass per species and hour of logging, with late data kept for ``late``."""
    t = rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy(F.window("at", "1 hour"), F.lower(F.btrim("name")).alias("name")).agg(F.count("*").alias("catches"), F.sum("mass").alias("mass"))
    return g.select(F.col("window.start").alias("hour"), "name", "catches", "mass")


STATE = "memory long, cpu_time long, tick long"
OUT = "pid long, tick long, memory long, cpu_time long, was_in_time boolean"


def last_known(samples: DataFrame) -> DataFrame:
    """(pid, tick, memory, cpu_time, alive) whenever a process is sampled; state is the last sample per pid.

    Nothing is forgotten, so the state holds one small row per pid ever seen; samples not later than it are dropped."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (0, 0, -1)
        rows = pd.concat(list(batches)).sort_values("tick")
        rows = rows[rows.tick > last[2]]
        if len(rows):
            r = rows.iloc[-1]
            state.update((int(r.memory), int(r.cpu_time), int(r.tick)))
            yield rows.assign(pid=key[0], was_in_time=True)[["pid", "tick", "memory", "cpu_time", "was_in_time"]]

    return samples.groupBy("pid").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


OPEN = "session_id long, first long, last long, seats long, score long"
CLOSED = "feed string, session_id long, first long, last long, seats long, score long"


def closed_on_change(rows: DataFrame, feed: str = "feed", order: str = "row_id") -> DataFrame:
    """(feed, session_id, first, last, seats, score) of a session as soon as the feed's next row names another one.

    A feed is one ordered stream, so its rows are one group by nature; several feeds run side by side. State is the
    open session alone, which the next run resumes; a session that comes back later counts as a new one."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (list(state.get) if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values(order).itertuples():
            at, score = int(getattr(r, order)), 0 if pd.isna(r.battle_score) else int(r.battle_score)
            if now and now[0] != r.session_id:
                out.append((key[0], *now))
                now = None
            now = [int(r.session_id), at, at, 1, score] if now is None else [now[0], now[1], at, now[3] + 1, now[4] + score]
        if now:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    known = rows.where(F.col("session_id").isNotNull() & F.col(order).isNotNull())
    return known.groupBy(feed).applyInPandasWithState(step, CLOSED, OPEN, "append", GroupStateTimeout.NoTimeout)


def monitor_csv(samples: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Appends every micro-batch of samples as ';'-separated rows and its totals beside them; returns the query.

    interval: how often to sample, as '1 second'; without one what is available is processed and the query ends."""
    from tidemark.operators.monitor import process_totals

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("append").option("sep", ";").csv(f"{path}/samples")
        process_totals(batch).withColumn("batch", F.lit(n)).write.mode("append").option("sep", ";").csv(f"{path}/totals")

    w = samples.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is available and stops; the checkpoint carries offsets and state to the next run."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
