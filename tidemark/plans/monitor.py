"""Process-monitor queries over the event table as samples (pid = user, tick = hour)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import monitor as M
from tidemark.session import table

QUERIES, ORACLE = {}, {}
SAMPLES = """with s as (select epoch_us(ts) // 3600000000 tick, user_id pid, max(event_id % 1000) memory, max(floor(value)::bigint) cpu, max(event_id) cpu_time, max(event_id % 4096) virtual
  from events where user_id is not null and ts is not null group by 1, 2),
g as (select t.tick, b.pid from (select distinct tick from s) t join (select pid, min(tick) born from s group by 1) b on t.tick >= b.born),
r as (select g.tick, g.pid, case when memory is not null then memory else 0 end memory, case when memory is not null then cpu else 0 end cpu,
  last_value(cpu_time ignore nulls) over (partition by g.pid order by g.tick) cpu_time, memory is not null was_in_time, case when memory is not null then virtual else 0 end virtual_memory
  from g left join s using (tick, pid))
"""


def _samples(s, d):
    e = table(s, d, "events").where("user_id is not null and ts is not null")
    return e.select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("tick"), F.col("user_id").alias("pid"), (F.col("event_id") % 1000).alias("memory"), F.floor("value").alias("cpu"), F.col("event_id").alias("cpu_time"), (F.col("event_id") % 4096).alias("virtual"))


def process_samples(s, d):
    return M.process_samples(_samples(s, d))


def process_totals(s, d):
    return M.process_totals(_samples(s, d))


QUERIES = {"process_samples": process_samples, "process_totals": process_totals}
ORACLE = {
    "process_samples": SAMPLES + "select * from r",
    "process_totals": SAMPLES + "select tick, sum(memory)::bigint memory, sum(virtual_memory)::bigint virtual_memory, sum(cpu)::bigint cpu, count(*) pids, count(*) filter (where was_in_time) alive from r group by 1",
}
