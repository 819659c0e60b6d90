"""Timetable queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators import timetable as T
from tidemark.sources.lines import parse_hms

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


BASE, DURATION = 960, {"Right": 3360, "Back": 3360}
#: Fixed values of the sample line: (divisor, from, to) in time of week.
DEPTHS = [
    (1, "0:0:0", "168:0:0"),
    (2, "0:30:0", "44:0:0"), (4, "1:30:0", "20:10:0"),
    (4, "25:30:0", "44:10:0"), (8, "26:0:0", "31:36:0"), (8, "36:0:0", "41:36:0"),
    (2, "48:30:0", "69:0:0"), (4, "49:30:0", "68:10:0"), (8, "50:0:0", "55:36:0"), (8, "60:0:0", "65:36:0"),
    (2, "72:30:0", "93:0:0"), (4, "73:30:0", "92:10:0"), (8, "74:0:0", "79:36:0"), (8, "84:0:0", "89:36:0"),
    (2, "96:30:0", "117:0:0"), (4, "97:30:0", "116:10:0"), (8, "98:0:0", "103:36:0"), (8, "108:0:0", "113:36:0"),
    (2, "120:30:0", "141:0:0"), (4, "121:30:0", "140:10:0"), (8, "122:0:0", "138:48:0"),
    (2, "144:30:0", "165:0:0"), (4, "145:30:0", "164:10:0"),
]
SECONDS = [(k, parse_hms(a), parse_hms(b)) for k, a, b in DEPTHS]
CTE = "with d(k, a, b) as (values " + ", ".join(f"({k}, {a}, {b})" for k, a, b in SECONDS) + f"""),
h as (select t, least({BASE}, coalesce(min({BASE} // k), {BASE}))::bigint h from (select unnest(range({T.WEEK})) t) left join d on t >= a and t < b group by 1),
runs as (select 'Right' side, t time_s from h where t - t % 6720 < {T.WEEK} - 6720 and t % 6720 % h = 0
  union all select 'Back', t from h where t - (t + 3360) % 6720 < {T.WEEK} - 6720 and (t + 3360) % 6720 % h = 0)
"""


def _runs(s):
    h = T.headways(s, BASE, SECONDS)
    return T.runs(h, "Right", 3360, 3360).unionByName(T.runs(h, "Back", 3360, 3360))


@query(CTE + "select t, h from h")
def headway_by_second(s, d):
    return T.headways(s, BASE, SECONDS)


@query(CTE + "select side, time_s from runs")
def timetable_runs(s, d):
    return _runs(s)


@query(CTE + """select r.side, r.time_s, min(n.time_s) next_at from runs r left join runs n on n.side <> r.side and n.time_s between r.time_s + 3360 and r.time_s + 3420 group by 1, 2""")
def next_run_interval(s, d):
    r = _runs(s)
    probes = r.select("side", "time_s", F.when(F.col("side") == "Right", "Back").otherwise("Right").alias("opposite"), (F.col("time_s") + 3360).alias("ready"))
    events = r.select(F.col("side").alias("opposite"), F.col("time_s").alias("at"))
    return asof.first_within(probes, "ready", events, "at", 60, ["opposite"]).select("side", "time_s", "next_at")


@query(CTE + "select time_s, printf('%02d:%02d:%02d', time_s // 3600, time_s % 3600 // 60, time_s % 60) txt, time_s as back from (select distinct time_s from runs)")
def hms_roundtrip(s, d):
    t = _runs(s).select("time_s").distinct().withColumn("txt", T.format_hms(F.col("time_s")))
    return t.withColumn("back", T.parse_hms(F.col("txt")))


# One step per run and day: the first free opposite run within a minute after arrival, else the earliest free run as a new shift.
SHIFTS = CTE.replace("with d(", "with recursive d(", 1) + """, f as (select (time_s // 86400)::int "day", coalesce(list(time_s order by time_s) filter (where side = 'Right'), []::bigint[]) r, coalesce(list(time_s order by time_s) filter (where side = 'Back'), []::bigint[]) b from runs group by 1),
s as (select "day", r, b, -1 shift_id, 0 seq, '' side, -1000000::bigint time_s from f union all
  select "day", case when pick = 'Right' then list_filter(r, lambda x: x <> t) else r end, case when pick = 'Back' then list_filter(b, lambda x: x <> t) else b end,
    case when go then shift_id else shift_id + 1 end, case when go then seq + 1 else 0 end, pick, t
  from (select *, case when go then case when side = 'Right' then 'Back' else 'Right' end when coalesce(r[1] <= b[1], len(r) > 0) then 'Right' else 'Back' end pick,
      case when go then cand when coalesce(r[1] <= b[1], len(r) > 0) then r[1] else b[1] end t
    from (select *, coalesce(cand <= time_s + 3420, false) go
      from (select *, list_filter(case when side = 'Right' then b else r end, lambda x: x >= time_s + 3360)[1] cand from s where len(r) + len(b) > 0))))
"""


@query(SHIFTS + """select "day", shift_id, seq, side, time_s from s where shift_id >= 0""")
def timetable_shifts(s, d):
    return T.shifts(_runs(s), DURATION)


@query()
def timetable_roster(s, d):
    trains = s.range(80).select(
        F.when(F.col("id") < 40, "th19").otherwise("th15").alias("depot"), (F.col("id") % 40 + 1).cast("int").alias("id"), F.when(F.col("id") < 40, "Back").otherwise("Right").alias("home"),
        *[(F.col("id") * 7919 % n * T.DAY + T.HOUR).alias(c) for c, n in (("A", 30), ("B", 120), ("C", 450), ("D", 1825))])
    return T.roster(T.shifts(_runs(s), DURATION), trains, DURATION, BASE)
