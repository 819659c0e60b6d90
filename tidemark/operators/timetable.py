"""Timetables: departures with time-varying headways, greedy chaining into shifts, roster simulation."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK, DAY, HOUR = 604_800, 86_400, 3_600


def parse_hms(text: Column) -> Column:
    """Seconds of H:M:S (hours unbounded); an unreadable time raises."""
    p = F.split(text, ":")
    ok = text.rlike("^[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]$")
    return F.when(ok, F.get(p, F.lit(0)).cast("long") * 3600 + F.get(p, F.lit(1)).cast("long") * 60 + F.get(p, F.lit(2)).cast("long")).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("long"))


def format_hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def display_seconds(t: Column, shift: int = 4 * HOUR) -> Column:
    """Time of day that is shown: the second of the day plus the display's shift, not wrapped."""
    return F.pmod(t, F.lit(DAY)) + F.lit(shift)


def headways(spark: SparkSession, base: int, depths: list[tuple[int, int, int]]) -> DataFrame:
    """(t, h): the headway of every second of the week, the least of base and base div divisor of the intervals over it.

    An interval join of the seconds with a few intervals, as a generated sequence per interval."""
    d = spark.createDataFrame(depths, "divisor int, a long, b long").where("b > a")
    cover = d.select(F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("t"), F.floor(F.lit(base) / F.col("divisor")).alias("h")).groupBy("t").agg(F.min("h").alias("h"))
    return spark.range(WEEK).withColumnRenamed("id", "t").join(cover, "t", "left").select("t", F.least(F.lit(base), F.coalesce("h", F.lit(base))).cast("long").alias("h"))


def runs(heads: DataFrame, side: str, duration: int, other: int) -> DataFrame:
    """(side, time_s) of departures: inside each cycle of both durations, where the place in it is a multiple of h."""
    step = duration + other
    first = 0 if side == "Right" else -duration
    at = F.col("t") - first
    return heads.where((F.col("t") - at % step < WEEK - step) & (at % step % F.col("h") == 0)).select(F.lit(side).alias("side"), F.col("t").alias("time_s"))


def shifts(all_runs: DataFrame, durations: dict[str, int], wait: int = 60) -> DataFrame:
    """(day, shift_id, seq, side, time_s): per day, the earliest free run starts a shift that goes on with the first
    free opposite run within ``wait`` seconds after arrival. A day has at most two runs a second, which bounds the group."""
    def chain(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import bisect

        free = {s: sorted(g.time_s[g.side == s]) for s in ("Right", "Back")}
        out, n = [], 0
        for t, s in sorted(zip(g.time_s, g.side), key=lambda x: (x[0], x[1] != "Right")):
            at = bisect.bisect_left(free[s], t)
            if at >= len(free[s]) or free[s][at] != t:
                continue
            seq, now = 0, (t, s)
            while now:
                free[now[1]].remove(now[0])
                out.append((key[0], n, seq, now[1], now[0]))
                seq += 1
                side, ready = ("Back" if now[1] == "Right" else "Right"), now[0] + durations[now[1]]
                at = bisect.bisect_left(free[side], ready)
                now = (free[side][at], side) if at < len(free[side]) and free[side][at] <= ready + wait else None
            n += 1
        return pd.DataFrame(out, columns=["day", "shift_id", "seq", "side", "time_s"])

    return all_runs.withColumn("day", F.floor(F.col("time_s") / DAY).cast("int")).groupBy("day").applyInPandas(chain, "day int, shift_id int, seq int, side string, time_s long")


#: Fixed values of the service tiers: name, length in days, counters that are reset and their new values in days.
TIERS = (("A", 1, {"A": 30}), ("B", 3, {"A": 30, "B": 120}), ("C", 14, {"A": 30, "B": 120, "C": 450}), ("D", 45, {"A": 30, "B": 120, "C": 450, "D": 1825}))


def roster(shift_rows: DataFrame, trains: DataFrame, durations: dict[str, int], base: int, seed: int = 1) -> DataFrame:
    """Duties (day, depot, train, seq, kind, shift_id) of one week: service looks, station trains first, then a drawn
    depot train per shift; a shift no train can take is left out of the duties. One bounded group."""
    def run(key: tuple, s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rng, duties = random.Random(seed), []
        fleet = {(r.depot, r.id): {"place": "Depot", "side": None, "home": r.home, "free": 0, "left": 0, "due": {x: getattr(r, x) for x in "ABCD"}} for r in t.sort_values(["depot", "id"]).itertuples()}
        plan: dict[int, dict[int, list]] = {}
        for r in s.sort_values(["day", "shift_id", "seq"]).itertuples():
            plan.setdefault(r.day, {}).setdefault(r.shift_id, []).append((r.time_s, r.side))
        for day in sorted(plan):
            todo, seq, worked = dict(plan[day]), {k: 0 for k in fleet}, {k: 0 for k in fleet}

            def add(k, kind, shift=None):
                duties.append((day, k[0], k[1], seq[k], kind, shift))
                seq[k] += 1

            def home(k, x, at=None):
                add(k, "Depot")
                x["place"], x["free"] = "Depot", (x["free"] if at is None else at) + HOUR

            def drive(k, x, i, runs_):
                add(k, "Run", i)
                x["place"], x["side"], x["free"] = "Station", runs_[-1][1], runs_[-1][0] + durations[runs_[0][1]]
                worked[k] += runs_[-1][0] - runs_[0][0]
                if x["free"] < (day + 1) * DAY - base:
                    home(k, x)

            for name, days, reset in TIERS:
                for k, x in fleet.items():
                    if x["due"][name] < DAY:
                        add(k, "Service" + name)
                        x["place"], x["left"] = "Service", days * DAY
                        x["due"].update({c: v * DAY for c, v in reset.items()})
                        x["free"] += days * DAY
            for k, x in fleet.items():
                if x["place"] == "Service" and x["left"] < DAY:
                    home(k, x)
                if x["place"] == "Service":
                    x["left"] -= DAY
            for k, x in [(k, x) for k, x in fleet.items() if x["place"] == "Station"]:
                side = "Back" if x["side"] == "Right" else "Right"
                near = [i for i, r in todo.items() if r[0][1] == side and 0 <= r[0][0] - x["free"] <= 2 * base]
                if near:
                    i = max(near, key=lambda i: todo[i][0][0])
                    drive(k, x, i, todo.pop(i))
                else:
                    home(k, x)
            for i in sorted(todo):
                r = todo[i]
                can = [k for k, x in fleet.items() if x["place"] == "Depot" and x["home"] == r[0][1] and x["free"] <= r[0][0]]
                if can:
                    k = rng.choice(can)
                    drive(k, fleet[k], i, r)
            for k, x in fleet.items():
                for c in x["due"]:
                    x["due"][c] -= worked[k]
        return pd.DataFrame(duties, columns=["day", "depot", "train", "seq", "kind", "shift_id"]).astype({"shift_id": "Int64"})

    one = F.lit(1).alias("g")
    if trains.count() > 100_000 or shift_rows.count() > 2_000_000:
        raise ValueError("a roster is one fleet on one line")
    return shift_rows.select("*", one).groupBy("g").cogroup(trains.select("*", one).groupBy("g")).applyInPandas(run, "day int, depot string, train int, seq int, kind string, shift_id long")
