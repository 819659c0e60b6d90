"""Scans and sinks of the text formats, over lines and folders that are written from the tables first, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators import asof
from tidemark.operators import catches as C
from tidemark.operators import ratings as R
from tidemark.operators import series as S
from tidemark.operators import timetable as T
from tidemark.plans import catchlog, ratings, series
from tidemark.plans import timetable as times
from tidemark.sources import lines as L
from tidemark.sources import logs, records
from tidemark.sources.sinks import kv_text
from tidemark.session import checkpoint_folder, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


# --- rating stream ----------------------------------------------------------------------------------------

@query("""select user_id, session_id, commit_time, coalesce(team, 0)::tinyint team, coalesce(battle_score, 0) battle_score, coalesce(victories, false) victories, coalesce(early_quit, false) early_quit,
coalesce(team_score_top_20_percent, false) team_score_top_20_percent, faction from battle_rows where user_id is not null and session_id is not null and commit_time is not null and faction is not null""")
def stored_row_scan(s, d):
    b = table(s, d, "battle_rows")
    return records.stored_rows(b.select(kv_text(["user_id", "session_id", "commit_time", "battle_score", "team", "faction"], records.FLAGS).alias("line")))


@query("""select user_id, session_id, arg_max(team, row_id)::tinyint team, arg_max(victories is not null, row_id) victory from battle_rows where team in (1, 2) and user_id is not null and session_id is not null group by 1, 2""")
def user_team_scan(s, d):
    b = table(s, d, "battle_rows")
    body = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{n}":'), F.col(c).cast("string"))) for c, n in (("user_id", "user_id"), ("session_id", "session_id"), ("team", "team"), ("victories", "victory"))])
    return records.user_team(b.select("row_id", F.concat(F.lit("{"), body, F.lit("}")).alias("line")), "row_id")


@query("""select user_id, (session_id::hugeint + case when session_id < 0 then 18446744073709551616 else 0 end)::decimal(20,0) session_id, arg_max(coalesce(faction, 'mixed'), row_id) mode from battle_rows where user_id is not null and battle_rows.session_id is not null group by 1, battle_rows.session_id""")
def user_faction_scan(s, d):
    b = table(s, d, "battle_rows")
    part = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":"'), c, F.lit('"')))
    body = F.concat_ws(",", part("user_id", F.col("user_id").cast("string")), part("session_id", F.lower(F.hex("session_id"))), part("mode", F.col("faction")))
    return records.user_faction(b.select("row_id", F.concat(F.lit("{"), body, F.lit("}")).alias("line")), "row_id")


@query(ratings.CTE + """select session_id, case when disbalance_1 then 'team_1_unbalanced' when disbalance_2 then 'team_2_unbalanced' else 'balanced' end balance_group,
case when won1 then 'team_1_win' else 'team_2_win' end win_group from balance""")
def session_class_scan(s, d):
    return records.session_classes(records.class_lines(ratings._balance(s, d)))


@query(ratings.CTE + "select battle_score // battles s, user_id, mmr from board where battles >= 6")
def score_index(s, d):
    """The leaderboard written as text, restored, and its index of calibrated users."""
    board = ratings._board(s, d)
    cols = ["user_id", "mmr", "battles", "victories", "early_quites", "top_20", "battle_score", "last_session"]
    return records.score_index(L.leaderboard_lines(board.select(kv_text(cols).alias("line"))))


@query(ratings.CTE + "select user_id, faction, count(*) battles from seats where faction is not null group by 1, 2")
def counter_scan(s, d):
    return records.counters(R.faction_counters(ratings._seats(s, d)).select(kv_text(["user_id", "faction", "battles"]).alias("line")))


@query("select c_custkey id, case when c_acctbal > 0 then c_acctbal else 0 end revenue, c_mktsegment = 'BUILDING' special from customer")
def payment_scan(s, d):
    c = table(s, d, "customer")
    kind = F.col("c_mktsegment") == "BUILDING"
    # The player type is a boolean in some rows and text in others, and rows without revenue lack the key.
    parts = [F.concat(F.lit('"user_id":'), F.col("c_custkey").cast("string")), F.when(F.col("c_acctbal") > 0, F.concat(F.lit('"revenue":'), F.col("c_acctbal").cast("string"))),
             F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"player_type":'), kind.cast("string"))).otherwise(F.concat(F.lit('"player_type":"'), kind.cast("string"), F.lit('"')))]
    return records.payments(c.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line")))


@query(f"select board || '__' || counter || ':' || v || ';' line from (unpivot ({ratings.ORACLE['board_statistics']}) on {', '.join(R.STATISTICS)} into name counter value v)")
def statistics_text(s, d):
    return records.statistics_lines(R.board_statistics(ratings._seats(s, d), ratings._board(s, d), ratings._modes(s, d), table(s, d, "registrations")))


_OPPONENTS = """, op as (select session_id, case when faction = 'faction_1' then 'faction_2' else 'faction_1' end faction, string_agg((case when mmr_type = 'MMR' then mmr else 0 end)::varchar, '+' order by case when mmr_type = 'MMR' then mmr else 0 end desc) opponents
from rated group by 1, 2)
"""


@query(ratings.CTE + _OPPONENTS + "select session_id, faction, opponents from op")
def opponent_lists(s, d):
    return records.opponents(R.rated_seats(ratings._seats(s, d), ratings._board(s, d)))


@query(f"""with delta as ({ratings.ORACLE['v1_delta_snapshot']}), {ratings.CTE.strip().removeprefix('with')} {_OPPONENTS}
select session_id, user_id, '{{u:' || user_id || ',dm:' || delta || ',m:' || mmr || ',o:' || coalesce(opponents, '') || ',bs:' || score_norm || '}}' line from delta left join op using (session_id, faction)""")
def change_log(s, d):
    seats, board = ratings._seats(s, d), ratings._board(s, d)
    return records.change_lines(R.v1_snapshot(seats, board, ratings._modes(s, d)), records.opponents(R.rated_seats(seats, board)))


@query(ratings.CTE + """select session_id, user_id, '{"kind":"' || mmr_type || '","mmr":' || mmr || '}' rating from rated""")
def rating_json(s, d):
    r = R.rated_seats(ratings._seats(s, d), ratings._board(s, d))
    return r.select("session_id", "user_id", F.to_json(F.struct(F.col("mmr_type").alias("kind"), "mmr")).alias("rating"))


# --- catch log ----------------------------------------------------------------------------------------------

@query(catchlog.CATCH + """select map_name "map", point, "name", test, strftime(ts, '%Y%m%d_%H%M%S') "timestamp", mass, long, exp_sum, device, epoch_us(date_trunc('second', ts)) // 1000 - 7200000 "at"
from c where map_name in ('amber_lake', 'iron_brook', 'fern_pond') and point is not null and ts >= timestamp '2013-01-10 02:00:00'""")
def map_log_scan(s, d):
    """Catches written as one folder per map and point, read back for three maps from a time on."""
    checkpoint_folder(s)
    root = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/maps-{uuid.uuid4().hex}"
    c = catchlog._catches(s, d).where(F.col("map_name").isNotNull() & F.col("point").isNotNull())
    logs.write_maps(c.withColumn("timestamp", F.date_format("ts", "yyyyMMdd_HHmmss")).withColumnRenamed("map_name", "map"), root)
    r = logs.read_maps(s, root, ["amber_lake", "iron_brook", "fern_pond"], 1_357_776_000_000)
    return r.select("map", "point", "name", "test", "timestamp", "mass", "long", "exp_sum", "device", "at")


_DEVICES = ", ".join(f"('{a}', {b}::double, {c}::double)" for a, b, c in catchlog.DEVICES)


@query(catchlog.CATCH + f""", dv(device, rig, light) as (values {_DEVICES}),
x as (select catch_id, exp base, case when exp_l > 0 then light * exp else 0 end l, case when exp_happy > 0 then exp * 2.0::double else 0 end h, case when exp_prem > 0 then exp else 0 end p, coalesce(exp_drink, 0) k, rig from c join dv using (device) where exp is not null)
select catch_id, base, round(l)::bigint l_bonus, round(h)::bigint happy_bonus, p prem_bonus, k drink_bonus, round(base + h + l + p + k)::bigint all_exp, round(base * rig)::bigint real_exp from x""")
def bonus_rebuild(s, d):
    dev = s.createDataFrame(catchlog.DEVICES, "device string, rig_mul double, light_mul double")
    return C.bonus_rebuild(catchlog._catches(s, d), F.broadcast(dev))


@query(catchlog.CATCH + "select catch_id, case when coalesce(exp_l, 0) > 0 then 'rod_light' else 'rod_default' end device from c")
def device_repair(s, d):
    return C.device_repair(catchlog._catches(s, d), "rod_light", "rod_default").select("catch_id", "device")


#: Fixed presets of the demonstration: code -> preset, preset -> rig, rig -> multiplier.
PRESETS, RIGS, MULS = [("1", "calm"), ("2", "river"), ("3", "deep")], [("calm", "float"), ("river", "feeder"), ("deep", "spin")], [("float", 1.0), ("feeder", 1.82), ("spin", 1.1)]
_rows = lambda t: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::double" for x in r) + ")" for r in t)


@query(f"""with a as ({catchlog.ORACLE['device_asof']}), p(code, preset) as (values {_rows(PRESETS)}), r(preset, rig) as (values {_rows(RIGS)}), m(rig, rig_mul) as (values {_rows(MULS)})
select event_id, code, preset, rig, rig_mul from a join p using (code) join r using (preset) join m using (rig)""")
def device_chain(s, d):
    """The device in force at every probe, followed to its preset, rig and multiplier."""
    dims = (s.createDataFrame(PRESETS, "code string, preset string"), s.createDataFrame(RIGS, "preset string, rig string"), s.createDataFrame(MULS, "rig string, rig_mul double"))
    return C.device_chain(catchlog.device_asof(s, d), *dims).select("event_id", "code", "preset", "rig", "rig_mul")


_lines_sql = catchlog.ORACLE["mass_length_lines"]


@query(catchlog.CATCH + f""", b as (select long k, sum(mass)::bigint // count(*) v from c where "name" is not null and long is not null and mass is not null group by 1),
b2 as (select *, lag(k) over (order by k) k1, lag(v) over (order by k) v1 from b), n0 as ({_lines_sql}),
j as (select n0.*, k k0, v v0, k1, v1 from n0 asof left join b2 on n0.length >= b2.k),
g as (select *, k0 is not null and (k0 = length or coalesce(k1, 0) <> 0) enough,
  case when k0 = length then v0 else least(greatest(trunc((v0 - v1) / nullif(k0 - k1, 0) * length::double + (v1 - (v0 - v1) / nullif(k0 - k1, 0) * k1)), 0), 4611686018427387904::double) end guess from j),
e as (select *, case when enough then abs(mass::double - guess)::double end err from g)
select doc_id, line, mass, length, round(err, 3) err from e qualify row_number() over (partition by doc_id order by err nulls last, line) = 1""")
def candidate_choice(s, d):
    """Of the (mass, length) lines of a text the one that the catches' line fits best; without one the first."""
    c = catchlog._catches(s, d).withColumn("all", F.lit(1))
    stats = C.bucket_stats(c.where(F.col("name").isNotNull()), "all", "long", "mass")
    found = C.mass_length_lines(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), "mass", F.col("length").alias("long"), F.lit(1).alias("all"))
    best = C.best_candidate(C.validate(found, stats, "all", "long", "mass", "lm"), ["doc_id"], "lm_err", "line")
    return best.select("doc_id", "line", "mass", F.col("long").alias("length"), F.round("lm_err", 3).alias("err"))


@query(catchlog.CATCH + """, o as (select catch_id, exp x, unnest([exp_sum // 4, exp_sum // 2, exp_sum]) v, unnest([0, 1, 2]) i from c where exp is not null and exp_sum is not null)
select catch_id, arg_min(v, row(abs(v - x), i)) closest from o group by 1""")
def closest_share(s, d):
    return catchlog._catches(s, d).where(F.col("exp").isNotNull() & F.col("exp_sum").isNotNull()).select("catch_id", num.closest_share(F.col("exp_sum"), F.col("exp")).alias("closest"))


# --- series and timetable -----------------------------------------------------------------------------------

@query(series.HOURS + """, q as (select a.id id1, b.id id2 from (select distinct id from h where id % 50 = 0) a join (select distinct id from h) b on true),
x as (select id1, id2, unnest(range(24)) x from q)
select id1, id2, x.x::bigint x, round(coalesce(a.y, 0) + coalesce(b.y, 0), 4) total, round(coalesce(a.y, 0) / 3, 4) third from x left join h a on a.id = id1 and a.x = x.x left join h b on b.id = id2 and b.x = x.x where a.y is not null or b.y is not null""")
def sparse_sums(s, d):
    """Sparse sums of every fiftieth series with all others, a missing place counting 0, and its values divided by 3."""
    m = series._hours(s, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("x", "y"))).alias("v"))
    j = S.against_all(m, m.where("id % 50 = 0")).select("id1", "id2", S.sparse_sum(F.col("a"), F.col("b")).alias("t"), S.sparse_div(F.col("a"), 3).alias("q"))
    e = j.select("id1", "id2", "q", F.explode("t").alias("x", "total"))
    return e.select("id1", "id2", "x", F.round("total", 4).alias("total"), F.round(F.coalesce(F.try_element_at("q", F.col("x")), F.lit(0.0)), 4).alias("third"))


@query("""select a.vec_id id1, b.vec_id id2, round(list_sum(list_transform(range(1, 65), lambda j: (a.embedding[j]::double + b.embedding[j]::double) / 2)), 4) half_sum from embeddings a join embeddings b on a.vec_id % 50 = 0""")
def dense_sums(s, d):
    v = series._vectors(s, d)
    half = S.vector_div(S.vector_sum(F.col("a"), F.col("b")), F.transform("a", lambda x: F.lit(2.0)))
    return S.against_all(v, v.where("id % 50 = 0")).select("id1", "id2", F.round(F.aggregate(half, F.lit(0.0), lambda t, x: t + x), 4).alias("half_sum"))


@query(series.ASSIGN_SQL + series.QUALITY + " select id, (case when abs(distance - score) > 3 * sigma then cluster + 66600 else cluster end)::int cluster from a join q using (cluster)")
def later_wins(s, d):
    """The assignment, overridden by that of the outliers alone."""
    a = series._assigned(s, d)
    out = S.sigma_outliers(a, S.quality(a, series.EUCLID)).where("outlier").select("id", "cluster")
    return S.later_wins(a.select("id", "cluster"), out, ["id"])


@query(times.CTE + """select side, time_s, printf('%02d:%02d:%02d', (time_s % 86400 + 14400) // 3600, (time_s % 86400 + 14400) % 3600 // 60, time_s % 60) shown from runs""")
def display_time(s, d):
    return times._runs(s).select("side", "time_s", T.format_hms(T.display_seconds(F.col("time_s"))).alias("shown"))


@query(times.CTE + """select (time_s // 86400)::int "day", count(*) runs, 0::bigint late from runs group by 1""")
def shift_coverage(s, d):
    """Runs that the shifts of a day cover, each once, and links that start before arrival or wait more than a minute."""
    from pyspark.sql import Window

    sh = T.shifts(times._runs(s), times.DURATION)
    gap = F.col("time_s") - F.lag("time_s").over(Window.partitionBy("day", "shift_id").orderBy("seq")) - 3360
    return sh.withColumn("gap", gap).groupBy("day").agg(F.countDistinct("side", "time_s").alias("runs"), F.count_if((F.col("gap") < 0) | (F.col("gap") > 60)).alias("late"))
