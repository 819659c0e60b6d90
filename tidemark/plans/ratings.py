"""Rating-stream queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators import ratings as R
from tidemark.session import slots, table


def _seats(s: SparkSession, d: str) -> DataFrame:
    return R.clean_seats(table(s, d, "battle_rows"))


def _board(s: SparkSession, d: str) -> DataFrame:
    return R.clean_board(table(s, d, "leaderboard_rows"))


def _modes(s: SparkSession, d: str) -> DataFrame:
    return R.clean_modes(table(s, d, "session_mode"))


def _balance(s: SparkSession, d: str) -> DataFrame:
    return R.session_balance(_seats(s, d), _board(s, d), _modes(s, d))


CTE = """
with seats as (
  select session_id, user_id, commit_time, coalesce(battle_score, 0) score, coalesce(victories, false) won, coalesce(early_quit, false) quit,
         coalesce(team_score_top_20_percent, false) top20, lower(trim(faction)) faction, team
  from battle_rows where user_id is not null and session_id is not null
  qualify row_number() over (partition by session_id, user_id order by ingest_time desc nulls last, row_id desc) = 1),
board as (
  select user_id, coalesce(mmr, 0) mmr, coalesce(battles, 0) battles, coalesce(victories, 0) victories, coalesce(early_quites, 0) early_quites,
         coalesce(top_20, 0) top_20, coalesce(battle_score, 0) battle_score, coalesce(last_session, 0) last_session
  from leaderboard_rows where user_id is not null
  qualify row_number() over (partition by user_id order by last_session desc nulls last, battles desc nulls last, leaderboard_rows.mmr desc nulls last,
          victories desc nulls last, early_quites desc nulls last, top_20 desc nulls last, battle_score desc nulls last) = 1),
modes as (
  select session_id, coalesce(mode, '') mode from session_mode where session_id is not null
  qualify row_number() over (partition by session_id order by opened_time desc nulls last, session_mode.mode desc nulls last) = 1),
named as (
  select *, case when contains(mode, 'newbie') then 'newbie_common' when contains(mode, 'low_teir') then 'low_teir_common'
                 when contains(mode, 'high_teir') then 'high_teir_common' else 'lobbie_common' end common,
         case when contains(mode, 'newbie') then 'newbie' when contains(mode, 'low_teir') then substr(mode, instr(mode, 'low_teir'))
              when contains(mode, 'high_teir') then substr(mode, instr(mode, 'high_teir')) else 'lobbie' end specific
  from modes),
gate as (
  select g.*, m.mode, m.common, m.specific from (
    select session_id, count(*) filter (where faction = 'faction_1') n1, count(*) filter (where faction = 'faction_2') n2, sum(score)::bigint total_score
    from seats group by 1) g join named m using (session_id)
  where n1 >= 5 and n2 >= 5 and common <> 'newbie_common'),
rated as (
  select s.*, coalesce(b.mmr, 0) mmr, coalesce(b.battles, 0) battles,
         case when b.battles is null then 'None' when b.battles > 5 then 'MMR' else 'NotEnough' end mmr_type,
         row_number() over (partition by session_id, faction order by (coalesce(b.battles, 0) > 5) desc,
                            case when coalesce(b.battles, 0) > 5 then b.mmr else 0 end desc, s.user_id desc) place
  from seats s left join board b using (user_id) where faction in ('faction_1', 'faction_2')),
top as (
  select session_id,
    (sum(mmr) filter (where faction = 'faction_1' and place <= 3 and mmr_type = 'MMR'))::bigint // nullif(count(*) filter (where faction = 'faction_1' and place <= 3 and mmr_type = 'MMR'), 0) top1,
    (sum(mmr) filter (where faction = 'faction_2' and place <= 3 and mmr_type = 'MMR'))::bigint // nullif(count(*) filter (where faction = 'faction_2' and place <= 3 and mmr_type = 'MMR'), 0) top2,
    bool_or(faction = 'faction_1' and won) won1, bool_or(faction = 'faction_2' and won) won2
  from rated group by 1),
balance as (
  select session_id, common, specific, n1, n2, total_score, top1, top2, won1, won2, coalesce(top1 - top2 > 800, false) disbalance_1,
         coalesce(top2 - top1 > 800, false) disbalance_2, mode
  from gate join top using (session_id))
"""

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


@query(CTE + "select * from balance")
def session_balance(s, d):
    return _balance(s, d)


@query(CTE + "select session_id, mode, common, specific from named")
def mode_normalise(s, d):
    c, p = R.mode_names(F.col("mode"))
    return _modes(s, d).select("session_id", "mode", c.alias("common"), p.alias("specific"))


@query(CTE + "select session_id, mode, common, specific, n1, n2, total_score from gate")
def session_gate(s, d):
    return R.gate(_seats(s, d), _modes(s, d)).select("session_id", "mode", "common", "specific", "n1", "n2", "total_score")


@query(CTE + "select session_id, faction, user_id, mmr_type, mmr, place from rated")
def team_rank(s, d):
    return R.rated_seats(_seats(s, d), _board(s, d)).select("session_id", "faction", "user_id", "mmr_type", "mmr", F.col("place").cast("long").alias("place"))


@query(CTE + "select * from top")
def team_top3(s, d):
    return R.top3(R.rated_seats(_seats(s, d), _board(s, d)))


@query(CTE + """, reg as (select user_id, max(registered_time) r from registrations where user_id is not null group by 1),
new as (
  select session_id, faction, team, won, r is not null and commit_time - r > 0 and commit_time - r < 86400000 nb
  from seats left join reg using (user_id) where faction in ('faction_1', 'faction_2')),
cnt as (
  select session_id, count(*) filter (where nb and faction = 'faction_1') new1, count(*) filter (where nb and faction = 'faction_2') new2,
    count(*) filter (where nb and faction = 'faction_1' and team = 1) a1, count(*) filter (where nb and faction = 'faction_1' and team = 2) a2,
    count(*) filter (where nb and faction = 'faction_1' and team = 1 and won) w1, count(*) filter (where nb and faction = 'faction_1' and team = 2 and won) w2
  from new group by 1),
per as (
  select unnest(['common', mode, common, specific]) board, 1 battles, disbalance_1::int disbalance_team_1, (disbalance_1 and won1)::int disbalance_team_1_victory,
    disbalance_2::int disbalance_team_2, (disbalance_2 and won2)::int disbalance_team_2_victory, new1 new_user_battles, (new1 > 0)::int new_users_session,
    (new1 > 0 and (disbalance_1 or disbalance_2))::int new_user_disbalance_session, case when disbalance_1 or disbalance_2 then new1 else 0 end new_user_disbalance_battles,
    case when disbalance_1 then a1 when disbalance_2 then a2 else 0 end new_user_disbalance_allie_battles,
    case when disbalance_1 then w1 when disbalance_2 then w2 else 0 end new_user_disbalance_battles_victory,
    (new1 / n1 >= 0.69 and new2 / n2 < 0.31)::int newbie_count_disbalance_team_1, (new2 / n2 >= 0.69 and new1 / n1 < 0.31)::int newbie_count_disbalance_team_2
  from balance join cnt using (session_id))
select board, """ + ", ".join(f"sum({n})::bigint {n}" for n in R.STATISTICS) + " from per group by 1")
def board_statistics(s, d):
    return R.board_statistics(_seats(s, d), _board(s, d), _modes(s, d), table(s, d, "registrations"))


@query(CTE + """, x as (select (case when won1 then top1 - top2 else top2 - top1 end) v from balance where top1 is not null and top2 is not null),
y as (select v - v % 50 b from x), z as (select b bucket, 1 w from y union all select -b, 0 from y)
select bucket, sum(w)::bigint wins, count(*) total, round(sum(w) / count(*), 4) rate from z group by 1""")
def winrate_buckets(s, d):
    return R.win_buckets(_balance(s, d))


@query(CTE + """select (top1 - top2) - (top1 - top2) % 200 bucket, count(*) filter (where won1) wins, count(*) total, round(count(*) filter (where won1) / count(*), 4) rate
from balance where top1 is not null and top2 is not null group by 1""")
def spread_rebucket(s, d):
    return R.spread_rebucket(_balance(s, d))


@query(CTE + "select user_id, faction, count(*) battles from seats where faction is not null group by 1, 2")
def faction_counters(s, d):
    return R.faction_counters(_seats(s, d))


SPREAD = """, f as (select user_id, count(*) filter (where faction = 'faction_1') b1, count(*) filter (where faction = 'faction_2') b2 from seats where faction is not null group by 1),
u as (select board.*, case when battles <> 0 and coalesce(b1, 0) / battles >= 0.65 then 'faction_1' when battles <> 0 and coalesce(b2, 0) / battles >= 0.65 then 'faction_2' else 'mixed' end main_faction
      from board left join f using (user_id) where battles >= {n} and last_session >= {t})
"""


@query(CTE + SPREAD.format(n=10, t=1357000000000) + "select main_faction, mmr - mmr % 100 bucket, count(*) users, sum(mmr)::bigint sum_mmr from u group by 1, 2")
def mmr_spread(s, d):
    return R.spread(_board(s, d), R.faction_counters(_seats(s, d)), "mmr", 100, 10, 1357000000000)


@query(CTE + SPREAD.format(n=1, t=0) + "select main_faction, battles - battles % 20 bucket, count(*) users, sum(mmr)::bigint sum_mmr from u group by 1, 2")
def battle_spread(s, d):
    return R.spread(_board(s, d), R.faction_counters(_seats(s, d)), "battles", 20, 1, 0)


@query(CTE + SPREAD.format(n=0, t=0) + """, c as (select distinct user_id, 'country_' || (user_id % 9) country from registrations where user_id is not null)
select main_faction, country, mmr - mmr % 200 bucket, count(*) users, sum(mmr)::bigint sum_mmr from u join c using (user_id) group by 1, 2, 3""")
def country_spread(s, d):
    country = table(s, d, "registrations").where(F.col("user_id").isNotNull()).select("user_id", F.concat(F.lit("country_"), (F.col("user_id") % 9).cast("string")).alias("country")).distinct()
    return R.spread(_board(s, d), R.faction_counters(_seats(s, d)), "mmr", 200, 0, 0, country)


@query(CTE + """, reg as (select user_id, max(registered_time) r from registrations where user_id is not null group by 1)
select faction, count(*) seats, count(*) filter (where r is not null and commit_time - r > 0 and commit_time - r < 86400000) newbies
from seats left join reg using (user_id) where faction in ('faction_1', 'faction_2') group by 1""")
def newbie_counters(s, d):
    return R.newbies(_seats(s, d), table(s, d, "registrations")).groupBy("faction").agg(F.count("*").alias("seats"), F.count_if("newbie").alias("newbies"))


@query(CTE + """, x as (select mission, case when disbalance_1 then 'team_1_unbalanced' when disbalance_2 then 'team_2_unbalanced' else 'balanced' end balance_group,
  case when won1 then 'team_1_win' else 'team_2_win' end win_group from balance join (select distinct session_id_str session_id, mission from session_mission where mission is not null) using (session_id))
select mission, balance_group, win_group, count(*) cross_count, (sum(count(*)) over (partition by mission, balance_group))::bigint balance_count,
  (sum(count(*)) over (partition by mission, win_group))::bigint win_count, (sum(count(*)) over (partition by mission))::bigint games, (sum(count(*)) over ())::bigint session_dau
from x group by 1, 2, 3""")
def mission_winrate(s, d):
    m = table(s, d, "session_mission").where(F.col("mission").isNotNull()).select(F.col("session_id_str").alias("session_id"), "mission").distinct()
    return R.mission_winrate(_balance(s, d), m)


@query("""with x as (select event_id, value - 50 v from events where value is not null)
select event_id, round(case when v < 0 then -1 else 1 end * 2.5 * pow(abs(v), 1.3) + 1, 4) sqr_pow, round(3 * atan(v) + 0.5, 4) atan_pow, round(2 * asin(v / 1000) + 0.25, 4) asin_pow,
  round(0.5 * pow(v, 3) + 2, 4) cub_func, round(greatest(v, 0), 4) max_0, case when v = event_id or event_id < 1e-8 then 1.0 else round(v / event_id, 4) end ratio,
  round(1.0 / (1 + exp(-0.01 * (v - 5))) + 0.5, 4) sig from x""")
def math_curves(s, d):
    x = table(s, d, "events").where(F.col("value").isNotNull()).select("event_id", (F.col("value") - 50).alias("v"))
    v, r = F.col("v"), lambda c: F.round(c, 4)
    return x.select(
        "event_id", r(num.sign_power(v, 1.3, 2.5, 1.0)).alias("sqr_pow"), r(num.arctan_curve(v, 3.0, 0.5)).alias("atan_pow"), r(num.arcsin_curve(v / 1000, 2.0, 0.25)).alias("asin_pow"),
        r(num.power_curve(v, 3.0, 0.5, 2.0)).alias("cub_func"), r(F.greatest(v, F.lit(0.0))).alias("max_0"), r(num.ratio_or_one(v, F.col("event_id"))).alias("ratio"), r(num.sigmoid(v, 0.01, 5.0, 1.0, 0.5)).alias("sig"))


OPP = """, ok as (select session_id, faction, mmr, max(mmr) over (partition by session_id, faction) t from rated where mmr_type = 'MMR'),
wt as (select *, case when mmr < 1e-8 then 1.0 else -n / (1 + exp(-1.5 * n * (mmr / nullif(t, 0)::double - 0.5))) + n + 1 end k from (select *, case when t < 1e-6 then t::double else 0.99 * t / nullif(mmr, 0)::double end n from ok)),
mx as (select *, max(mmr * k) over (partition by session_id, faction) m from wt),
opp as (select session_id, faction, case when count(*) > 2 then trunc(sum(case when m < 1e-7 then 1.0 else t::double / m * (mmr * k) end) / count(*))::bigint end opp from mx group by 1, 2)
"""


@query(CTE + OPP + "select session_id, faction, opp from opp")
def opponent_avg(s, d):
    return R.opponent_mean(R.rated_seats(_seats(s, d), _board(s, d)))


@query(CTE + OPP + """, y as (
  select r.*, n1, n2, total_score, case when r.faction = 'faction_1' then won1 else won2 end w, o.opp,
         coalesce(trunc(1600.0 * (n1 + n2) / nullif(total_score, 0)::double * score), 0)::bigint score_norm
  from rated r join gate using (session_id) join top using (session_id)
  left join opp o on o.session_id = r.session_id and o.faction = case when r.faction = 'faction_1' then 'faction_2' else 'faction_1' end),
z as (select *, (case when score_norm = 0 then 0 else trunc(50 / exp(1e6 / pow(score_norm, 2))) end)::bigint - case when w then 0 else 66 end + case when quit then -20 else 0 end + case when top20 then 20 else 0 end base,
  case when mmr_type = 'MMR' then (coalesce(opp, mmr) - mmr) * case when w then 1 else -1 end else 0 end gap from y),
q as (select *, case when abs(gap) < 250 then 0 else 2 / (1 + exp(-0.001 * gap)) - 1 end mul from z)
select session_id, user_id, faction, mmr, mmr_type, score_norm, opp, (case when w then greatest(trunc(base + mul * 35.0), 0) else trunc(base - mul * 35.0) end)::bigint delta from q""")
def v1_delta_snapshot(s, d):
    return R.v1_snapshot(_seats(s, d), _board(s, d), _modes(s, d))


V2 = """, m as (select r.* from rated r semi join gate using (session_id)),
a as (select *, pow(sqrt(2.0), least(0, battles - 6)) k, greatest(score + case when won then score // 4 else 0 end + case when top20 then score // 4 else 0 end - case when quit then score // 2 else 0 end, 0) adj_score from m),
b as (select *, sum(mmr * k) over (partition by session_id) / sum(k) over (partition by session_id) avg_mmr from a),
c as (select *, 1 - 1 / (1 + exp(-0.01 * (mmr - 500.0))) + 0.2 * (1 - k) give, 0.05 / (1 + exp(-0.01 * (mmr - 9500.0))) get_,
  0.5 / (8 * pow(case when avg_mmr = mmr or mmr < 1e-8 then 1 else avg_mmr / nullif(mmr, 0) end, 0.35) + 1) dec_, 0.5 / (4 * (case when avg_mmr = mmr or avg_mmr < 1e-8 then 1 else mmr / nullif(avg_mmr, 0) end) + 1) inc from b),
e as (select *, sum((dec_ + get_) * mmr * k + give * greatest(avg_mmr, 500) - get_ * mmr) over (partition by session_id) pool, sum(inc / k * adj_score) over (partition by session_id) norm from c),
g as (select *, case when norm * k = 0 then null else pool * adj_score * inc / (norm * k) end gain, mmr * (dec_ + get_) / k loss from e)
"""


@query(CTE + V2 + "select session_id, user_id, round(k, 6) k, adj_score, round(avg_mmr, 3) avg_mmr, round(give, 4) give, round(get_, 4) get, round(dec_, 4) dec, round(inc, 4) inc, round(pool, 2) pool from e")
def v2_coefficients(s, d):
    x = R.v2_coefficients(_seats(s, d), _board(s, d), _modes(s, d))
    r = lambda c, n: F.round(c, n).alias(c)
    return x.select("session_id", "user_id", r("k", 6), "adj_score", r("avg_mmr", 3), r("give", 4), r("get", 4), r("dec", 4), r("inc", 4), r("pool", 2))


@query(CTE + V2 + """select session_id, user_id, mmr, round(k, 6) k, adj_score, round(gain, 3) gain, round(loss, 3) loss, coalesce(trunc(gain - loss), 0)::bigint delta,
greatest(mmr + coalesce(trunc(gain - loss), 0)::bigint, 0) new_mmr from g""")
def v2_delta_snapshot(s, d):
    return R.v2_snapshot(_seats(s, d), _board(s, d), _modes(s, d))


KNN_SQL = """, idx as (select user_id, battle_score // battles s, mmr from board where battles > 5), ask as (select user_id, battle_score // battles s from board where battles between 1 and 6),
n as (select a.user_id, a.s, count(*) neighbours, sum(i.mmr) t, min(row(abs(a.s - i.s), i.s, i.user_id, i.mmr)) c from ask a join idx i on i.s between a.s - 50 and a.s + 50 group by 1, 2)
select a.user_id, a.s, coalesce(neighbours, 0) neighbours, case when (select count(*) from idx) >= 100 and neighbours > 0 then case when neighbours >= 10 then (t // neighbours)::bigint else trunc(c[4] * 0.8)::bigint end end first_mmr
from ask a left join n using (user_id, s)"""


@query(CTE + KNN_SQL)
def knn_bootstrap(s, d):
    b = _board(s, d).withColumn("s", num.int_div(F.col("battle_score"), F.col("battles")))
    return R.knn_bootstrap(b.where("battles between 1 and 6").select("user_id", "s"), b.where("battles > 5").select("user_id", "s", "mmr"), least_index=100)


@query("""with x as (select row_id, session_id v, case when lag(row_id) over (order by row_id) is null or session_id is distinct from lag(session_id) over (order by row_id) then 1 else 0 end c from battle_rows),
y as (select *, sum(c) over (order by row_id) g from x) select min(row_id) "first", max(row_id) "last", any_value(v) "value", count(*) "rows" from y group by g""")
def session_islands(s, d):
    return R.session_islands(table(s, d, "battle_rows"), "row_id", "session_id")


@query()
def v1_exact(s, d):
    from tidemark.operators.exact import rate_exact

    return rate_exact(_seats(s, d), _board(s, d), _modes(s, d), "v1")


# The sessions of the fold in order, with their members by user.
FOLD = CTE.replace("with seats", "with recursive seats", 1) + """, ses as (
  select session_id, (select min(commit_time) from seats a where a.session_id = g.session_id) at_, any_value(total_score) total_score,
    list({'u': user_id, 'score': score, 'won': won, 'quit': quit, 'top20': top20, 'faction': faction} order by user_id) m
  from gate g join seats s using (session_id) where faction in ('faction_1', 'faction_2') group by session_id),
ord as materialized (select *, row_number() over (order by at_, session_id) n from ses)
"""


# The board is a map user -> (mmr, battles) that one step per session reads and replaces.
@query(FOLD + """, r as (
  select 0::bigint n, map_from_entries(list({'k': user_id, 'v': {'mmr': mmr, 'battles': battles}})) b, 0::bigint session_id, 0::bigint at_, []::struct(u bigint, delta bigint, mmr bigint, battles bigint)[] c from board
  where user_id in (select unnest(m).u from ses)
  union all
  select n, map_from_entries(list_filter(map_entries(b), lambda e: not list_contains(ids, e.key)) || list_transform(c, lambda e: {'key': e.u, 'value': {'mmr': e.mmr, 'battles': e.battles}})), session_id, at_, c
  from (
    select n, b, session_id, at_, list_transform(l, lambda e: e.u) ids, list_transform(list_transform(l, lambda e: {'u': e.u, 'mm': e.mm, 'bt': e.bt,
        'd': coalesce(case when norm <> 0 then greatest(least(trunc(pool * e.adj * e.inc / (norm * e.k) - e.m * (e.dec_ + e.get_) / e.k), 2147483647), -2147483648) end, 0)::bigint}),
      lambda e: {'u': e.u, 'delta': e.d, 'mmr': greatest(e.mm + e.d, 0), 'battles': e.bt + 1}) c
    from (
      select *, list_sum(list_transform(l, lambda e: (e.dec_ + e.get_) * e.m * e.k + e.give * greatest(avg_mmr, 500) - e.get_ * e.m)) pool, list_sum(list_transform(l, lambda e: e.inc / e.k * e.adj)) norm
      from (
        select * exclude (l), list_transform(l, lambda e: {'u': e.u, 'mm': e.mm, 'bt': e.bt, 'm': e.m, 'k': e.k, 'adj': e.adj, 'give': 1 - 1 / (1 + exp(-0.01 * (e.m - 500.0))) + 0.2 * (1 - e.k), 'get_': 0.05 / (1 + exp(-0.01 * (e.m - 9500.0))),
          'dec_': 0.5 / (8 * pow(case when avg_mmr = e.m or e.m < 1e-8 then 1 else avg_mmr / e.m end, 0.35) + 1), 'inc': 0.5 / (4 * (case when avg_mmr = e.m or avg_mmr < 1e-8 then 1 else e.m / avg_mmr end) + 1)}) l
        from (
          select *, list_sum(list_transform(l, lambda e: e.m * e.k)) / list_sum(list_transform(l, lambda e: e.k)) avg_mmr
          from (
            select o.n, r.b, o.session_id, o.at_, list_transform(list_transform(o.m, lambda e: {'e': e, 'mm': coalesce(r.b[e.u].mmr, 0), 'bt': coalesce(r.b[e.u].battles, 0)}), lambda x: {'u': x.e.u, 'mm': x.mm, 'bt': x.bt, 'm': x.mm::double,
              'k': pow(sqrt(2.0), least(0, x.bt - 6)), 'adj': greatest(x.e.score + case when x.e.won then x.e.score // 4 else 0 end + case when x.e.top20 then x.e.score // 4 else 0 end - case when x.e.quit then x.e.score // 2 else 0 end, 0)}) l
            from r join ord o on o.n = r.n + 1))))))
select session_id, c.u user_id, at_ as "at", c.delta delta, c.mmr mmr, c.battles battles from (select session_id, at_, unnest(c) c from r)""")
def v2_exact(s, d):
    from tidemark.operators.exact import rate_exact

    # By session from the start: cleaning, counting and the fold's components then need no exchange of all seats.
    seats = R.clean_seats(table(s, d, "battle_rows").repartition(slots(s), "session_id"))
    return rate_exact(seats, _board(s, d), _modes(s, d), "v2")


@query()
def v2_slices(s, d):
    """The board after weekly slices of the pool variant."""
    from tidemark.operators.exact import rate_slices, slice_edges

    seats = _seats(s, d)
    return rate_slices(seats, _board(s, d), _modes(s, d), "v2", slice_edges(seats, 1_356_998_400_000, 7 * 86_400_000))
