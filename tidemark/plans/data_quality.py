"""Queries p2 to p5: rejected lines, orphan references, entity features, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, orphans, rejects, spikes
from tidemark.operators.seats import last_seats
from tidemark.session import table

FEEDS = {"raw_battle_lines": rejects.BATTLE_FORMAT, "raw_leaderboard_lines": rejects.LEADERBOARD_FORMAT}
METRICS = ["battles", "since", "battle_score", "early_quit", "top_20"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for feed, fmt in FEEDS.items():
        bad = rejects.split_records(table(spark, sf, feed), fmt)[1].select(F.lit(feed).alias("feed"), "line_id")
        out = bad if out is None else out.unionByName(bad)
    return out


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines per feed, file and reason."""
    out = None
    for feed, fmt in FEEDS.items():
        lines = table(spark, sf, feed)
        bad = rejects.split_records(lines, fmt, key=("line_id", "file_name"))[1]
        bad = bad.select(F.lit(feed).alias("feed"), "file_name", F.explode("reasons").alias("reason"))
        out = bad if out is None else out.unionByName(bad)
    return out.groupBy("feed", "file_name", "reason").agg(F.count("*").alias("lines"))


def p2_battle_records(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.split_records(table(spark, sf, "raw_battle_lines"), rejects.BATTLE_FORMAT)[0]


def p2_leaderboard_records(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.split_records(table(spark, sf, "raw_leaderboard_lines"), rejects.LEADERBOARD_FORMAT)[0]


def _folded(c: str):
    x = F.lower(F.btrim(F.col(c)))
    return F.when(x != "", x)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    links = [
        orphans.Link("user_id", F.col("user_id"), table(spark, sf, "registrations"), F.col("user_id"), "registered_time", "deleted_time"),
        orphans.Link("session_id", F.col("session_id"), table(spark, sf, "session_mode"), F.col("session_id"), "opened_time", "removed_time"),
        orphans.Link("faction", _folded("faction"), table(spark, sf, "factions"), _folded("faction"), "opened_time", "closed_time"),
    ]
    return orphans.orphans(table(spark, sf, "battle_rows"), "row_id", "commit_time", links).withColumnRenamed("id", "row_id")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per referenced field and day of commit_time."""
    return orphans.orphan_report(table(spark, sf, "battle_rows"), p3_found(spark, sf), "row_id", "commit_time")


SEAT_COLUMNS = ["commit_time", "battle_score", "early_quit", "team_score_top_20_percent"]


def feature_events(spark: SparkSession, sf: str, kinds: list[str] | None = None) -> DataFrame:
    """Battles (last record per user and session) with their mission, or its place in ``kinds``.

    Users whose rows name no session keep a row without one. The join of the sessions' missions is left to the
    planner, which broadcasts them only where their measured size is small."""
    rows = table(spark, sf, "battle_rows")
    missions = table(spark, sf, "session_mission").where(F.col("mission").isNotNull() & F.col("session_id_str").isNotNull()).select(F.col("session_id_str").alias("session_id"), "mission").distinct()
    if kinds is not None:
        missions = features.numbered(missions, "mission", kinds)
    loose = rows.where(F.col("user_id").isNotNull() & F.col("session_id").isNull()).select("user_id").distinct()
    return last_seats(rows, SEAT_COLUMNS).join(missions, "session_id", "left").unionByName(loose, allowMissingColumns=True)


def _long(spark: SparkSession, sf: str, kinds: list[str] | None = None) -> DataFrame:
    now = table(spark, sf, "battle_rows").agg(F.max("commit_time")).scalar()
    flag = lambda c: F.col(c).cast("long")
    return features.feature_long(
        feature_events(spark, sf, kinds), "user_id", "mission", "commit_time",
        {"battle_score": F.col("battle_score"), "early_quit": flag("early_quit"), "top_20": flag("team_score_top_20_percent")}, now)


def mission_list(spark: SparkSession, sf: str) -> list[str]:
    """The missions on record, sorted: the type list of the wide query, which a caller may replace by its own.

    One name per mission (240 in the tables, each five columns), so what is collected is as long as the result is wide."""
    return sorted(r[0] for r in table(spark, sf, "session_mission").where(F.col("mission").isNotNull()).select("mission").distinct().collect())


def p4_features(spark: SparkSession, sf: str, kinds: list[str] | None = None) -> DataFrame:
    kinds = mission_list(spark, sf) if kinds is None else kinds
    long = _long(spark, sf, kinds)
    return features.feature_table(long.withColumn("mission", F.coalesce("mission", F.lit(-1))), "user_id", "mission", kinds, METRICS)


def p4_features_long(spark: SparkSession, sf: str) -> DataFrame:
    """The compact long table behind the features, for the missions that occur."""
    return _long(spark, sf).where(F.col("mission").isNotNull())


def p4_feature_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The features as one map column, for type lists of any length: entries as text in order of the mission."""
    maps = features.feature_maps(_long(spark, sf), "user_id", "mission", METRICS)
    text = lambda e: F.concat_ws(":", e["key"], *[e["value"][m].cast("string") for m in METRICS])
    return maps.select("user_id", F.size("features").alias("missions"), F.array_join(F.transform(F.array_sort(F.map_entries("features")), text), ";").alias("features"))


READINGS = ("long", "mass", "exp_sum")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(table(spark, sf, "catches"), "catch_id", "name", "ts", READINGS)


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.clean_readings(table(spark, sf, "catches"), "catch_id", "name", "ts", READINGS)


def p5_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every caught reading with the rule that caught it and, for spikes, the ratio to its species' curve."""
    return spikes.judged(_readings(spark, sf), names=READINGS).withColumnRenamed("id", "catch_id")


def p5_frozen(spark: SparkSession, sf: str) -> DataFrame:
    """Stuck and impossible readings, and the length of the run for the stuck ones."""
    r = spikes.run_lengths(_readings(spark, sf)).select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"x{i}").alias("v"), F.col(f"n{i}").alias("run")) for i, n in enumerate(READINGS)])).alias("f")).select(F.col("id").alias("catch_id"), "f.*")
    return r.where((F.col("run") >= spikes.SpikeRules.stuck) | (F.col("v") <= 0)).select("catch_id", "field", F.col("v").alias("value"), "run")


def p5_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted curves and cutoffs per species."""
    return spikes.source_curves(_readings(spark, sf), spikes.SpikeRules())


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p2_battle_records, p2_leaderboard_records, p3_found, p3_report, p4_features, p4_features_long, p4_feature_maps, p5_found, p5_rules, p5_frozen, p5_curves)}


def _dangling(field: str, key: str, parent: str, parent_key: str, start: str, end: str) -> str:
    return (f"select row_id, '{field}' field, (timestamp '1970-01-01' + to_milliseconds(commit_time))::date \"day\" from battle_rows b where {key} is not null and not exists "
            f"(select 1 from {parent} p where {parent_key} = {key} and p.{start} <= b.commit_time and (p.{end} is null or b.commit_time < p.{end}))")


_P3 = " union all ".join([
    _dangling("user_id", "b.user_id", "registrations", "p.user_id", "registered_time", "deleted_time"),
    _dangling("session_id", "b.session_id", "session_mode", "p.session_id", "opened_time", "removed_time"),
    _dangling("faction", "nullif(lower(trim(b.faction)), '')", "factions", "lower(trim(p.faction))", "opened_time", "closed_time"),
])
_NUM = "regexp_full_match({v}, '[0-9]+') and length(ltrim({v}, '0')) <= 20 and try_cast('0' || {v} as hugeint) between {lo} and {hi}"
_FIELD = '("(?:[^"]|"")*"|[^";]*)'
_P2_CELLS = f"""with x as (select line_id, file_name, regexp_replace(regexp_replace(line, '^\ufeff', ''), '\\r\\z', '') b, regexp_extract(b, '\\A{";".join([_FIELD] * 10)}\\z', ['f0', 'f1', 'f2', 'f3', 'f4', 'f5', 'f6', 'f7', 'f8', 'f9']) s from raw_battle_lines),
v as (select line_id, file_name, b, {", ".join(f"case when s.f{i}[1] = chr(34) then replace(s.f{i}[2:-2], repeat(chr(34), 2), chr(34)) else trim(s.f{i}, ' ' || chr(9)) end v{i}" for i in range(10))} from x)"""
_INT = (("v0", 1, 2**63 - 1), ("v2", 1262304000000, 1735689599999), ("v3", 1, 2))
_P2_VALID = f"""coalesce({" and ".join("(" + _NUM.format(v=v, lo=a, hi=b) + ")" for v, a, b in _INT)} and regexp_full_match(v1, '[0-9a-fA-F]{{1,16}}') and (v4 = '' or {_NUM.format(v="v4", lo=0, hi=2**32 - 1)})
  and v5 in ('', '0', '1') and v6 in ('', '0', '1') and v7 in ('', '0', '1') and v8 <> '', false)"""
_P2_BATTLE = f"{_P2_CELLS} select 'raw_battle_lines' feed, line_id from v where not {_P2_VALID}"
_P2_RECORDS = f"""{_P2_CELLS} select line_id, v0::bigint user_id, ('0x' || v1)::ubigint::decimal(20,0) session_id, v2::bigint commit_time, v3::tinyint team, nullif(v4, '')::bigint battle_score,
  {", ".join(f"case v{i} when '1' then true when '0' then false end {n}" for i, n in ((5, "victories"), (6, "early_quit"), (7, "team_score_top_20_percent")))}, v8 faction, v9 remark from v where {_P2_VALID}"""


def _why(v: str, name: str, lo: int | None = None, hi: int | None = None, rule: str | None = None, empty: bool = False) -> str:
    """Reason of one cell as SQL, null where it is valid."""
    tests = f"when not regexp_full_match({v}, '[0-9]+') then '{name}: not a number' when not coalesce({_NUM.format(v=v, lo=lo, hi=hi)}, false) then '{name}: out of range'" if rule is None else rule.format(v=v, name=name)
    return f"case when {v} = '' then {'null' if empty else f"'{name}: empty'"} {tests} end"


_FLAG = "when {v} not in ('0', '1') then '{name}: not a flag'"
_BATTLE_WHY = [
    _why("v0", "user_id", 1, 2**63 - 1), _why("v1", "session_id", rule="when not regexp_full_match({v}, '[0-9a-fA-F]{{1,16}}') then '{name}: not 1 to 16 hexadecimal digits'"), _why("v2", "commit_time", 1262304000000, 1735689599999), _why("v3", "team", 1, 2),
    _why("v4", "battle_score", 0, 2**32 - 1, empty=True), *[_why(f"v{i}", n, rule=_FLAG, empty=True) for i, n in ((5, "victories"), (6, "early_quit"), (7, "team_score_top_20_percent"))], _why("v8", "faction", rule=""),
]
# A quoted stretch stands for itself as one mark, so that fields can be counted and text beside quotes shows.
_P2_BATTLE_WHY = f"""{_P2_CELLS}, q as (select *, string_split(regexp_replace(b, '"[^"]*"', chr(1), 'g'), ';') f from v),
w as (select file_name, case when b is null then ['line is null'] when (length(b) - length(replace(b, chr(34), ''))) % 2 = 1 then ['unclosed quote']
  when len(list_filter(f, lambda z: contains(z, chr(1)) and not regexp_full_match(z, '\\x01+'))) > 0 then ['text beside quotes'] when len(f) <> 10 then ['expected 10 fields, found ' || len(f)]
  else list_filter([{", ".join(_BATTLE_WHY)}], lambda z: z is not null) end r from q)
select 'raw_battle_lines' feed, file_name, unnest(r) reason from w"""
_BARE = "regexp_replace(trim({v}, ' ' || chr(9)), '\\A\"((?s:.*))\"\\z', '\\1')"
_BOARD_INTS = ("mmr", "battles", "victories", "early_quites", "top_20", "battle_score")
_P2_PAIRS = f"""with t as (select line_id, file_name, trim(line, ' ' || chr(9) || chr(13)) t from raw_leaderboard_lines),
e as (select *, starts_with(t, '{{') a, ends_with(t, '}}') b, case when starts_with(t, '{{') and ends_with(t, '}}') and length(t) > 1 then t[2:-2] else t end i from t),
p as (select *, list_transform(string_split(i, ','), lambda q: string_split(q, ':')) q from e),
k as (select *, list_transform(q, lambda z: {_BARE.format(v="z[1]")}) ks, list_transform(q, lambda z: {_BARE.format(v="z[2]")}) vs from p)"""
_P2_BOARD_VALID = f"""coalesce((a = b) and (not a or length(t) > 1) and len(list_filter(q, lambda z: len(z) <> 2)) = 0 and len(list_distinct(ks)) = len(ks) and list_contains(ks, 'user_id')
  and len(list_filter(list_zip(ks, vs), lambda z: not coalesce(case when z[1] = 'user_id' then {_NUM.format(v="z[2]", lo=1, hi=2**63 - 1)} when z[1] = 'last_session' then {_NUM.format(v="z[2]", lo=0, hi=2**63 - 1)}
    when z[1] in {_BOARD_INTS} then {_NUM.format(v="z[2]", lo=0, hi=2**32 - 1)} end, false))) = 0, false)"""
_P2_BOARD = f"{_P2_PAIRS} select 'raw_leaderboard_lines' feed, line_id from k where not {_P2_BOARD_VALID}"
_P2_BOARD_RECORDS = f"{_P2_PAIRS} select line_id, " + ", ".join(f"vs[list_position(ks, '{n}')]::bigint {n}" for n in ("user_id", *_BOARD_INTS, "last_session")) + f" from k where {_P2_BOARD_VALID}"
_KEY_WHY = "case when z[2] = '' then z[1] || ': empty' when not regexp_full_match(z[2], '[0-9]+') then z[1] || ': not a number' when not coalesce(case z[1] " + " ".join(
    f"when '{n}' then {_NUM.format(v='z[2]', lo=lo, hi=hi)}" for n, lo, hi in (("user_id", 1, 2**63 - 1), ("last_session", 0, 2**63 - 1), *((n, 0, 2**32 - 1) for n in _BOARD_INTS))) + " end, false) then z[1] || ': out of range' end"
_P2_BOARD_WHY = f"""{_P2_PAIRS}, w as (select file_name, case when t is null then ['line is null'] when (a or b) and not (a and b and length(t) > 1) then ['unbalanced braces']
  when len(list_filter(q, lambda z: len(z) <> 2)) > 0 then ['entry without exactly one colon'] when len(list_filter(ks, lambda z: z not in {("user_id", *_BOARD_INTS, "last_session")})) > 0 then ['unknown key']
  when len(list_distinct(ks)) <> len(ks) then ['repeated key'] when not list_contains(ks, 'user_id') then ['required key missing']
  else list_filter(list_transform(list_zip(ks, vs), lambda z: {_KEY_WHY}), lambda z: z is not null) end r from k)
select 'raw_leaderboard_lines' feed, file_name, unnest(r) reason from w"""
_P4 = """with s as (select user_id, session_id, commit_time, battle_score, early_quit, team_score_top_20_percent t from battle_rows where user_id is not null and session_id is not null
  qualify row_number() over (partition by user_id, session_id order by ingest_time desc nulls last, row_id desc) = 1),
m as (select distinct session_id_str session_id, mission from session_mission where mission is not null and session_id_str is not null),
l as (select user_id, mission, count(*) battles, (select max(commit_time) from battle_rows) - max(commit_time) since, coalesce(sum(battle_score), 0)::bigint battle_score,
  coalesce(sum(early_quit::int), 0)::bigint early_quit, coalesce(sum(t::int), 0)::bigint top_20 from s join m using (session_id) group by 1, 2)"""

ORACLE = {
    "p2_found": f"select * from ({_P2_BATTLE}) union all select * from ({_P2_BOARD})",
    "p2_reasons": f"select feed, file_name, reason, count(*) lines from (select * from ({_P2_BATTLE_WHY}) union all select * from ({_P2_BOARD_WHY})) group by all",
    "p2_battle_records": _P2_RECORDS,
    "p2_leaderboard_records": _P2_BOARD_RECORDS,
    "p3_found": f"select row_id, field from ({_P3})",
    "p3_report": f"select field, \"day\", count(*) orphans from ({_P3}) group by 1, 2",
    "p5_frozen": """with c as (select catch_id, min(lower(trim("name"))) src, min(ts) tm, min(long) long, min(mass) mass, min(exp_sum) exp_sum from catches where "name" is not null and catch_id is not null group by 1),
v as (select catch_id, src, tm, field, value from (unpivot c on long, mass, exp_sum into name field value value)),
l as (select *, (value is distinct from lag(value) over (partition by src, field order by tm, catch_id))::int fresh from v),
r as (select *, sum(fresh) over (partition by src, field order by tm, catch_id) k from l), n as (select *, count(*) over (partition by src, field, k) run from r)
select catch_id, field, value, run from n where run >= 6 or value <= 0""",
    "p4_features_long": _P4 + " select * from l",
    "p4_feature_maps": _P4 + """ select user_id, count(mission)::int missions, coalesce(string_agg(concat_ws(':', mission, battles, since, battle_score, early_quit, top_20), ';' order by mission), '') features
  from (select distinct user_id from battle_rows where user_id is not null) left join l using (user_id) group by 1""",
    # The pivot finds its columns by a statement of its own, so everything it reads stands inside it.
    "p4_features": "select user_id, coalesce(columns('.*_(battles|battle_score|early_quit|top_20)$'), 0) as '\\0', columns('.*_since$') from (pivot (" + _P4 + """
  select user_id, mission, battles, since, battle_score, early_quit, top_20 from l
  union all (select user_id, (select min(mission) from session_mission), null, null, null, null, null from battle_rows where user_id is not null)
  union all (select null, mission, null, null, null, null, null from session_mission where mission is not null)
) on mission using max(battles) battles, max(since) since, max(battle_score) battle_score, max(early_quit) early_quit, max(top_20) top_20 group by user_id) where user_id is not null""",
}
