"""Catch-log and text-matching queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators import catches as C
from tidemark.sources import lines as L
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


CATCH = """with c as (select distinct catch_id, lower(trim(name)) "name", test, map_name, point, ts, mass, long, exp, exp_l, exp_happy, exp_prem, exp_sum, exp_drink, device, exp_real from catches where catch_id is not null)
"""
#: Fixed multipliers of the devices in the log: (device, rig, light).
DEVICES = [("rod_default", 1.0, 0.0), ("rod_light", 1.25, 0.25), ("spin_short", 1.1, 0.0), ("feeder_long", 1.82, 0.25)]


def _catches(s, d):
    return C.clean_catches(table(s, d, "catches"))


@query(CATCH + "select \"name\", long, sum(mass)::bigint total, count(*) n from c where \"name\" is not null and long is not null and mass is not null group by 1, 2")
def bucket_stats_long_mass(s, d):
    return C.bucket_stats(_catches(s, d), "name", "long", "mass")


@query(CATCH + "select \"name\", mass, sum(exp_sum)::bigint total, count(*) n from c where \"name\" is not null and mass is not null and exp_sum is not null group by 1, 2")
def bucket_stats(s, d):
    return C.bucket_stats(_catches(s, d), "name", "mass", "exp_sum")


@query(CATCH + "select \"name\", mass, sum(exp_sum)::bigint total, count(*) n from c where \"name\" is not null and mass is not null and exp_sum is not null group by 1, 2")
def bucket_stats_merged(s, d):
    """Stored partial statistics of the first weeks plus the newer catches: equal to one pass over all."""
    c = _catches(s, d)
    old = F.col("ts") < F.lit("2013-01-20").cast("timestamp_ntz")
    part = lambda w: C.bucket_stats(c.where(w), "name", "mass", "exp_sum")
    return C.merge_stats(part(old), part(~old))


def _validate_sql(k: str, v: str, p: str) -> str:
    return CATCH + f""", b as (select "name", {k} k, sum({v})::bigint // count(*) v from c where "name" is not null and {k} is not null and {v} is not null and ts < timestamp '2013-01-20' group by 1, 2),
b2 as (select *, lag(k) over (partition by "name" order by k) k1, lag(v) over (partition by "name" order by k) v1 from b),
p as (select catch_id, "name", {k}, {v} from c where ts >= timestamp '2013-01-20'),
j as (select p.*, k k0, v v0, k1, v1 from p asof left join b2 on p."name" = b2."name" and p.{k} >= b2.k),
g as (select *, k0 is not null and (k0 = {k} or coalesce(k1, 0) <> 0) enough,
  case when k0 = {k} then v0 else greatest(trunc((v0 - v1) / nullif(k0 - k1, 0) * {k} + (v1 - (v0 - v1) / nullif(k0 - k1, 0) * k1)), 0) end guess from j),
e as (select *, case when enough and {v} is not null then abs({v} - guess)::double end {p}_err from g)
select catch_id, "name", {k}, {v}, round({p}_err, 3) {p}_err, case when {k} is null or {v} is null then null when not enough then 'NotEnoughData' when coalesce({p}_err / nullif(guess, 0) <= 0.05, false) then 'FullAccuracy' else 'FullyNotSure' end {p}_mark from e"""


def _validated(s, d, k: str, v: str, p: str):
    c = _catches(s, d)
    old = F.col("ts") < F.lit("2013-01-20").cast("timestamp_ntz")
    stats = C.bucket_stats(c.where(old), "name", k, v)
    return C.validate(c.where(~old).select("catch_id", "name", k, v), stats, "name", k, v, p).select("catch_id", "name", k, v, F.round(f"{p}_err", 3).alias(f"{p}_err"), f"{p}_mark")


@query(_validate_sql("long", "mass", "lm"))
def validate_pairs(s, d):
    return _validated(s, d, "long", "mass", "lm")


@query(_validate_sql("mass", "exp_sum", "me"))
def validate_exp(s, d):
    return _validated(s, d, "mass", "exp_sum", "me")


_dev = " union all ".join(f"select '{a}' device, {b}::double rig_mul, {c}::double light_mul" for a, b, c in DEVICES)


@query(CATCH + f""", dv as ({_dev}), x as (select c.*, exp_real / rig_mul r, light_mul from c join dv using (device)),
y as (select *, case when coalesce(exp_l, 0) > 0 then r * light_mul else 0 end l, case when coalesce(exp_happy, 0) > 0 then r * 2 else 0 end h, case when coalesce(exp_prem, 0) > 0 then r else 0 end p, case when coalesce(exp_drink, 0) > 0 then r else 0 end k from x)
select catch_id, device, round(r)::bigint exp, round(l)::bigint exp_l, round(h)::bigint exp_happy, round(p)::bigint exp_prem, round(r + k + h + l + p)::bigint exp_sum, round(k)::bigint exp_drink from y""")
def exp_recompute(s, d):
    dev = s.createDataFrame(DEVICES, "device string, rig_mul double, light_mul double")
    return C.exp_recompute(_catches(s, d), F.broadcast(dev))


@query(CATCH + """, x as (select *, case when device = 'rod_light' then 1.82::double else 1.25::double end rig, case when device = 'rod_light' then 0.25::double else 0::double end light,
  case when exp_happy > 0 then 2 else 0 end h, case when exp_prem > 0 then 1 else 0 end p from c), y as (select *, exp / rig r, floor(coalesce(exp_drink, 0) / rig + 0.5)::bigint k from x)
select catch_id, exp exp_real, floor(r + 0.5)::bigint exp, floor(r * light + 0.5)::bigint exp_l, floor(r * h + 0.5)::bigint exp_happy, floor(r * p + 0.5)::bigint exp_prem, k exp_drink, floor(r + r * light + k + r * h + r * p + 0.5)::bigint exp_sum from y""")
def exp_repair(s, d):
    return C.exp_repair(_catches(s, d), "rod_light")


@query(CATCH + """, f as (select * from c where map_name in ('amber_lake', 'iron_brook', 'fern_pond') and "name" is not null and point is not null and test is not null),
a as (select map_name, point, test, count(*) attempts from f group by 1, 2, 3)
select "name", map_name, point, test, sum(mass)::bigint sum_mass, round(avg(mass), 4) avg_mass, count(*) catches, any_value(attempts) attempts, round(count(*) / any_value(attempts), 6) point_rate
from f join a using (map_name, point, test) group by 1, 2, 3, 4""")
def point_summary(s, d):
    return C.point_summary(_catches(s, d), ["amber_lake", "iron_brook", "fern_pond"]).withColumns({"avg_mass": F.round("avg_mass", 4), "point_rate": F.round("point_rate", 6)})


@query(CATCH + "select map_name, point, test, \"name\", count(*) catches, sum(mass)::bigint sum_mass, min(ts) first_ts, max(ts) last_ts from c where map_name in ('amber_lake', 'old_quarry') and ts >= timestamp '2013-01-10' group by 1, 2, 3, 4")
def merged_log(s, d):
    c = _catches(s, d).where(F.col("map_name").isin("amber_lake", "old_quarry") & (F.col("ts") >= F.lit("2013-01-10").cast("timestamp_ntz")))
    return c.groupBy("map_name", "point", "test", "name").agg(F.count("*").alias("catches"), F.sum("mass").alias("sum_mass"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""with e as (select epoch_us(ts) // 1000 t, max(case event_type when 'click' then '1' when 'view' then '2' else '3' end) code from events where event_type in ('click', 'view', 'purchase') group by 1),
p as (select event_id, epoch_us(ts) // 1000 t from events where event_type not in ('click', 'view', 'purchase'))
select event_id, p.t, coalesce(code, '1') code from p asof left join e on p.t > e.t""")
def device_asof(s, d):
    e = table(s, d, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    known = F.col("event_type").isin("click", "view", "purchase")
    code = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "2").otherwise("3")
    return asof.last_before(e.where(~known).select("event_id", "t"), "t", e.where(known).select("t", code.alias("code")), "t", "code", F.lit("1"))


@query("""with n as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[-+]?[0-9]*\\.?[0-9]+'), lambda x: case when regexp_full_match(x, '\\+?[0-9]+') then try_cast(x as bigint) end), lambda x: x is not null) v from documents where text is not null)
select doc_id, len(v) n, coalesce(list_sum(list_transform(v, lambda x: x::hugeint)), 0)::decimal(38,0) total from n""")
def number_extract(s, d):
    t = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", C.numbers(F.col("text")).alias("v"))
    return t.select("doc_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(20,0)")).cast("decimal(38,0)")).alias("total"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents where text is not null),
n as (select doc_id, line, list_filter(list_transform(regexp_extract_all(replace(t, '.', ''), '[-+]?[0-9]*\\.?[0-9]+'), lambda x: case when regexp_full_match(x, '\\+?[0-9]+') then try_cast(x as bigint) end), lambda x: x is not null) v from l where line > 0)
select doc_id, line, v[1] mass, v[2] length from n where len(v) >= 2""")
def mass_length_lines(s, d):
    return C.mass_length_lines(table(s, d, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@query("""select catch_id, (epoch_us(strptime(strftime(ts, '%Y%m%d_%H%M%S'), '%Y%m%d_%H%M%S')) // 1000 - 7200000) ms from (select distinct catch_id, ts from catches)""")
def filename_time(s, d):
    t = table(s, d, "catches").select("catch_id", "ts").distinct()
    return t.select("catch_id", C.file_time(F.concat(F.lit("shots/"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".png"))).alias("ms"))


def species_config(s, d) -> dict:
    """Entities with their words as tags and the last word as primary tag; the species list is bounded (48)."""
    names = [r[0] for r in table(s, d, "catches").where(F.col("name").isNotNull()).select(F.lower(F.btrim("name")).alias("n")).distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("the entity list is meant to be small")
    return {n: (n.split(), n.split()[-1:]) for n in names}


# The tags are ASCII words, so any other character stands for itself as one mark: SQL's distance counts bytes. Texts are cut
# into overlapping stretches, each window starting in exactly one of them.
@query("""with names as (select distinct lower(trim("name")) n from catches where "name" is not null),
tags as (select distinct unnest(string_split(n, ' ')) tag from names),
t as (select doc_id, regexp_replace(lower(replace(text, chr(10), ' ')), '[^\\x00-\\x7f]', chr(1), 'g') s from documents where text is not null and text <> ''),
c as (select doc_id, substr(s, (k + 1)::bigint, 1040) z from (select doc_id, s, unnest(range(0, length(s), 1000)) k from t)),
w as (select doc_id, tag, min(list_min(list_transform(range(1, least(1000, length(z) - length(tag) + 1) + 1), lambda i: levenshtein(substr(z, i, length(tag)), tag)))) d from c cross join tags group by 1, 2),
e as (select a.doc_id, n, coalesce(a.d, 1e18) + coalesce(b.d, 1e18) total, b.d last, length(string_split(n, ' ')[2]) size from names join w a on a.tag = string_split(n, ' ')[1] join w b on b.tag = string_split(n, ' ')[2] and a.doc_id = b.doc_id),
f as (select doc_id, n entity, total / length(replace(n, ' ', '')) score from e where last is not null and last / size <= 0.34)
select doc_id, arg_min(entity, row(score, entity)) entity, min(score) score, true "primary" from f group by 1""")
def fuzzy_best(s, d):
    """Best species of every document, by the edit distance of its words to all windows of the whole text."""
    t = table(s, d, "documents").select("doc_id", F.lit(0).alias("n"), "text")
    return C.best_entity(t, "doc_id", "n", "text", species_config(s, d))


KV = """with p as (select {k} id, list_filter(list_transform(string_split(regexp_replace({c}, '[{{}}"]', '', 'g'), ','), lambda e: string_split(e, ':')), lambda q: len(q) = 2) v from {t}),
u as (select id, unnest(v) q, generate_subscripts(v, 1) n from p)
"""


@query(KV.format(k="event_id", c="props", t="events") + "select id event_id, q[1] key, arg_max(q[2], n) value from u group by 1, 2")
def parse_kv_props(s, d):
    return table(s, d, "events").select("event_id", F.explode(L.kv_entries(F.col("props"))).alias("key", "value"))


_lb = ("mmr", "battles", "victories", "early_quites", "top_20", "battle_score", "last_session")


@query(KV.format(k="line_id", c="line", t="raw_leaderboard_lines") + ", w as (select id, q[1] k, arg_max(q[2], n) v from u group by 1, 2), z as (select id, max(try_cast(v as bigint)) filter (where k = 'user_id') user_id, "
       + ", ".join(f"coalesce(max(try_cast(v as bigint)) filter (where k = '{n}'), 0) {n}" for n in _lb) + " from w where regexp_full_match(trim(v, ' ' || chr(9) || chr(13)), '[-+]?[0-9]+') group by 1) select * exclude (id) from z where user_id is not null")
def leaderboard_scan(s, d):
    return L.leaderboard_lines(table(s, d, "raw_leaderboard_lines"))


@query("""with t as (select distinct user_id, session_id, true victory from battle_rows where victories and user_id is not null and session_id is not null),
f as (select user_id, session_id, max(case when team = 2 then 'faction_2' else 'faction_1' end) faction from battle_rows where early_quit and user_id is not null and session_id is not null group by 1, 2)
select b.user_id, b.session_id, commit_time, coalesce(t.victory, false) victories, coalesce(f.faction, b.faction) faction, (case when coalesce(f.faction, b.faction) = 'faction_2' then 2 else 1 end)::tinyint team
from battle_rows b left join t on b.user_id = t.user_id and b.session_id = t.session_id left join f on b.user_id = f.user_id and b.session_id = f.session_id where coalesce(f.faction, b.faction) is not null""")
def battle_scan_enriched(s, d):
    b = table(s, d, "battle_rows")
    ok = b.dropna(subset=["user_id", "session_id"])
    team = ok.where("victories").select("user_id", "session_id", F.lit(True).alias("victory")).distinct()
    fac = ok.where("early_quit").groupBy("user_id", "session_id").agg(F.max(F.when(F.col("team") == 2, "faction_2").otherwise("faction_1")).alias("faction"))
    return L.enrich_battles(b.select("user_id", "session_id", "commit_time", "faction"), team, fac)
