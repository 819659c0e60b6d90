"""Queries p1, p6, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import distinct, leakage, mixing, ranking, splitting
from tidemark.operators.seats import last_seats
from tidemark.session import table


def p1_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "battle_rows")
    games = ranking.contests(last_seats(rows, ["team", "victories"]), "session_id", "user_id", "team", "victories")
    return ranking.rank_items(games, rows.select(F.col("user_id").alias("item"))).withColumnRenamed("item", "user_id")


def p1_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons won and lost by every ranked user, as the ranking counts them in its blocks."""
    return p1_ranking(spark, sf).select("user_id", "wins", "losses")


def _keys():
    day = F.to_date(F.timestamp_millis(F.col("commit_time")))
    faction = F.lower(F.btrim(F.col("faction")))
    return ("day", day), ("faction", F.when(faction != "", faction))


def _ids():
    return {n: F.col(n) for n in ("user_id", "session_id")}


def p6_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The matrices per day, faction and combination, with the counts estimated from them and their bounds."""
    return distinct.distinct_counts(table(spark, sf, "battle_rows"), *_keys(), _ids())


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts alone, one row per group."""
    return distinct.group_counts(table(spark, sf, "battle_rows"), *_keys(), _ids())


def p6_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable partial results of one pass: matrix rows per day and faction."""
    return distinct.sketch_rows(table(spark, sf, "battle_rows"), dict(_keys()), _ids())


def p6_within(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts of every group beside whether they lie within five standard errors (a chance of 1 in 1.7 million each)."""
    a, b = _keys()
    rows = table(spark, sf, "battle_rows")
    wide = distinct.group_counts(rows, a, b, _ids(), z=5.0)
    ids = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("id")) for n, c in _ids().items()])).alias("i")
    keys = rows.select(a[1].alias("day"), b[1].alias("faction"), ids).where("i.id is not null")
    null = lambda t: F.lit(None).cast(t)
    levels = F.explode(F.array(F.struct(F.lit("day,faction").alias("level"), "day", "faction"), F.struct(F.lit("day").alias("level"), "day", null("string").alias("faction")), F.struct(F.lit("faction").alias("level"), null("date").alias("day"), "faction"))).alias("l")
    exact = keys.select(levels, "i.*").select("l.*", "field", "id").distinct().groupBy("level", "day", "faction", "field").agg(F.count("*").alias("exact"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("level", "day", "faction", "field")]
    return exact.alias("e").join(wide.alias("w"), same).select("e.*", F.col("exact").between(F.col("lower"), F.col("upper")).alias("within"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the number of documents that hold a passage of each."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mix(spark: SparkSession, sf: str):
    sized = mixing.sizes(table(spark, sf, "documents"), "doc_id", "text", "source")
    return mixing.mix(sized, table(spark, sf, "mix_targets"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p8_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every target source keeps its cap and takes the tokens that its share of the budget asks for, to half a document."""
    sized = mixing.sizes(table(spark, sf, "documents"), "doc_id", "text", "source")
    shares = mixing.mix(sized, table(spark, sf, "mix_targets"))[1]
    longest = sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    off = F.abs(F.col("tokens") - F.col("asked_tokens"))
    return shares.join(longest, "source", "left").select(
        "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("in_cap"), (off <= F.coalesce("longest", F.lit(0)) / 2 + 1e-6).alias("on_share"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf, "documents"), "doc_id", "text")


def p9_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Of every text: length, and whether its pieces (if it has any) are within the limit, tile it and end as numbered."""
    rules = splitting.SplitRules()
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length("text").cast("long").alias("chars"))
    p = splitting.split_documents(table(spark, sf, "documents"), "doc_id", "text", rules)
    own = p.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("pieces").alias("pieces"), F.max("tokens").alias("most"), F.sum(F.col("end_char") - F.col("own_start_char")).alias("own"), F.max("end_char").alias("end"),
        F.min("own_start_char").alias("start"), F.countDistinct("piece").alias("places"), F.bool_and(F.length("text") == F.col("end_char") - F.col("start_char")).alias("cut_right"))
    tiled = (F.col("own") == F.col("chars")) & (F.col("end") == F.col("chars")) & (F.col("start") == 0) & (F.col("n") == F.col("pieces")) & (F.col("places") == F.col("n")) & F.col("cut_right")
    return docs.join(own, "doc_id", "left").select("doc_id", "chars", F.coalesce(F.col("most") <= rules.limit, F.lit(True)).alias("in_limit"), F.coalesce(tiled, F.lit(True)).alias("tiled"))


QUERIES = {f.__name__: f for f in (p1_ranking, p1_tallies, p6_distinct, p6_counts, p6_sketches, p6_within, p7_found, p7_report, p8_mixture, p8_shares, p8_within, p9_pieces, p9_tiling)}

#: Fixed values of the 64-bit xxHash: its five primes.
_PRIME = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_M = "18446744073709551616::uhugeint"


def _xx64(x: str) -> str:
    """SQL for xxHash64 (seed 42) of a BIGINT as UHUGEINT, over the CTE chain that starts at relation ``src``."""
    mul = lambda v, k: f"(({v}) * {_PRIME[k - 1]}::uhugeint) % {_M}"
    rot = lambda v, n: f"((({v}) * {1 << n}::uhugeint) % {_M} + ({v}) // {1 << 64 - n}::uhugeint)"
    return f"""h1 as (select *, {mul(f"case when {x} < 0 then ({x}::hugeint + 18446744073709551616)::uhugeint else {x}::uhugeint end", 2)} t from src),
h2 as (select *, {mul(rot("t", 31), 1)} t2 from h1),
h3 as (select *, xor({42 + _PRIME[4] + 8}::uhugeint % {_M}, t2) t3 from h2),
h4 as (select *, ({mul(rot("t3", 27), 1)} + {_PRIME[3]}::uhugeint) % {_M} t4 from h3),
h5 as (select *, {mul("xor(t4, t4 // 8589934592::uhugeint)", 2)} t5 from h4),
h6 as (select *, {mul("xor(t5, t5 // 536870912::uhugeint)", 3)} t6 from h5),
hashed as (select * exclude (t, t2, t3, t4, t5, t6), xor(t6, t6 // 4294967296::uhugeint) h from h6)"""


_P6 = """with r as (select (timestamp '1970-01-01' + to_milliseconds(commit_time))::date "day", nullif(lower(trim(faction)), '') faction, user_id, session_id from battle_rows),
i as (select "day", faction, 'user_id' field, user_id id from r where user_id is not null union all select "day", faction, 'session_id', session_id from r where session_id is not null)"""
# The lowest set bit of the 53-bit rest of the hash; no set bit counts as rank 52.
_P6_BITS = _P6 + ", src as (select distinct * from i), " + _xx64("id") + """,
b as (select "day", faction, field, (h % 2048)::int bucket, (h // 2048)::bigint rest from hashed)
select "day", faction, field, bucket, bit_or(case when rest = 0 then 1::bigint << 52 else rest & -rest end) bits from b group by all"""
_LEVELS = """select 'day,faction' "level", "day", faction, {c} from x union all select 'day', "day", null, {c} from x union all select 'faction', null, faction, {c} from x"""

ORACLE: dict[str, str] = {
    "p1_tallies": """with s as (select user_id, session_id, team, victories from battle_rows where user_id is not null and session_id is not null
  qualify row_number() over (partition by user_id, session_id order by ingest_time desc nulls last, row_id desc) = 1),
t as (select * from s where team in (1, 2)),
r as (select session_id, sum(case when victories then 1 when not victories then -1 else 0 end * case when team = 1 then 1 else -1 end) vote from t group by 1
  having vote <> 0 and count(*) filter (where team = 1) > 0 and count(*) filter (where team = 2) > 0),
w as (select user_id, (team = 1) = (vote > 0) won from t join r using (session_id))
select user_id, count(*) filter (where won) wins, count(*) filter (where not won) losses from (select distinct user_id from battle_rows where user_id is not null) left join w using (user_id) group by 1""",
    "p8_within": "select source, true in_cap, true on_share from mix_targets",
    "p9_tiling": "select doc_id, length(text) chars, true in_limit, true tiled from documents where text is not null",
    "p6_sketches": _P6_BITS,
    "p6_within": _P6 + ", x as (select distinct * from i), l as (" + _LEVELS.format(c="field, id") + """) select "level", "day", faction, field, count(distinct id) exact, true as "within" from l group by all""",
}
