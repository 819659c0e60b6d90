"""Row-level scans of the rating stream's text files and the rows that go back into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.lines import hex_id, kv_entries, number

FLAGS = ("victories", "early_quit", "team_score_top_20_percent")


def _kv(lines: DataFrame, line: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return lines.select(*keep, kv_entries(F.col(line)).alias("kv"))


def _text(key: str) -> Column:
    return F.try_element_at("kv", F.lit(key))


def stored_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stored battle rows: decimal session id, flags true only for 1, missing team and score 0.

    Rows without user, session, time or faction drop."""
    return _kv(lines, line).select(
        *[_text(c).try_cast("bigint").alias(c) for c in ("user_id", "session_id", "commit_time")], number(F.col("kv"), "team").cast("tinyint").alias("team"), number(F.col("kv"), "battle_score").alias("battle_score"),
        *[(number(F.col("kv"), c) == 1).alias(c) for c in FLAGS], _text("faction").alias("faction"),
    ).dropna(subset=["user_id", "session_id", "commit_time", "faction"])


def user_team(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """(user_id, session_id, team, victory): teams other than 1 and 2 drop, a victory key means true whatever its value,
    the last line (by ``order``) of a key wins."""
    kv = _kv(lines, line, (order,))
    rows = kv.select(order, _text("user_id").try_cast("bigint").alias("user_id"), _text("session_id").try_cast("bigint").alias("session_id"), _text("team").alias("team"), _text("victory").isNotNull().alias("victory"))
    ok = rows.where(F.col("team").isin("1", "2")).dropna(subset=["user_id", "session_id"])
    return ok.groupBy("user_id", "session_id").agg(F.max_by(F.struct(F.col("team").cast("tinyint").alias("team"), "victory"), order).alias("v")).select("user_id", "session_id", "v.*")


def user_faction(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """(user_id, session_id DECIMAL(20,0), mode): hexadecimal sessions, a missing mode is 'mixed', the last line wins.

    A line without either key drops."""
    kv = _kv(lines, line, (order,))
    rows = kv.select(order, _text("user_id").try_cast("bigint").alias("user_id"), hex_id(_text("session_id")).alias("session_id"), F.coalesce(_text("mode"), F.lit("mixed")).alias("mode"))
    return rows.dropna(subset=["user_id", "session_id"]).groupBy("user_id", "session_id").agg(F.max_by("mode", order).alias("mode"))


def class_lines(balance: DataFrame) -> DataFrame:
    """``session_id:..,team_1:..,team_2:..,team_1_v:..,team_2_v:..`` of every rated session."""
    names = (("team_1", "disbalance_1"), ("team_2", "disbalance_2"), ("team_1_v", "won1"), ("team_2_v", "won2"))
    return balance.select(F.concat_ws(",", F.concat(F.lit("session_id:"), F.col("session_id").cast("string")), *[F.concat(F.lit(f"{n}:"), F.col(c).cast("string")) for n, c in names]).alias("line"))


def session_classes(lines: DataFrame, line: str = "line") -> DataFrame:
    """(session_id, balance_group, win_group) of classification lines."""
    yes = lambda k: F.coalesce(_text(k) == "true", F.lit(False))
    group = F.when(yes("team_1"), "team_1_unbalanced").when(yes("team_2"), "team_2_unbalanced").otherwise("balanced")
    return _kv(lines, line).select(_text("session_id").try_cast("bigint").alias("session_id"), group.alias("balance_group"), F.when(yes("team_1_v"), "team_1_win").otherwise("team_2_win").alias("win_group")).where("session_id is not null")


def counters(lines: DataFrame, line: str = "line") -> DataFrame:
    """(user_id, faction, battles) of counter lines; a line without one of the three drops."""
    return _kv(lines, line).select(_text("user_id").try_cast("bigint").alias("user_id"), _text("faction").alias("faction"), _text("battles").try_cast("bigint").alias("battles")).dropna()


def score_index(board: DataFrame, least: int = 6) -> DataFrame:
    """(s, user_id, mmr) of calibrated users: what the first rating of others is looked up in."""
    return board.where(F.col("battles") >= least).select(F.floor(F.col("battle_score") / F.col("battles")).alias("s"), "user_id", "mmr")


def payments(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id, revenue, special) of JSON rows user_id, revenue (missing: 0) and player_type (boolean or text)."""
    m = lines.select(F.from_json(line, "map<string,string>").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select(get("user_id").try_cast("bigint").alias("id"), F.coalesce(get("revenue").try_cast("double"), F.lit(0.0)).alias("revenue"), F.coalesce(F.lower(get("player_type")) == "true", F.lit(False)).alias("special")).where("id is not null")


def statistics_lines(stats: DataFrame, board: str = "board") -> DataFrame:
    """``<board>__<counter>:<value>;``, one line per counter."""
    names = [c for c in stats.columns if c != board]
    entry = F.explode(F.array(*[F.concat(F.col(board), F.lit(f"__{n}:"), F.col(n).cast("string"), F.lit(";")) for n in names]))
    return stats.select(entry.alias("line"))


def spread_lines(spread: DataFrame, board: str) -> DataFrame:
    """``<board>__top_3_disbalance_spread:{"bucket":[rate,wins,total],...};`` of the re-bucketed spread, by bucket."""
    cell = F.concat(F.lit('"'), F.col("bucket").cast("string"), F.lit('":['), (F.col("wins") / F.col("total")).cast("string"), F.lit(","), F.col("wins").cast("string"), F.lit(","), F.col("total").cast("string"), F.lit("],"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", cell.alias("t")))), lambda e: e["t"]), "")
    return spread.agg(F.concat(F.lit(f"{board}__top_3_disbalance_spread:{{"), text, F.lit("};")).alias("line"))


def opponents(rated: DataFrame) -> DataFrame:
    """(session_id, faction, opponents): ratings of the other side, largest first, 0 where provisional, joined by '+'.

    One array per side of a session: a session's members bound it."""
    from tidemark.operators.ratings import SIDES

    r = F.when(F.col("mmr_type") == "MMR", F.col("mmr")).otherwise(F.lit(0))
    other = F.when(F.col("faction") == SIDES[0], SIDES[1]).otherwise(SIDES[0])
    return rated.groupBy("session_id", other.alias("faction")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(r), asc=False), lambda x: x.cast("string")), "+").alias("opponents"))


def change_lines(changes: DataFrame, sides: DataFrame) -> DataFrame:
    """``{u:user,dm:change,m:rating,o:opponents,bs:score}`` of every change (session_id, user_id, faction, mmr, delta, score_norm)."""
    j = changes.join(sides, ["session_id", "faction"], "left")
    part = lambda k, c: F.concat(F.lit(f"{k}:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    body = F.concat_ws(",", part("u", "user_id"), part("dm", "delta"), part("m", "mmr"), part("o", "opponents"), part("bs", "score_norm"))
    return j.select("session_id", "user_id", F.concat(F.lit("{"), body, F.lit("}")).alias("line"))


def make_board(spark: SparkSession, players: list[tuple[int, int, int]]) -> DataFrame:
    """A small leaderboard of (user, mmr, battles) for trying things out; scores are 1600 a battle."""
    rows = spark.createDataFrame(players, "user_id long, mmr long, battles long")
    zero = F.lit(0).cast("long")
    return rows.select("user_id", "battles", "mmr", zero.alias("victories"), zero.alias("early_quites"), zero.alias("top_20"), (F.col("battles") * 1600).alias("battle_score"), zero.alias("last_session"))


def make_session(spark: SparkSession, session_id: int, players: list[tuple]) -> DataFrame:
    """Battle rows of one session from (user, team, score, victory, top_20, early_quit, faction)."""
    rows = spark.createDataFrame(players, "user_id long, team tinyint, battle_score long, victories boolean, team_score_top_20_percent boolean, early_quit boolean, faction string")
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "user_id", F.lit(session_id).cast("long").alias("session_id"), F.lit(0).cast("long").alias("commit_time"), "team", "battle_score", "victories", "early_quit", "team_score_top_20_percent", "faction", F.lit(None).cast("timestamp_ntz").alias("ingest_time"))
