"""Whole runs with the parameters of the modelled command lines: rating, catch processing, process monitor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, exact, ratings
from tidemark.operators import catches as C
from tidemark.sources import lines as L
from tidemark.sources import records
from tidemark.streaming import jobs


@dataclass(frozen=True)
class RatingPaths:
    """Text files of one rating run; ``leaderboard`` may be None for a first run."""

    data: str
    user_team: str
    session_mode: str
    user_faction: str
    leaderboard: str | None = None


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a number that rises along the files, so that the last of equal keys is known."""
    return spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumnRenamed("value", "line")


def read_battles(spark: SparkSession, paths: RatingPaths) -> DataFrame:
    """Battle rows of the data file with victories, factions and teams looked up; rows without a faction drop."""
    kv = L.kv_entries(F.col("line"))
    raw = _numbered(spark, paths.data).select("n", kv.alias("kv"))
    text = lambda k: F.try_element_at("kv", F.lit(k))
    rows = raw.select(
        F.col("n").alias("row_id"), text("user_id").try_cast("bigint").alias("user_id"), L.hex_id(text("session_id")).alias("_s"), text("commit_time").try_cast("bigint").alias("commit_time"), L.number(F.col("kv"), "battle_score").alias("battle_score"),
        (L.number(F.col("kv"), "early_quit") == 1).alias("early_quit"), (L.number(F.col("kv"), "team_score_top_20_percent") == 1).alias("team_score_top_20_percent"), text("faction").alias("faction"),
    ).dropna(subset=["user_id", "_s", "commit_time"])
    team = records.user_team(_numbered(spark, paths.user_team), "n").select("user_id", F.col("session_id").cast("decimal(20,0)").alias("_s"), "victory")
    faction = records.user_faction(_numbered(spark, paths.user_faction), "n").select("user_id", F.col("session_id").alias("_s"), F.col("mode").alias("_f"))
    j = rows.join(team, ["user_id", "_s"], "left").join(faction, ["user_id", "_s"], "left").withColumn("faction", F.coalesce("_f", "faction")).where("faction is not null")
    side = F.when(F.col("faction") == "faction_2", 2).otherwise(1).cast("tinyint")
    # Sessions are bit patterns of 64 bits: beyond the largest LONG they continue with negative numbers.
    session = F.when(F.col("_s") > F.lit(2**63 - 1).cast("decimal(20,0)"), F.col("_s") - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("_s")).cast("bigint")
    return j.select("row_id", "user_id", session.alias("session_id"), "commit_time", side.alias("team"), "battle_score", F.coalesce("victory", F.lit(False)).alias("victories"), "early_quit", "team_score_top_20_percent", "faction", F.lit(None).cast("timestamp_ntz").alias("ingest_time"))


def rate_sessions(spark: SparkSession, paths: RatingPaths, variant: str = "v1", edges: list[int] | None = None) -> DataFrame:
    """Change log of the exact fold, or with ``edges`` (ms) the board after slices of the distributed form."""
    seats = ratings.clean_seats(read_battles(spark, paths))
    kv = _numbered(spark, paths.session_mode).select("n", L.kv_entries(F.col("line")).alias("kv"))
    modes = ratings.clean_modes(kv.select(L.number(F.col("kv"), "session_id", None).alias("session_id"), F.coalesce(F.try_element_at("kv", F.lit("mode")), F.lit("")).alias("mode"), F.col("n").alias("opened_time")))
    if paths.leaderboard:
        board = ratings.clean_board(L.leaderboard_lines(spark.read.text(paths.leaderboard), "value"))
    else:
        board = records.make_board(spark, [(-1, 0, 0)]).limit(0)
    return exact.rate_slices(seats, board, modes, variant, edges) if edges else exact.rate_exact(seats, board, modes, variant)


def catch_pipeline(
    texts: DataFrame, config: dict, devices: DataFrame, multipliers: DataFrame, stats: DataFrame, test: str, map_name: str, point: str, use_device: bool = True,
) -> DataFrame:
    """Recognised texts (name, text) of one folder to catch rows.

    texts: file name with its time, and the text that a provider read from the image. config: species -> (tags,
    primary tags). devices (t, code) are the device switches in force, multipliers (device, rig_mul, light_mul) by code,
    stats (name, long, total, n) the known length buckets. A text without a species or a readable (mass, length)
    line drops out; of several lines the one that fits the species best is taken."""
    named = texts.withColumn("at", C.file_time(F.col("name"))).withColumnRenamed("name", "file")
    species = C.best_entity(named, "file", "at", "text", config).select("file", F.col("entity").alias("name"))
    lines = C.mass_length_lines(named.select("file", "text"), "file", "text").withColumnRenamed("length", "long")
    fitted = C.validate(lines.join(species, "file"), stats, "name", "long", "mass", "lm")
    best = C.best_candidate(fitted, ["file"], "lm_err", "line").join(named.select("file", "at"), "file")
    out = best.select("file", "name", "mass", "long", "at", F.lit(test).alias("test"), F.lit(map_name).alias("map"), F.lit(point).alias("point"), C.label(F.col("lm_mark"), F.col("lm_err")).alias("mark"))
    if not use_device:
        return out.withColumn("device", F.lit(None).cast("string"))
    with_code = asof.last_before(out, "at", devices, "t", "code", F.lit("1"))
    return with_code.join(multipliers, with_code["code"] == multipliers["device"], "left").drop("code")


def monitor(spark: SparkSession, name: str, path: str, checkpoint: str, interval: str = "1 second"):
    """Samples the machine's processes of a name every ``interval`` and appends them as text; returns the running query."""
    from tidemark.sources.processes import ProcessSource

    spark.dataSource.register(ProcessSource)
    return jobs.monitor_csv(spark.readStream.format("processes").option("name", name).load(), path, checkpoint, interval)
