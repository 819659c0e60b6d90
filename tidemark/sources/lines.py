"""Sources: lenient key:value lines, delimited logs, JSON series, small config documents."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def kv_entries(line: Column) -> Column:
    """MAP of a ``{"k":v,...}`` line: braces and quotes go, entries split at ',', only exact pairs count, no
    trimming, the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(line, '[{}"]', ""), ",", -1), lambda e: F.split(e, ":", -1)), lambda p: F.size(p) == 2)
    keys = F.array_distinct(F.transform(parts, lambda p: p[0]))
    last = lambda k: F.element_at(F.filter(parts, lambda p: p[0] == k), -1)[1]
    return F.map_from_arrays(keys, F.transform(keys, last))


def number(kv: Column, key: str, default: int | None = 0) -> Column:
    v = F.try_element_at(kv, F.lit(key)).try_cast("bigint")
    return v if default is None else F.coalesce(v, F.lit(default))


def leaderboard_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Leaderboard snapshot rows; missing or unreadable numbers are 0, rows without user_id drop."""
    kv = lines.select(kv_entries(F.col(line)).alias("kv"))
    names = ("mmr", "battles", "victories", "early_quites", "top_20", "battle_score", "last_session")
    return kv.select(number(F.col("kv"), "user_id", None).alias("user_id"), *[number(F.col("kv"), n).alias(n) for n in names]).where("user_id is not null")


def hex_id(x: Column) -> Column:
    """Session id from hexadecimal text as DECIMAL(20,0); null if it is not 1 to 16 hexadecimal digits."""
    return F.when(x.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(x, 16, 10)).cast("decimal(20,0)")


def enrich_battles(rows: DataFrame, user_team: DataFrame, user_faction: DataFrame) -> DataFrame:
    """Victory from (user, session) -> victory (default false), faction override, team 2 iff faction_2."""
    keys = ["user_id", "session_id"]
    j = rows.join(user_team.withColumnRenamed("victory", "_v"), keys, "left").join(user_faction.withColumnRenamed("faction", "_f"), keys, "left")
    faction = F.coalesce("_f", "faction")
    return j.where(faction.isNotNull()).select(*keys, "commit_time", F.coalesce("_v", F.lit(False)).alias("victories"), faction.alias("faction"), F.when(faction == "faction_2", 2).otherwise(1).cast("byte").alias("team"))


def series_json(spark: SparkSession, path: str, x: str, y: str, key: str) -> DataFrame:
    """(id LONG, x LONG, y DOUBLE) from a JSON array with caller-named fields, numbers or numeric text; the last row wins."""
    if ".json" not in path:
        raise ValueError("a .json path is expected")
    raw = spark.read.schema(f"`{key}` string, `{x}` string, `{y}` string").json(path, multiLine=True)
    n = raw.select(F.col(key).try_cast("bigint").alias("id"), F.col(x).try_cast("bigint").alias("x"), F.col(y).try_cast("double").alias("y"), F.monotonically_increasing_id().alias("_n"))
    return n.dropna(subset=["id", "x"]).groupBy("id", "x").agg(F.max_by("y", "_n").alias("y"))


CATCH_SCHEMA = (
    "mark string, timestamp string, fish_name string, mass bigint, long bigint, test string, map string, point string, exp bigint, exp_l bigint, exp_happy bigint, "
    "exp_prem bigint, exp_sum bigint, exp_drink bigint, long_mass_mark string, long_mass_err string, mass_exp_mark string, mass_exp_err string, device string, exp_real bigint"
)


def catch_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=CATCH_SCHEMA)


def control_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ordered event set: (timestamp LONG, key STRING) without repeats."""
    return spark.read.csv(path, sep=";", header=True, schema="timestamp bigint, key string").distinct()


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(stem, suffix) of the files of a folder by extension; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("n"))
    return f.select(F.regexp_replace("n", f"\\.{suffix}$", "").alias("stem"), F.lit(suffix).alias("suffix"))


def read_config(path: str) -> dict:
    """Config document with the derived unions of all tags."""
    c = json.loads(Path(path).read_text())
    c["tags"] = sorted({t for f in c.get("fishes", {}).values() for t in f.get("tags", [])})
    c["exp_tags"] = sorted({t for e in c.get("exp_types", {}).values() for t in e.get("tags", [])})
    return c


def bucket_json(spark: SparkSession, text: str) -> DataFrame:
    """(key, total, n) of a JSON map key -> [total, n]."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "map<string,array<bigint>>").alias("m"))
    return one.select(F.explode("m").alias("k", "v")).select(F.col("k").cast("bigint").alias("key"), F.col("v")[0].alias("total"), F.col("v")[1].alias("n"))


def read_regression(path: str) -> list[float]:
    """Coefficients of a JSON array of numbers."""
    return [float(x) for x in json.loads(Path(path).read_text())]


def key_events(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """(timestamp, key) of ``timestamp;key`` lines whose key is on the whitelist; works on streams as well."""
    p = F.split(F.col(line), ";")
    return lines.select(F.get(p, F.lit(0)).try_cast("bigint").alias("timestamp"), F.get(p, F.lit(1)).alias("key")).where(F.col("timestamp").isNotNull() & F.col("key").isin(*keys))


def parse_hms(text: str) -> int:
    """Seconds of H:M:S with unbounded hours; minutes and seconds below 60."""
    m = re.fullmatch(r"(\d+):(\d+):(\d+)", text)
    if not m or int(m[2]) >= 60 or int(m[3]) >= 60:
        raise ValueError(f"not a time: {text}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])


_RON = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<s>"(?:[^"\\]|\\.)*")|(?P<n>-?\d+(?:\.\d+)?)|(?P<w>[A-Za-z_]\w*)|(?P<p>[()\[\]{}:,])', re.S)


def parse_ron(text: str):
    """A small reader of RON: structs and maps become dicts, tuples and arrays lists, enums (name, args)."""
    toks, at = [], 0
    while at < len(text):
        m = _RON.match(text, at)
        if not m:
            raise ValueError(f"unreadable at {at}")
        at = m.end()
        if m.lastgroup:
            toks.append((m.lastgroup, m[m.lastgroup]))
    pos = 0

    def peek(k: int = 0):
        return toks[pos + k][1] if pos + k < len(toks) else None

    def value():
        nonlocal pos
        kind, v = toks[pos]
        pos += 1
        if kind == "s":
            return json.loads(v)
        if kind == "n":
            return float(v) if "." in v else int(v)
        if kind == "w":
            if v in ("true", "false"):
                return v == "true"
            return (v, group(")")) if peek() == "(" and step() else v
        if v in "([{":
            return group({"(": ")", "[": "]", "{": "}"}[v])
        raise ValueError(f"unexpected {v}")

    def step():
        nonlocal pos
        pos += 1
        return True

    def group(end: str):
        items, pairs = [], {}
        while peek() != end:
            if toks[pos][0] in "ws" and peek(1) == ":":
                k = value()
                step()
                pairs[k] = value()
            else:
                v = value()
                if peek() == ":":
                    step()
                    pairs[json.dumps(v) if isinstance(v, list) else v] = value()
                else:
                    items.append(v)
            if peek() == ",":
                step()
        step()
        return pairs or items

    return value()
