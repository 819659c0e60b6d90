"""Catch log: bucket statistics, validation against them, EXP arithmetic, point reports, text matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators.asof import two_before


def clean_catches(rows: DataFrame) -> DataFrame:
    """One row per catch_id (the same catch is logged again with equal values), species folded."""
    cols = [c for c in rows.columns if c not in ("catch_id", "logged_at")]
    r = rows.where(F.col("catch_id").isNotNull()).withColumn("name", F.lower(F.btrim("name")))
    return r.groupBy("catch_id").agg(F.min(F.struct(*cols)).alias("r")).select("catch_id", "r.*")


def bucket_stats(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, key, total, n): sums and counts per exact key; partial tables merge by adding both columns."""
    ok = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull())
    return ok.groupBy(group, key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = [c for c in new.columns if c not in ("total", "n")]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def validate(rows: DataFrame, stats: DataFrame, group: str, key: str, value: str, prefix: str) -> DataFrame:
    """Adds <prefix>_mark and <prefix>_err: ``value`` against the line through the two largest buckets <= key.

    Equal key: |value - mean| within 5 % of the mean is FullAccuracy, else FullyNotSure; without a second
    bucket (or one at 0) NotEnoughData with null error; else the same test on the truncated line, clamped at 0."""
    means = stats.withColumn("_v", num.int_div(F.col("total"), F.col("n")))
    near = two_before(rows, group, key, means, group, key, "_v")
    x, y = F.col(key).cast("double"), F.col(value).cast("double")
    v0, v1, k0, k1 = (F.col(c).cast("double") for c in ("v0", "v1", "k0", "k1"))
    a = F.try_divide(v0 - v1, k0 - k1)
    line = num.sat_int(a * x + (v1 - a * k1), 0, 2**62).cast("double")
    known, exact = F.col("k0").isNotNull(), F.col("k0") == F.col(key)
    enough = known & (exact | (F.coalesce("k1", F.lit(0)) != 0))
    guess = F.when(exact, v0).otherwise(line)
    err = F.when(enough & y.isNotNull(), F.abs(y - guess))
    mark = F.when(F.col(key).isNull() | y.isNull(), F.lit(None).cast("string")).when(~enough | ~known, "NotEnoughData").when(F.coalesce(F.try_divide(err, guess) <= 0.05, F.lit(False)), "FullAccuracy").otherwise("FullyNotSure")
    out = rows.join(near, [group, key], "left").withColumn(f"{prefix}_mark", mark).withColumn(f"{prefix}_err", err)
    return out.select(*rows.columns, f"{prefix}_mark", f"{prefix}_err")


def label(mark: Column, err: Column) -> Column:
    """Mark with its error at two decimals, empty without one."""
    return F.concat_ws(":", mark, F.when(err.isNotNull(), F.format_string("%.2f", err)))


def exp_recompute(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """EXP columns from the observed exp_real and the device's multipliers (device, rig_mul, light_mul)."""
    c = F.col("exp_real") / F.col("rig_mul")
    on = lambda name, v: F.when(F.coalesce(F.col(name), F.lit(0)) > 0, v).otherwise(F.lit(0.0))
    light, happy, prem, drink = on("exp_l", c * F.col("light_mul")), on("exp_happy", c * 2.0), on("exp_prem", c), on("exp_drink", c)
    whole = lambda v, n: F.round(v).cast("long").alias(n)
    return rows.join(devices, "device").select("catch_id", "device", whole(c, "exp"), whole(light, "exp_l"), whole(happy, "exp_happy"), whole(prem, "exp_prem"), whole(c + drink + happy + light + prem, "exp_sum"), whole(drink, "exp_drink"))


def exp_repair(rows: DataFrame, device: str, with_device: tuple[float, float] = (1.82, 0.25), without: tuple[float, float] = (1.25, 0.0)) -> DataFrame:
    """One-off repair: (rig, light) multipliers by device; the sum takes the already divided, rounded drink."""
    mine = F.coalesce(F.col("device") == device, F.lit(False))
    rig, light = (F.when(mine, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(with_device, without))
    c, near = F.col("exp") / rig, lambda v: F.floor(v + 0.5)
    happy = F.when(F.col("exp_happy") > 0, 2.0).otherwise(0.0)
    prem = F.when(F.col("exp_prem") > 0, 1.0).otherwise(0.0)
    drink = near(F.coalesce("exp_drink", F.lit(0)) / rig)
    return rows.select("catch_id", F.col("exp").alias("exp_real"), near(c).alias("exp"), near(c * light).alias("exp_l"), near(c * happy).alias("exp_happy"), near(c * prem).alias("exp_prem"), drink.alias("exp_drink"), near(c + c * light + drink + c * happy + c * prem).alias("exp_sum"))


def bonus_rebuild(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Bonuses from the base EXP by which of them were seen: light by the device, twice, once, drink as observed."""
    j = rows.where(F.col("exp").isNotNull()).join(devices, "device")
    base = F.col("exp").cast("double")
    seen = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, v).otherwise(F.lit(0.0))
    light, happy, prem, drink = seen("exp_l", F.col("light_mul") * base), seen("exp_happy", base * 2.0), seen("exp_prem", base), F.coalesce("exp_drink", F.lit(0))
    whole = lambda v, n: F.round(v).cast("long").alias(n)
    return j.select("catch_id", F.col("exp").alias("base"), whole(light, "l_bonus"), whole(happy, "happy_bonus"), whole(prem, "prem_bonus"), drink.alias("drink_bonus"),
                    whole(base + happy + light + prem + drink, "all_exp"), whole(base * F.col("rig_mul"), "real_exp"))


def device_repair(rows: DataFrame, lit: str, plain: str) -> DataFrame:
    """One-off repair: the device by whether the light bonus was given."""
    return rows.withColumn("device", F.when(F.coalesce(F.col("exp_l"), F.lit(0)) > 0, lit).otherwise(plain))


def device_chain(coded: DataFrame, presets: DataFrame, rigs: DataFrame, muls: DataFrame) -> DataFrame:
    """Device code -> preset -> rig -> multiplier; small dimensions that the planner broadcasts by their size."""
    return coded.join(presets, "code").join(rigs, "preset").join(muls, "rig")


def best_candidate(rows: DataFrame, keys: list[str], error: str, order: str) -> DataFrame:
    """The row of each key with the least validation error; rows without one come last, ties go to the first by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col(error).isNull(), F.coalesce(error, F.lit(0.0)), order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def point_summary(rows: DataFrame, maps: list[str] | None = None) -> DataFrame:
    """Per (species, point, map, test): average mass, catches, and their share of all attempts there."""
    r = rows if maps is None else rows.where(F.col("map_name").isin(maps))
    place = ["map_name", "point", "test"]
    r = r.where(F.col("name").isNotNull()).dropna(subset=place)
    attempts = r.groupBy(*place).agg(F.count("*").alias("attempts"))
    g = r.groupBy("name", *place).agg(F.sum("mass").alias("sum_mass"), F.avg("mass").alias("avg_mass"), F.count("*").alias("catches"))
    return g.join(attempts, place).withColumn("point_rate", F.col("catches") / F.col("attempts"))


NUMBER = "[-+]?\\d*\\.?\\d+"


def numbers(text: Column) -> Column:
    """Unsigned integers of a text; what parses as signed or decimal is dropped as a whole."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.when(x.rlike("^\\+?[0-9]+$"), x).try_cast("bigint")), lambda x: x.isNotNull())


def mass_length_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, mass, length) of every line but the first with two or more numbers, dots removed."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_t")).where("line > 0")
    n = lines.select(key, "line", numbers(F.replace(F.col("_t"), F.lit("."), F.lit(""))).alias("n")).where(F.size("n") >= 2)
    return n.select(key, "line", F.col("n")[0].alias("mass"), F.col("n")[1].alias("length"))


def window_distances(text: str, tags: list[str]) -> np.ndarray:
    """Least edit distance of each tag to any window of its length; -1 where the text is shorter.

    One table per tag is filled for all windows at once, so the cost is tag length squared array operations."""
    chars = np.frombuffer(text.replace("\n", " ").encode("utf-32-le"), np.uint32)
    out = np.full(len(tags), -1, np.int64)
    for t, tag in enumerate(tags):
        m = len(tag)
        if m == 0 or len(chars) < m:
            continue
        win = np.lib.stride_tricks.sliding_window_view(chars, m).T
        row = np.repeat(np.arange(m + 1, dtype=np.int32)[:, None], win.shape[1], 1)
        for i, c in enumerate(np.frombuffer(tag.encode("utf-32-le"), np.uint32)):
            nxt = np.empty_like(row)
            nxt[0] = i + 1
            for j in range(m):
                nxt[j + 1] = np.minimum(np.minimum(row[j + 1], nxt[j]) + 1, row[j] + (win[j] != c))
            row = nxt
        out[t] = row[m].min()
    return out


def best_entity(texts: DataFrame, key: str, order: str, text: str, config: dict[str, tuple[list[str], list[str]]], fits: float = 0.34) -> DataFrame:
    """Best (entity, score, primary) per key over its texts; config: entity -> (tags, primary tags), bounded.

    score = sum of tag distances / length of the name without blanks, entities whose primary tags all lie
    within ``fits`` come first, those with a failing primary tag drop out; of several texts the last decides a
    tag. Ties go to the smaller name. The text of a key must fit one row; distances leave as short arrays."""
    tags = sorted({t for a, b in config.values() for t in (*a, *b)})

    @F.pandas_udf("array<bigint>")
    def distances(s: pd.Series) -> pd.Series:
        return s.map(lambda t: window_distances(t.lower(), tags).tolist() if t else [-1] * len(tags))

    place = {t: i for i, t in enumerate(tags)}
    size = np.array([max(1, len(t)) for t in tags])

    def choose(d: pd.Series) -> pd.DataFrame:
        dist = np.stack(d.to_list()) if len(d) else np.zeros((0, len(tags)))
        missing = dist < 0
        far = missing | (dist / size > fits)
        cost = np.where(missing, 1e18, dist)
        n = len(d)
        entity, score, loose = np.full(n, None, object), np.full(n, np.inf), np.full(n, 2)
        for name, (own, primary) in sorted(config.items()):
            at, kind = [place[t] for t in own], 0 if primary else 1
            mine = cost[:, at].sum(1) / max(1, len(name.replace(" ", "")))
            better = ~far[:, [place[t] for t in primary]].any(1) & ((kind < loose) | ((kind == loose) & (mine < score)))
            entity[better], score[better], loose[better] = name, mine[better], kind
        known = loose < 2
        return pd.DataFrame({"entity": entity, "score": np.where(known, score, np.nan), "primary": pd.array(np.where(known, loose == 0, None), "boolean")})

    pick = F.pandas_udf(choose, "entity string, score double, primary boolean")
    d = texts.where(F.col(text).isNotNull()).select(key, order, distances(F.col(text)).alias("_d"))
    last = d.groupBy(key).agg(F.max_by("_d", F.struct(order)).alias("_d"))
    return last.select(key, pick("_d").alias("_b")).select(key, "_b.*").where("entity is not null")


def file_time(name: Column) -> Column:
    """Milliseconds of yyyyMMdd_HHmmss in a file name, two hours earlier (session time zone UTC)."""
    stamp = F.regexp_extract(name, "(\\d{8}_\\d{6})", 1)
    return F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))) - 7_200_000
