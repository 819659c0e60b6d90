"""Session-stream ratings: teams, balance statistics, both rating variants against a snapshot, spreads, missions.

All operators take ``seats`` (session_id, user_id, commit_time, score, won, quit, top20, faction: one row per
user and session, no nulls) and ``board`` (user_id, mmr, battles, ...: one row per user).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators.asof import before_last, before_max

SIDES = ("faction_1", "faction_2")
GAP = 800
NEWBIE_MS = 86_400_000
LEAST_PER_SIDE = 5


def clean_seats(rows: DataFrame) -> DataFrame:
    """The last record per user and session, missing score 0, missing flags false, faction folded."""
    v = F.struct("commit_time", "battle_score", "victories", "early_quit", "team_score_top_20_percent", "faction", "team")
    return (
        rows.where(F.col("user_id").isNotNull() & F.col("session_id").isNotNull())
        .groupBy("session_id", "user_id").agg(F.max_by(v, F.struct("ingest_time", "row_id")).alias("v"))
        .select(
            "session_id", "user_id", "v.commit_time", F.coalesce("v.battle_score", F.lit(0)).alias("score"),
            *[F.coalesce(F.col(f"v.{c}"), F.lit(False)).alias(n) for c, n in (("victories", "won"), ("early_quit", "quit"), ("team_score_top_20_percent", "top20"))],
            F.lower(F.btrim(F.col("v.faction"))).alias("faction"), F.col("v.team").alias("team"),
        )
    )


def clean_board(rows: DataFrame) -> DataFrame:
    """One snapshot row per user: the one with the latest session (then most battles, highest values)."""
    rest = ["battles", "mmr", "victories", "early_quites", "top_20", "battle_score"]
    best = F.max(F.struct("last_session", *rest)).alias("b")
    return rows.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(best).select("user_id", *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c) for c in (*rest, "last_session")])


def clean_modes(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("session_id").isNotNull()).groupBy("session_id")
        .agg(F.max_by(F.struct("mode"), F.struct("opened_time", "mode")).alias("m")).select("session_id", F.coalesce("m.mode", F.lit("")).alias("mode"))
    )


def mode_names(mode: Column) -> tuple[Column, Column]:
    """(common, specific) board names of a mode; 'newbie' goes before 'low_teir' before 'high_teir'."""
    has = lambda s: F.instr(mode, s) > 0
    tail = lambda s: F.substring(mode, F.instr(mode, s), F.length(mode))
    common = F.when(has("newbie"), "newbie_common").when(has("low_teir"), "low_teir_common").when(has("high_teir"), "high_teir_common").otherwise("lobbie_common")
    specific = F.when(has("newbie"), "newbie").when(has("low_teir"), tail("low_teir")).when(has("high_teir"), tail("high_teir")).otherwise("lobbie")
    return common, specific


def gate(seats: DataFrame, modes: DataFrame) -> DataFrame:
    """Sessions with at least five users on either side that are not newbie sessions; an unknown mode counts as newbie.

    (session_id, mode, common, specific, n1, n2, total_score over all factions)"""
    common, specific = mode_names(F.col("mode"))
    sides = seats.groupBy("session_id").agg(
        *[F.count_if(F.col("faction") == s).alias(f"n{i}") for i, s in enumerate(SIDES, 1)], F.sum("score").alias("total_score"))
    return (
        sides.where((F.col("n1") >= LEAST_PER_SIDE) & (F.col("n2") >= LEAST_PER_SIDE))
        .join(modes.select("session_id", "mode", common.alias("common"), specific.alias("specific")), "session_id")
        .where(F.col("common") != "newbie_common")
    )


def rated_seats(seats: DataFrame, board: DataFrame) -> DataFrame:
    """Seats of both sides with the user's rating (0 where unknown) and the rank inside the side."""
    b = board.select("user_id", F.col("mmr").alias("_mmr"), F.col("battles").alias("_battles"))
    x = seats.where(F.col("faction").isin(*SIDES)).join(b, "user_id", "left")
    x = x.select("*", F.coalesce("_mmr", F.lit(0)).alias("mmr"), F.coalesce("_battles", F.lit(0)).alias("battles"), num.rating_kind(F.col("_battles")).alias("mmr_type")).drop("_mmr", "_battles")
    order = Window.partitionBy("session_id", "faction").orderBy((F.col("mmr_type") == "MMR").desc(), F.when(F.col("mmr_type") == "MMR", F.col("mmr")).otherwise(0).desc(), F.col("user_id").desc())
    return x.withColumn("place", F.row_number().over(order))


def top3(rated: DataFrame) -> DataFrame:
    """Integer mean of the calibrated ratings among each side's first three; null without any."""
    ok = (F.col("place") <= 3) & (F.col("mmr_type") == "MMR")
    cols = []
    for i, s in enumerate(SIDES, 1):
        mine = ok & (F.col("faction") == s)
        cols.append(num.int_div(F.sum(F.when(mine, F.col("mmr"))), F.count_if(mine)).alias(f"top{i}"))
        cols.append(F.bool_or((F.col("faction") == s) & F.col("won")).alias(f"won{i}"))
    return rated.groupBy("session_id").agg(*cols)


def session_facts(seats: DataFrame, board: DataFrame, modes: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """Rated sessions with sides' sizes, top-3 means, results and, with registrations, newbie counts, in one pass.

    Seats meet the board (and registrations) once and are aggregated by session once. The first three of a side that
    count are its three best calibrated ratings, so a side's list of ratings (bounded by its members) is enough."""
    b = board.select("user_id", F.col("mmr").alias("_mmr"), F.col("battles").alias("_battles"))
    x = seats.join(b, "user_id", "left")
    if registrations is not None:
        x = _with_age(x, registrations)
    side = [F.col("faction") == s for s in SIDES]
    aggs = [F.sum("score").alias("total_score")]
    for i, mine in enumerate(side, 1):
        aggs += [F.count_if(mine).alias(f"n{i}"), F.coalesce(F.bool_or(mine & F.col("won")), F.lit(False)).alias(f"won{i}"), F.collect_list(F.when(mine & num.calibrated(F.col("_battles")), F.coalesce("_mmr", F.lit(0)))).alias(f"_best{i}")]
    if registrations is not None:
        aggs += [F.count_if(F.col("newbie") & m).alias(f"new{i}") for i, m in enumerate(side, 1)]
        first = F.col("newbie") & side[0]
        aggs += [F.count_if(first & (F.col("team") == t)).alias(f"new1_team{t}") for t in (1, 2)] + [F.count_if(first & (F.col("team") == t) & F.col("won")).alias(f"won1_team{t}") for t in (1, 2)]
    common, specific = mode_names(F.col("mode"))
    g = (
        x.groupBy("session_id").agg(*aggs).where((F.col("n1") >= LEAST_PER_SIDE) & (F.col("n2") >= LEAST_PER_SIDE))
        .join(modes.select("session_id", "mode", common.alias("common"), specific.alias("specific")), "session_id").where(F.col("common") != "newbie_common")
    )
    for i in (1, 2):
        top = F.slice(F.sort_array(f"_best{i}", asc=False), 1, 3)
        g = g.withColumn(f"top{i}", num.int_div(F.aggregate(top, F.lit(0).cast("long"), lambda t, v: t + v), F.size(top)))
    gap = F.col("top1") - F.col("top2")
    return g.drop("_best1", "_best2").withColumns({"disbalance_1": F.coalesce(gap > GAP, F.lit(False)), "disbalance_2": F.coalesce(gap < -GAP, F.lit(False))})


BALANCE = ("session_id", "common", "specific", "n1", "n2", "total_score", "top1", "top2", "won1", "won2", "disbalance_1", "disbalance_2", "mode")


def session_balance(seats: DataFrame, board: DataFrame, modes: DataFrame) -> DataFrame:
    """One row per rated session: sides' sizes, top-3 means, results and disbalance flags."""
    return session_facts(seats, board, modes).select(*BALANCE)


def _with_age(seats: DataFrame, registrations: DataFrame) -> DataFrame:
    reg = registrations.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("registered_time").alias("_reg"))
    age = F.col("commit_time") - F.coalesce("_reg", F.lit(0))
    return seats.join(reg, "user_id", "left").withColumn("newbie", F.col("_reg").isNotNull() & (age > 0) & (age < NEWBIE_MS)).drop("_reg")


def newbies(seats: DataFrame, registrations: DataFrame) -> DataFrame:
    """Seats of both sides with ``newbie``: within 24 hours after a registration (strictly, null never)."""
    return _with_age(seats.where(F.col("faction").isin(*SIDES)), registrations)


STATISTICS = (
    "battles", "disbalance_team_1", "disbalance_team_1_victory", "disbalance_team_2", "disbalance_team_2_victory", "new_user_battles", "new_users_session",
    "new_user_disbalance_session", "new_user_disbalance_battles", "new_user_disbalance_allie_battles", "new_user_disbalance_battles_victory",
    "newbie_count_disbalance_team_1", "newbie_count_disbalance_team_2",
)


def board_statistics(seats: DataFrame, board: DataFrame, modes: DataFrame, registrations: DataFrame) -> DataFrame:
    """The 13 counters per board; a session counts for 'common', its mode, the common and the specific mode.

    Per-user newbie counters look at the first side only; a board named twice by a session counts it twice."""
    s = session_facts(seats, board, modes, registrations)
    d1, d2 = F.col("disbalance_1"), F.col("disbalance_2")
    one = lambda c: F.when(c, 1).otherwise(0)
    r1, r2 = F.col("new1") / F.col("n1"), F.col("new2") / F.col("n2")
    values = (
        F.lit(1), one(d1), one(d1 & F.col("won1")), one(d2), one(d2 & F.col("won2")), F.col("new1"), one(F.col("new1") > 0), one((F.col("new1") > 0) & (d1 | d2)),
        F.when(d1 | d2, F.col("new1")).otherwise(0), F.when(d1, F.col("new1_team1")).when(d2, F.col("new1_team2")).otherwise(0),
        F.when(d1, F.col("won1_team1")).when(d2, F.col("won1_team2")).otherwise(0),
        one((r1 >= 0.69) & (r2 < 0.31)), one((r2 >= 0.69) & (r1 < 0.31)),
    )
    per = s.select(F.explode(F.array(F.lit("common"), "mode", "common", "specific")).alias("board"), *[v.cast("long").alias(n) for v, n in zip(values, STATISTICS)])
    return per.groupBy("board").agg(*[F.sum(n).alias(n) for n in STATISTICS])


def win_buckets(balance: DataFrame, width: int = 50) -> DataFrame:
    """Win rate by bucketed top-3 difference: a match adds (1, 1) at winner - loser and (0, 1) at its mirror."""
    diff = F.when(F.col("won1"), F.col("top1") - F.col("top2")).otherwise(F.col("top2") - F.col("top1"))
    b = num.bucket(diff, width)
    x = balance.where(F.col("top1").isNotNull() & F.col("top2").isNotNull()).select(F.explode(F.array(F.struct(b.alias("bucket"), F.lit(1).alias("w")), F.struct((-b).alias("bucket"), F.lit(0).alias("w")))).alias("e"))
    return x.groupBy("e.bucket").agg(F.sum("e.w").alias("wins"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("wins") / F.col("total"), 4))


def spread_rebucket(balance: DataFrame, width: int = 200) -> DataFrame:
    """First side's wins by the exact top-3 pair, re-bucketed by their difference."""
    x = balance.where(F.col("top1").isNotNull() & F.col("top2").isNotNull())
    pairs = x.groupBy("top1", "top2").agg(F.count_if("won1").alias("wins"), F.count("*").alias("total"))
    g = pairs.groupBy(num.bucket(F.col("top1") - F.col("top2"), width).alias("bucket")).agg(F.sum("wins").alias("wins"), F.sum("total").alias("total"))
    return g.withColumn("rate", F.round(F.col("wins") / F.col("total"), 4))


def faction_counters(seats: DataFrame) -> DataFrame:
    return seats.where(F.col("faction").isNotNull()).groupBy("user_id", "faction").agg(F.count("*").alias("battles"))


def spread(board: DataFrame, counters: DataFrame, key: str, width: int, least_battles: int = 0, since: int = 0, country: DataFrame | None = None) -> DataFrame:
    """(main faction[, country], bucket of ``key``) -> users and sum of mmr, for active users.

    The main faction holds at least 65 % of the user's battles, else 'mixed'. Users of unknown country drop out."""
    by = counters.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.col("faction") == s, F.col("battles"))), F.lit(0)).alias(f"b{i}") for i, s in enumerate(SIDES, 1)])
    u = board.where((F.col("battles") >= least_battles) & (F.col("last_session") >= since)).join(by, "user_id", "left")
    share = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.col("battles")), F.lit(0.0)) >= 0.65
    u = u.withColumn("main_faction", F.when(share("b1"), SIDES[0]).when(share("b2"), SIDES[1]).otherwise("mixed"))
    keys = ["main_faction"]
    if country is not None:
        u, keys = u.join(country, "user_id"), ["main_faction", "country"]
    return u.groupBy(*keys, num.bucket(F.col(key), width).alias("bucket")).agg(F.count("*").alias("users"), F.sum("mmr").alias("sum_mmr"))


def mission_winrate(balance: DataFrame, missions: DataFrame) -> DataFrame:
    """Cross counts of (mission, balance group, winner) with the groups' totals and the win rate's parts."""
    group = F.when(F.col("disbalance_1"), "team_1_unbalanced").when(F.col("disbalance_2"), "team_2_unbalanced").otherwise("balanced")
    winner = F.when(F.col("won1"), "team_1_win").otherwise("team_2_win")
    x = balance.join(missions, "session_id").select("mission", group.alias("balance_group"), winner.alias("win_group"))
    cross = x.groupBy("mission", "balance_group", "win_group").agg(F.count("*").alias("cross_count"))
    over = lambda *k: F.sum("cross_count").over(Window.partitionBy("mission", *k))
    counted = cross.select("*", over("balance_group").alias("balance_count"), over("win_group").alias("win_count"), over().alias("games"))
    return counted.withColumn("session_dau", F.sum("cross_count").over(Window.partitionBy()))  # at most six rows a mission


def opponent_mean(rated: DataFrame) -> DataFrame:
    """(session_id, faction, opp): attenuated mean of a side's calibrated ratings, null below three of them."""
    ok = rated.where(F.col("mmr_type") == "MMR")
    side = Window.partitionBy("session_id", "faction")
    x = ok.withColumn("_top", F.max("mmr").over(side))
    x = x.withColumn("_v", F.col("mmr") * num.low_place_weight(F.col("mmr"), F.col("_top"))).withColumn("_m", F.max("_v").over(side))
    part = F.when(F.col("_m") < 1e-7, F.lit(1.0)).otherwise(F.try_divide(F.col("_top").cast("double"), F.col("_m")) * F.col("_v"))
    return x.groupBy("session_id", "faction").agg(F.when(F.count("*") > 2, num.sat_int(F.sum(part) / F.count("*"), 0, num.UINT_MAX)).alias("opp"))


def delta_v1(won: Column, score: Column, opp: Column, mmr: Column, known: Column, quit_: Column, top20: Column) -> Column:
    """Rating change of the score-and-gap variant; ``known`` tells whether the rating is calibrated."""
    curve = F.when(score == 0, F.lit(0.0)).otherwise(50.0 / F.exp(F.try_divide(F.lit(1e6), F.pow(score.cast("double"), F.lit(2.0)))))
    base = num.sat_int(curve) - F.when(won, 0).otherwise(66) + F.when(quit_, -20).otherwise(0) + F.when(top20, 20).otherwise(0)
    gap = F.when(known, F.coalesce(opp, mmr) - mmr).otherwise(0)
    gap = F.when(won, gap).otherwise(-gap)
    mul = F.when(F.abs(gap) < 250, F.lit(0.0)).otherwise(2.0 / (1.0 + F.exp(-0.001 * gap)) - 1.0)
    return F.when(won, F.greatest(num.sat_int(base + mul * 35.0), F.lit(0))).otherwise(num.sat_int(base - mul * 35.0))


def v1_snapshot(seats: DataFrame, board: DataFrame, modes: DataFrame) -> DataFrame:
    """Changes of variant 1 of every rated session against one fixed leaderboard.

    Everything a seat needs of its session (sizes, score, results, the other side's ratings) comes from one window
    over the session; lists of ratings are bounded by a side's members."""
    b = board.select("user_id", F.col("mmr").alias("_mmr"), F.col("battles").alias("_battles"))
    x = seats.join(b, "user_id", "left").select("*", F.coalesce("_mmr", F.lit(0)).alias("mmr"), num.rating_kind(F.col("_battles")).alias("mmr_type"))
    ses, side, known = Window.partitionBy("session_id"), [F.col("faction") == s for s in SIDES], F.col("mmr_type") == "MMR"
    x = x.select(
        "session_id", "user_id", "faction", "mmr", "mmr_type", "score", "quit", "top20", F.sum("score").over(ses).alias("total_score"),
        *[c for i, m in enumerate(side, 1) for c in (
            F.count_if(m).over(ses).alias(f"n{i}"), F.bool_or(m & F.col("won")).over(ses).alias(f"won{i}"), F.collect_list(F.when(m & known, F.col("mmr"))).over(ses).alias(f"_r{i}"))],
    ).where(F.col("faction").isin(*SIDES) & (F.col("n1") >= LEAST_PER_SIDE) & (F.col("n2") >= LEAST_PER_SIDE))
    x = x.join(modes.where(mode_names(F.col("mode"))[0] != "newbie_common").select("session_id"), "session_id")
    first = side[0]
    x = x.withColumn("_o", F.when(first, F.col("_r2")).otherwise(F.col("_r1"))).withColumn("_top", F.array_max("_o"))
    x = x.withColumn("_v", F.transform("_o", lambda m: m * num.low_place_weight(m, F.col("_top")))).withColumn("_m", F.array_max("_v"))
    share = F.when(F.col("_m") < 1e-7, F.size("_v").cast("double")).otherwise(F.try_divide(F.col("_top").cast("double"), F.col("_m")) * F.aggregate("_v", F.lit(0.0), lambda t, v: t + v))
    x = x.withColumn("opp", F.when(F.size("_o") > 2, num.sat_int(share / F.size("_o"), 0, num.UINT_MAX)))
    x = x.withColumn("score_norm", num.sat_int(F.try_divide(1600.0 * (F.col("n1") + F.col("n2")), F.col("total_score").cast("double")) * F.col("score"), 0, num.UINT_MAX))
    delta = delta_v1(F.when(first, F.col("won1")).otherwise(F.col("won2")), F.col("score_norm"), F.col("opp"), F.col("mmr"), known, F.col("quit"), F.col("top20"))
    return x.select("session_id", "user_id", "faction", "mmr", "mmr_type", "score_norm", "opp", delta.alias("delta"))


def v2_coefficients(seats: DataFrame, board: DataFrame, modes: DataFrame) -> DataFrame:
    """Per member of a rated session: weight k, adjusted score, give/get/dec/inc and the session's pool, I and N."""
    x = rated_seats(seats, board).join(gate(seats, modes).select("session_id"), "session_id", "left_semi")
    m, score, ses = F.col("mmr").cast("double"), F.col("score"), Window.partitionBy("session_id")
    k = F.pow(F.sqrt(F.lit(2.0)), F.least(F.lit(0), F.col("battles") - 6).cast("double"))
    quarter = num.int_div(score, 4)
    adj = F.greatest(score + F.when(F.col("won"), quarter).otherwise(0) + F.when(F.col("top20"), quarter).otherwise(0) - F.when(F.col("quit"), num.int_div(score, 2)).otherwise(0), F.lit(0))
    x = x.withColumn("k", k).withColumn("adj_score", adj)
    x = x.withColumn("avg_mmr", F.sum(F.col("mmr") * F.col("k")).over(ses) / F.sum("k").over(ses)).withColumn("sum_score", F.sum("adj_score").over(ses))
    x = x.withColumn("give", num.sigmoid(m, 0.01, 500.0, -1.0, 1.0) + 0.2 * (1.0 - F.col("k"))).withColumn("get", num.sigmoid(m, 0.01, 9500.0, 1.0, 0.0) * 0.05)
    x = x.withColumn("dec", 0.5 / (8.0 * F.pow(num.ratio_or_one(F.col("avg_mmr"), m), F.lit(0.35)) + 1.0)).withColumn("inc", 0.5 / (4.0 * num.ratio_or_one(m, F.col("avg_mmr")) + 1.0))
    pool = (F.col("dec") + F.col("get")) * m * F.col("k") + F.col("give") * F.greatest(F.col("avg_mmr"), F.lit(500.0)) - F.col("get") * m
    ik = F.col("inc") / F.col("k")
    return x.withColumn("pool", F.sum(pool).over(ses)).withColumn("inc_sum", F.sum(ik).over(ses)).withColumn("norm", F.sum(ik * F.col("adj_score")).over(ses))


def v2_snapshot(seats: DataFrame, board: DataFrame, modes: DataFrame) -> DataFrame:
    """Changes of the pool-redistribution variant against one fixed leaderboard (norm 0: no change)."""
    x = v2_coefficients(seats, board, modes)
    gain = F.try_divide(F.col("pool") * F.col("adj_score") * F.col("inc"), F.col("norm") * F.col("k"))
    loss = F.col("mmr") * (F.col("dec") + F.col("get")) / F.col("k")
    delta = num.sat_int(gain - loss)
    return x.select("session_id", "user_id", "mmr", F.round("k", 6).alias("k"), "adj_score", F.round(gain, 3).alias("gain"), F.round(loss, 3).alias("loss"), delta.alias("delta"), F.greatest(F.col("mmr") + delta, F.lit(0)).alias("new_mmr"))


def knn_bootstrap(asked: DataFrame, index: DataFrame, radius: int = 50, enough: int = 10, least_index: int = 1000) -> DataFrame:
    """First rating of a user by the average score: range join with the index of calibrated users.

    asked (user_id, s), index (s, mmr, user_id). Ten or more neighbours within the radius: integer mean; fewer:
    80 % of the nearest (ties: lower score, then lower user); none or an index below ``least_index``: null.
    Users never meet: the index is reduced to one row per score (count, sum, least user), the asked scores to
    distinct ones, and the range join of those is an equi-join on buckets as wide as the radius plus one, each
    score asking three buckets of at most that many scores. The answer per score then goes back to the users.
    """
    w = radius + 1
    idx = index.groupBy(F.col("s").alias("_s")).agg(F.count("*").alias("_n"), F.sum("mmr").alias("_t"), F.min(F.struct("user_id", "mmr")).alias("_u")).withColumn("_b", F.floor(F.col("_s") / w))
    probe = asked.where(F.col("s").isNotNull()).select("s").distinct().select("s", F.explode(F.array(*[F.floor(F.col("s") / w) + d for d in (-1, 0, 1)])).alias("_b"))
    near = probe.join(idx, "_b").where(F.abs(F.col("s") - F.col("_s")) <= radius)
    g = near.groupBy("s").agg(F.sum("_n").alias("n"), F.sum("_t").alias("t"), F.min(F.struct(F.abs(F.col("s") - F.col("_s")), "_s", "_u")).alias("c"))
    size = index.agg(F.count("*")).scalar()
    guess = F.when(F.col("n") >= enough, num.int_div(F.col("t"), F.col("n"))).otherwise(num.sat_int(F.col("c._u.mmr") * 0.8))
    return asked.join(g, "s", "left").select("user_id", "s", F.coalesce("n", F.lit(0)).alias("neighbours"), F.when((size >= least_index) & (F.col("n") > 0), guess).alias("first_mmr"))


def session_islands(rows: DataFrame, order: str, value: str, chunk: int = 65_536) -> DataFrame:
    """Runs of equal ``value`` in the order of the integer key ``order``: (first, last, value, rows).

    Runs are found inside chunks of the key; one summary row per chunk carries what crosses the borders."""
    r = rows.where(F.col(order).isNotNull()).select(F.col(order).alias("o"), F.col(value).alias("v"), num.int_div(F.col(order), chunk).alias("c"))
    inside = Window.partitionBy("c").orderBy("o")
    ends = before_last(r.groupBy("c").agg(F.max_by(F.struct("v"), "o").alias("last")), "c", "last", "e").select("c", "e")
    r = r.withColumn("p", F.lag(F.struct("v")).over(inside)).withColumn("n", F.row_number().over(inside)).join(ends, "c")
    before = F.when(F.col("n") == 1, F.col("e")).otherwise(F.col("p"))
    r = r.withColumn("s", F.when(before.isNull() | ~before["v"].eqNullSafe(F.col("v")), F.col("o")))
    carry = before_max(r.groupBy("c").agg(F.max("s").alias("m")), "c", "m", "carry").select("c", "carry")
    r = r.withColumn("s", F.max("s").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(carry, "c")
    return r.groupBy(F.coalesce("s", "carry").alias("first")).agg(F.max("o").alias("last"), F.any_value("v").alias("value"), F.count("*").alias("rows"))
