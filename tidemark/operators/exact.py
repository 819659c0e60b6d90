"""Exact, order-dependent rating folds over a bounded stream, and slice-wise rating for larger ones.

Both variants change the state that the next session reads, so the exact fold is sequential by nature inside
each set of sessions that depend on each other. Variant 2 streams such a set in order through one task, of any size;
variant 1 holds it as one group behind a check of its size. ``rate_slices`` evaluates time slices against the
board at their start, each slice as one distributed plan.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as num
from tidemark.operators import ratings as R
from tidemark.session import cut, slots

CHANGES = "session_id long, user_id long, at long, delta long, mmr long, battles long"


def _trunc(x: float, lo: int = -(2**31), hi: int = 2**31 - 1) -> int:
    return 0 if x != x else hi if x >= hi else lo if x <= lo else int(x)


def _opponents(values: list[int]) -> int | None:
    if len(values) < 3:
        return None
    top = max(values)
    weighted = []
    for m in values:
        if m < 1e-8:
            k = 1.0
        else:
            n = 0.99 * top / m
            k = -n / (1 + math.exp(min(700.0, -1.5 * n * (m / top - 0.5)))) + n + 1
        weighted.append(m * k)
    most = max(weighted)
    return _trunc(sum(1.0 if most < 1e-7 else top / most * w for w in weighted) / len(weighted), 0, 2**32 - 1)


def _delta(won: bool, score: int, opp: int | None, mmr: int, known: bool, quit_: bool, top20: bool) -> int:
    base = (_trunc(50 / math.exp(min(700.0, 1e6 / score**2))) if score else 0) - (0 if won else 66) - 20 * quit_ + 20 * top20
    gap = ((mmr if opp is None else opp) - mmr) * (1 if won else -1) if known else 0
    mul = 0.0 if abs(gap) < 250 else 2 / (1 + math.exp(-0.001 * gap)) - 1
    return max(_trunc(base + mul * 35), 0) if won else _trunc(base - mul * 35)


def _sessions(pdf: pd.DataFrame):
    """(at, session, members) in order of (time, id), members by user."""
    rows = pdf.sort_values(["at", "session_id", "user_id"]).itertuples(index=False)
    for (at, session), g in groupby(rows, key=lambda r: (r.at, r.session_id)):
        yield at, session, list(g)


def fold_v1(pdf: pd.DataFrame, board: dict[int, list[int]], least_index: int = 1000) -> pd.DataFrame:
    """board: user -> [mmr, battles, score sum], changed in place. Sessions by (time, id), members by user."""
    index = sorted((b[2] // b[1], u) for u, b in board.items() if b[1] > 5)
    out = []
    for at, session, g in _sessions(pdf):
        sides = {s: [r for r in g if r.faction == s] for s in R.SIDES}
        opp = {s: _opponents([board[r.user_id][0] for r in x if r.user_id in board and board[r.user_id][1] > 5]) for s, x in sides.items()}
        won = {s: any(r.won for r in x) for s, x in sides.items()}
        total, n = g[0].total_score, len(g)
        todo = []
        for s, other in (R.SIDES, R.SIDES[::-1]):
            for r in sides[s]:
                norm = _trunc(1600.0 * n / total * r.score, 0, 2**32 - 1) if total else 0
                b = board.get(r.user_id)
                todo.append((r, _delta(won[s], norm, opp[other], b[0] if b else 0, bool(b and b[1] > 5), r.quit, r.top20)))
        for r, d in todo:
            b = board.get(r.user_id)
            if b is None:
                board[r.user_id] = [r.score, 1, r.score]
            else:
                mmr, battles, score = b
                if battles + 1 > 6:
                    new = max(mmr + d, 0)
                    at0 = bisect.bisect_left(index, (score // battles, r.user_id))
                    if at0 < len(index) and index[at0] == (score // battles, r.user_id):
                        index.pop(at0)
                else:
                    new = (score + r.score) // (battles + 1)
                    if battles + 1 == 6 and len(index) >= least_index:
                        s = new
                        near = index[bisect.bisect_left(index, (max(s - 50, 0), -1)) : bisect.bisect_right(index, (s + 50, 1 << 62))]
                        if len(near) >= 10:
                            new = sum(board[u][0] for _, u in near) // len(near)
                        elif near:
                            new = int(board[min(near, key=lambda e: (abs(e[0] - s), e))[1]][0] * 0.8)
                board[r.user_id] = [new, battles + 1, score + r.score]
                if battles > 5:
                    bisect.insort(index, ((score + r.score) // (battles + 1), r.user_id))
            out.append((session, r.user_id, at, d, board[r.user_id][0], board[r.user_id][1]))
    return pd.DataFrame(out, columns=["session_id", "user_id", "at", "delta", "mmr", "battles"])


def _v2_deltas(m: np.ndarray, b: np.ndarray, adj: np.ndarray) -> np.ndarray:
    """Changes of a session's members by their ratings, battles and adjusted scores; NaN where no score counts."""
    k = np.sqrt(2.0) ** np.minimum(0, b - 6)
    avg = (m * k).sum() / k.sum()
    ratio = lambda t, d: np.where((t == d) | (d < 1e-8), 1.0, t / np.where(d < 1e-8, 1.0, d))
    give = 1 - 1 / (1 + np.exp(-0.01 * (m - 500))) + 0.2 * (1 - k)
    get = 0.05 / (1 + np.exp(-0.01 * (m - 9500)))
    dec, inc = 0.5 / (8 * ratio(np.full(len(m), avg), m) ** 0.35 + 1), 0.5 / (4 * ratio(m, np.full(len(m), avg)) + 1)
    pool, norm = ((dec + get) * m * k + give * max(avg, 500.0) - get * m).sum(), (inc / k * adj).sum()
    return pool * adj * inc / (norm * k) - m * (dec + get) / k if norm else np.full(len(m), np.nan)


def fold_v2(pdf: pd.DataFrame, board: dict[int, list[int]]) -> pd.DataFrame:
    out = []
    for at, session, g in _sessions(pdf):
        old = [board.get(r.user_id) for r in g]
        m = np.array([x[0] if x else 0 for x in old], float)
        b = np.array([x[1] if x else 0 for x in old], float)
        adj = np.array([max(r.score + r.won * (r.score // 4) + r.top20 * (r.score // 4) - r.quit * (r.score // 2), 0) for r in g], float)
        for r, d in zip(g, _v2_deltas(m, b, adj)):
            d, old = _trunc(float(d)), board.get(r.user_id)
            board[r.user_id] = [max((old[0] if old else 0) + d, 0), (old[1] if old else 0) + 1, (old[2] if old else 0) + r.score]
            out.append((session, r.user_id, at, d, board[r.user_id][0], board[r.user_id][1]))
    return pd.DataFrame(out, columns=["session_id", "user_id", "at", "delta", "mmr", "battles"])


def fold_v2_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Change log of rows (g, session_id, at, user_id, adj) in order of group, time and session, members by user.

    A group begins with its users' start states: no session, battles as ``at`` and the rating as ``adj``. Only the states of
    one group's users and one unfinished session are held, however long the stream is."""
    now, state, rest = None, {}, None
    none = (0, 0)

    def rated(rows: pa.Table) -> pa.RecordBatch:
        nonlocal now, state
        g, u, adj = (rows.column(c).to_numpy() for c in ("g", "user_id", "adj"))
        at, users, values = rows.column("at").to_pylist(), u.tolist(), adj.astype(float)
        start = rows.column("session_id").is_null().to_numpy()
        s = rows.column("session_id").fill_null(0).to_numpy()
        edges = np.flatnonzero((g[1:] != g[:-1]) | (start[1:] != start[:-1]) | (s[1:] != s[:-1])) + 1
        kept, delta, mmr, battles = ~start, [], [], []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(s)]):
            if g[a] != now:
                now, state = g[a], {}
            own = users[a:b]
            if start[a]:
                state.update(zip(own, zip(adj[a:b].tolist(), at[a:b])))
                continue
            old = [state.get(x, none) for x in own]
            m, n = np.array(old, float).T
            for x, (m0, n0), d in zip(own, old, _v2_deltas(m, n, values[a:b]).tolist()):
                d = _trunc(d)
                state[x] = new = (max(m0 + d, 0), n0 + 1)
                delta.append(d)
                mmr.append(new[0])
                battles.append(new[1])
        long = lambda x: pa.array(x, pa.int64())
        k = pa.array(kept)
        cols = [rows.column(c).filter(k).combine_chunks() for c in ("session_id", "user_id", "at")]
        return pa.RecordBatch.from_arrays([*cols, long(delta), long(mmr), long(battles)], ["session_id", "user_id", "at", "delta", "mmr", "battles"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        g, s = rows.column("g").to_numpy(), rows.column("session_id").fill_null(-(2**63)).to_numpy()
        differ = np.flatnonzero((g != g[-1:]) | (s != s[-1:]))
        cut_at = int(differ[-1]) + 1 if len(differ) else 0  # what follows may be part of a session that goes on
        if rows.column("session_id").slice(cut_at).null_count:
            cut_at = len(s)  # start states need not wait
        rest = rows.slice(cut_at)
        if cut_at:
            yield rated(rows.slice(0, cut_at))
    if rest is not None and rest.num_rows:
        yield rated(rest)


def _stream(seats: DataFrame, modes: DataFrame) -> DataFrame:
    """Seats of both sides in the sessions of ``R.gate``, by windows: one exchange by session serves all that is counted."""
    w = Window.partitionBy("session_id")
    sides = {f"_n{i}": F.count_if(F.col("faction") == s).over(w) for i, s in enumerate(R.SIDES, 1)}
    x = seats.select("session_id", "user_id", "score", "won", "quit", "top20", "faction", F.min("commit_time").over(w).alias("at"), F.sum("score").over(w).alias("total_score"), *[c.alias(n) for n, c in sides.items()])
    x = x.where((F.col("_n1") >= R.LEAST_PER_SIDE) & (F.col("_n2") >= R.LEAST_PER_SIDE) & F.col("faction").isin(*R.SIDES))
    rated = modes.where(R.mode_names(F.col("mode"))[0] != "newbie_common").select("session_id")
    return x.join(rated, "session_id").select("session_id", "user_id", "at", "score", "won", "quit", "top20", "faction", "total_score")


def _labels(edges: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(right, l): the smallest ``right`` key in reach, and the edges, of a two-sided graph.

    Labels pass over the edges and, by looking up the label of the label, over twice the distance each round, so the
    rounds grow with the logarithm of the longest chain. Only a count comes to the driver."""
    edges = cut(edges.select(left, right).distinct())
    label = cut(edges.select(right).distinct().withColumn("l", F.col(right)))
    while True:
        near = edges.join(label, right).groupBy(left).agg(F.min("l").alias("l"))
        spread = edges.join(near, left).groupBy(right).agg(F.min("l").alias("l"))
        far = label.select(F.col(right).alias("l"), F.col("l").alias("_far"))
        after = cut(spread.join(far, "l", "left").select(right, F.least("l", "_far").alias("l")))
        moved = after.join(label.withColumnRenamed("l", "_l"), right).where("l <> _l").count()
        label = after
        if not moved:
            return label, edges


def parts(edges: DataFrame, left: str, right: str, hubs: int = 60) -> tuple[DataFrame, DataFrame]:
    """(left, component) and (right, component): parts of a two-sided graph that share nothing, named by their smallest
    ``right`` key.

    The ``hubs`` most frequent right keys (60 at most: a bit each) join their neighbours at once; labels then pass only
    over the edges that no hub is part of, with each hub's neighbours as one key."""
    ends = edges.select(left, right)
    top = [r[0] for r in ends.groupBy(right).count().orderBy(F.desc("count"), right).limit(min(hubs, 60)).collect()]
    bit = F.when(F.lit(False), F.lit(0).cast("long"))
    for i, k in enumerate(top):
        bit = bit.when(F.col(right) == F.lit(k), F.lit(1 << i).cast("long"))
    sides = ends.groupBy(left).agg(F.bit_or(bit.otherwise(F.lit(0).cast("long"))).alias("_m"))
    tagged = ends.join(sides, left)
    users = cut(tagged.groupBy(right).agg(F.bit_or("_m").alias("_m")))
    low = lambda m: F.bit_count(m.bitwiseAND(-m) - 1)
    held = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("_m").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    pairs = users.where("_m <> 0").select("_m").distinct().select(low(F.col("_m")).alias("a"), F.explode(held).alias("b")).distinct().collect()
    root = list(range(len(top)))
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    if top:
        hub = F.element_at(F.array(*[F.lit(top[r]) for r in root]), low(F.col("_m")) + 1)
        node = lambda other: F.when(F.col("_m") != 0, hub).otherwise(other)
    else:
        node = lambda other: other
    rest = tagged.where("_m = 0").select(left, right).join(users, right).select(left, node(F.col(right)).alias("_node"))
    label, rest = _labels(rest, left, "_node")
    users = cut(users.select(right, node(F.col(right)).alias("_node")).join(label, "_node", "left").select(right, F.coalesce("l", "_node").alias("_g")))
    name = cut(users.groupBy("_g").agg(F.min(right).alias("component")))
    by_hub = sides.where("_m <> 0").select(left, node(F.lit(None)).alias("_node")).join(label, "_node", "left").select(left, F.coalesce("l", "_node").alias("_g"))
    lefts = by_hub.unionByName(rest.join(label, "_node").groupBy(left).agg(F.min("l").alias("_g")))
    return lefts.join(name, "_g").select(left, "component"), users.join(name, "_g").select(right, "component")


def components(edges: DataFrame, left: str, right: str, hubs: int = 60) -> DataFrame:
    """(left, component) of ``parts``."""
    return parts(edges, left, right, hubs)[0]


def rate_exact(seats: DataFrame, board: DataFrame, modes: DataFrame, variant: str, most_rows: int = 5_000_000) -> DataFrame:
    """Change log of the exact fold.

    Variant 2 changes only the members of a session, so sessions that share no user, not even over others, are folded
    side by side: each connected component is streamed in order through one task, which holds the states of its users.
    Variant 1 looks up the scores of all users, so its stream is one group; more than ``most_rows`` seats or users
    of it are an error."""
    stream = _stream(seats, modes)
    if variant == "v2":
        return _rate_v2(stream, board)
    stream = cut(stream).withColumn("g", F.lit(1).cast("long"))
    users = board.select("user_id", "mmr", "battles", "battle_score").withColumn("g", F.lit(1).cast("long"))
    if users.count() > most_rows:
        raise ValueError("too many users for the sequential fold; use rate_slices")
    if stream.count() > most_rows:
        raise ValueError("too many rows for the sequential fold; use rate_slices")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        state = {r.user_id: [r.mmr, r.battles, r.battle_score] for r in b.itertuples()}
        return fold_v1(a.drop(columns="g"), state)

    return stream.groupBy("g").cogroup(users.groupBy("g")).applyInPandas(run, CHANGES)


def _rate_v2(stream: DataFrame, board: DataFrame) -> DataFrame:
    score, part = F.col("score"), lambda flag, n: F.when(F.col(flag), num.int_div(F.col("score"), n)).otherwise(0)
    adj = F.greatest(score + part("won", 4) + part("top20", 4) - part("quit", 2), F.lit(0)).cast("long")
    stream = cut(stream.select("session_id", "user_id", "at", adj.alias("adj")))
    sessions, users = parts(stream, "session_id", "user_id")
    rows = stream.join(sessions, "session_id").select(F.col("component").alias("g"), "session_id", "at", "user_id", "adj")
    starts = users.join(board, "user_id").select(F.col("component").alias("g"), F.lit(None).cast("long").alias("session_id"), F.col("battles").cast("long").alias("at"), "user_id", F.col("mmr").cast("long").alias("adj"))
    order = ["g", F.col("session_id").isNotNull(), F.col("at").asc_nulls_last(), "session_id", "user_id"]
    return rows.unionByName(starts).repartition(slots(stream.sparkSession), "g").sortWithinPartitions(*order).mapInArrow(fold_v2_stream, CHANGES)


def slice_edges(seats: DataFrame, start: int, length: int) -> list[int]:
    """Edges in ms of the slices from ``start`` on (or before it) that hold sessions, with one slice over each gap."""
    at = seats.groupBy("session_id").agg(F.min("commit_time").alias("at")).where("at is not null")
    held = [r[0] for r in at.select(F.floor((F.col("at") - start) / length)).distinct().collect()]
    return sorted({start + k * length for n in held for k in (n, n + 1)})


def rate_slices(seats: DataFrame, board: DataFrame, modes: DataFrame, variant: str, edges: list[int]) -> DataFrame:
    """The board after rating the sessions slice by slice (edges in ms): inside a slice every session sees the
    board of its start, and a user's changes add up. One distributed plan and one checkpoint per slice."""
    snap = {"v1": R.v1_snapshot, "v2": R.v2_snapshot}[variant]
    cols = ["user_id", "mmr", "battles", "battle_score"]
    now, start = cut(board.select(*cols)), seats.groupBy("session_id").agg(F.min("commit_time").alias("at"))
    timed = cut(seats.join(start, "session_id"))
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = timed.where((F.col("at") >= lo) & (F.col("at") < hi))
        d = snap(part, now, modes).join(part.select("session_id", "user_id", "score"), ["session_id", "user_id"])
        change = d.groupBy("user_id").agg(F.sum("delta").alias("d"), F.count("*").alias("n"), F.sum("score").alias("s"))
        now = cut(now.join(change, "user_id", "full").select(
            "user_id", F.greatest(F.coalesce("mmr", F.lit(0)) + F.coalesce("d", F.lit(0)), F.lit(0)).alias("mmr"),
            (F.coalesce("battles", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("battles"), (F.coalesce("battle_score", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("battle_score")))
    return now
