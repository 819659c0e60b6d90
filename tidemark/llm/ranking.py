"""Global ranking from pairwise comparisons by offence-defence scaling.

A contest gives every member of the winning side a win over every member of the losing side. The win matrix A
is never formed: a contest is a rank-one block, so a product with A is a sum over its losers that is handed
to its winners, and nothing is emitted per pair. With ``alpha`` wins and losses against the average item added
(which links items that never met), the iterations

    offence = A (1 / defence),   defence = A' (1 / offence)

rescale rows and columns in turn (Sinkhorn); the strength is offence / defence, scaled to geometric mean 1. Once
successive moves shrink by a steady ratio r, the rest of that geometric series is taken in one step (Aitken's
rule on the logarithms, a step 1 / (1 - r) times as long), which reaches the same fixed point in fewer turns.

One plan serves all sizes. Contests are cut into blocks and items into parts, both packed into one row each and
checkpointed in their own partitioning. A half step is one job of two exchanges: every block adds up its
contests over the values it was sent, and sends each part one packed array of sums; every part adds the sums of
its blocks, and sends each block the new values of the items that the block holds. So what moves is an item's
value once per block that holds it, as four bytes (sums are kept in eight), neither seats nor whole vectors;
no item and no contest is a hot key, and the driver sees two numbers a half step. Contests of more seats than a block are summed inside the parts, like
the smoothing term.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ranks import number_rows
from tidemark.session import cut

RESULT = "item long, offence double, defence double, strength double, wins long, losses long, rank long, converged boolean"
STATE = -1  # block number of a part's own values
LARGE = -2  # block number of a part's share in a contest larger than a block


@dataclass(frozen=True)
class RankRules:
    """steady: by how much two successive ratios of moves may differ for the longer step; 0 never takes it.
    block_seats, part_items: seats of a block and items of a part at scale; small tables are cut finer, so that all
    cores have work, but not below ``least``."""

    alpha: float = 1.0
    iterations: int = 60
    tolerance: float = 1e-6
    steady: float = 0.03
    block_seats: int = 1_000_000
    part_items: int = 200_000
    least: int = 20_000


def contests(seats: DataFrame, session: str, item: str, team: str, won: str) -> DataFrame:
    """(session, item, won, w, size) of decided contests, w = 1 / sqrt(winners * losers), size = seats.

    A side's vote is its true minus its false flags; side 1 wins if its vote exceeds side 2's. Contests with
    one side only, with equal votes, and seats outside sides 1 and 2 give no comparison.
    """
    s = seats.where(F.col(item).isNotNull() & F.col(session).isNotNull() & F.col(team).isin(1, 2)).select(
        F.col(session).alias("session"), F.col(item).cast("long").alias("item"), (F.col(team) == 1).alias("one"), F.col(won).alias("flag"))
    vote = F.when(F.col("flag"), 1).when(~F.col("flag"), -1).otherwise(0)
    result = (
        s.groupBy("session")
        .agg(F.sum(F.when(F.col("one"), vote).otherwise(-vote)).alias("vote"), F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n2"))
        .where("vote <> 0 and n1 > 0 and n2 > 0")
    )
    return s.join(result, "session").select(
        "session", "item", (F.col("one") == (F.col("vote") > 0)).alias("won"), (1 / F.sqrt(F.col("n1") * F.col("n2"))).alias("w"), (F.col("n1") + F.col("n2")).alias("size"))


@contextmanager
def _static(spark: SparkSession, partitions: int):
    """Plans without adaptive changes: a checkpoint keeps its partitioning only if its plan was fixed beforehand, and
    later steps then meet it without a second exchange."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n keys of which each hashes into a partition of its own, so that n packed rows fill n tasks evenly."""
    found: dict[int, int] = {}
    lo, step = 0, 40 * n + 100
    while len(found) < n:
        rows = spark.range(lo, lo + step).select(F.col("id").cast("int").alias("k")).select(F.pmod(F.hash("k"), F.lit(n)).alias("s"), "k").groupBy("s").agg(F.min("k").alias("k")).collect()
        for r in rows:
            found.setdefault(r["s"], r["k"])
        lo += step
    return [found[i] for i in range(n)]


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_py(), kind)


BLOCK = "b int, item binary, local binary, won binary, w binary, ps binary, cuts binary, ids binary"
PART = "p int, ids binary, bs binary, cuts binary, idx binary, large binary, li binary, lwon binary, lw binary"
SENT = "b int, p int, v binary, total double, moved double"


def _pack_block(key: tuple, t: pa.Table) -> pa.Table:
    session, item, p, won, w = (t.column(c).to_numpy() for c in ("session", "item", "p", "won", "w"))
    order = np.lexsort((item, p))
    si, sp = item[order], p[order]
    fresh = np.r_[True, (si[1:] != si[:-1]) | (sp[1:] != sp[:-1])]
    place = np.empty(len(item), np.int32)
    place[order] = np.cumsum(fresh) - 1
    ids, ips = si[fresh], sp[fresh]
    first, local = np.unique(session, return_index=True, return_inverse=True)[1:]
    starts = np.flatnonzero(np.r_[True, ips[1:] != ips[:-1]])
    arrays = (place, local.astype(np.int32), won.astype(np.uint8), w[first].astype(np.float64), ips[starts].astype(np.int32), np.r_[starts, len(ids)].astype(np.int64), ids.astype(np.int64))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *_bytes(*arrays)], names=[c.split()[0] for c in BLOCK.split(", ")])


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, b, ids) of every part that a block holds items of."""
    for batch in batches:
        for b, ps, cuts, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ps, cuts, ids = np.frombuffer(ps, np.int32), np.frombuffer(cuts, np.int64), np.frombuffer(ids, np.int64)
            slices = [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array([b] * len(ps), pa.int32()), pa.array(slices, pa.binary())], ["p", "b", "ids"])


def _pack_part(key: tuple, items: pa.Table, held: pa.Table) -> pa.Table:
    """items (p, item, large, won, w): large is null for the item itself, else a contest larger than a block it sits in."""
    item, large = items.column("item").to_numpy(), items.column("large").to_numpy(zero_copy_only=False)
    seat = ~np.isnan(large.astype(float)) if len(large) else np.zeros(0, bool)
    ids = np.unique(item)
    bs = held.column("b").to_numpy()
    order = np.argsort(bs)
    slices = held.column("ids").to_pylist()
    idx = [np.searchsorted(ids, np.frombuffer(slices[i], np.int64)).astype(np.int32) for i in order]
    cuts = np.r_[0, np.cumsum([len(x) for x in idx])].astype(np.int64)
    won, w = items.column("won").to_numpy(zero_copy_only=False)[seat], items.column("w").to_numpy(zero_copy_only=False)[seat]
    arrays = (
        ids.astype(np.int64), bs[order].astype(np.int32), cuts, np.concatenate(idx) if idx else np.zeros(0, np.int32),
        large[seat].astype(np.int32), np.searchsorted(ids, item[seat]).astype(np.int32), won.astype(bool).astype(np.uint8), w.astype(np.float64),
    )
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *_bytes(*arrays)], names=[c.split()[0] for c in PART.split(", ")])


def _block_step(mode: str):
    """Sums of a block: mode 'o' hands the losers' values to the winners, 'd' the winners' to the losers, 'n' counts both."""
    def run(key: tuple, block: pa.Table, sent: pa.Table) -> pa.Table:
        item, local, won, w = _read(block, "item", np.int32), _read(block, "local", np.int32), _read(block, "won", np.uint8).astype(bool), _read(block, "w", np.float64)
        ps, cuts = _read(block, "ps", np.int32), _read(block, "cuts", np.int64)
        n = int(cuts[-1])
        if mode == "n":
            out = np.stack([np.bincount(item[won], minlength=n), np.bincount(item[~won], minlength=n)]).astype(np.float64)
        else:
            x = np.empty(n)
            for p, v in zip(sent.column("p").to_pylist(), sent.column("v").to_pylist()):
                k = int(np.searchsorted(ps, p))
                x[cuts[k] : cuts[k + 1]] = np.frombuffer(v, np.float32)
            gets = won if mode == "o" else ~won
            sums = np.bincount(local[~gets], x[item[~gets]], len(w)) * w
            out = np.bincount(item[gets], sums[local[gets]], n)[None]
        slices = [np.ascontiguousarray(out[:, i:j], np.float32).tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
        none = pa.nulls(len(ps), pa.float64())
        return pa.table([pa.array([key[0].as_py()] * len(ps), pa.int32()), pa.array(ps, pa.int32()), pa.array(slices, pa.binary()), none, none], names=[c.split()[0] for c in SENT.split(", ")])

    return run


def _part_step(mode: str, smooth: float, large: dict[int, float], reach: float):
    """New values of a part from its blocks' sums; sends every block the inverse values that the next half step gives.

    mode 'start' begins with ones, 'o' and 'd' as in ``_block_step``, 'n' returns the counts. The part's values of the
    last turn come in as block STATE, to tell how far they moved."""
    def run(key: tuple, part: pa.Table, sums: pa.Table) -> pa.Table:
        p = key[0].as_py()
        n = len(_read(part, "ids", np.int64))
        bs, cuts, idx = _read(part, "bs", np.int32), _read(part, "cuts", np.int64), _read(part, "idx", np.int32)
        lg, li, lw = _read(part, "large", np.int32), _read(part, "li", np.int32), _read(part, "lw", np.float64)
        lwon = _read(part, "lwon", np.uint8).astype(bool)
        v, last = np.zeros((2 if mode == "n" else 1, n)), None
        for b, s in zip(sums.column("b").to_pylist(), sums.column("v").to_pylist()):
            if b == STATE:
                last = np.frombuffer(s)
                continue
            k = int(np.searchsorted(bs, b))
            at = idx[cuts[k] : cuts[k + 1]]
            v[:, at] += np.frombuffer(s, np.float32).reshape(len(v), len(at))
        if mode == "n":
            v[0] += np.bincount(li[lwon], minlength=n)
            v[1] += np.bincount(li[~lwon], minlength=n)
            rows = [(STATE, p, v.tobytes(), None, None)]
        else:
            v = v[0]
            if mode == "start":
                v += 1
            else:
                gets = lwon if mode == "o" else ~lwon
                v += np.bincount(li[gets], lw[gets] * np.array([large[g] for g in lg[gets].tolist()]), n) + smooth
            moved = float(np.abs(np.log(v / last)).max()) if last is not None and n else None
            if last is not None and reach != 1:
                v = last * (v / last) ** reach
            x = 1 / v
            gives = lwon if mode == "o" else ~lwon  # what is sent on is for the other half step
            rows = [(STATE, p, v.tobytes(), float(x.sum()), moved)]
            rows += [(int(b), p, x[idx[i:j]].astype(np.float32).tobytes(), None, None) for b, i, j in zip(bs, cuts[:-1], cuts[1:])]
            share = np.bincount(lg[gives], x[li[gives]]) if gives.any() else np.zeros(0)
            rows += [(LARGE, int(g), b"", float(share[g]), None) for g in np.unique(lg[gives])]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SENT.split(", ")])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, o, d, n in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.frombuffer(n).reshape(2, -1).astype(np.int64)
            arrays = [np.frombuffer(ids, np.int64), np.frombuffer(o), np.frombuffer(d), n[0], n[1]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["item", "offence", "defence", "wins", "losses"])


def rank_items(games: DataFrame, items: DataFrame, rules: RankRules = RankRules()) -> DataFrame:
    """One row per item: offence, defence, strength, wins, losses, rank (1 = strongest; ties by item), and whether the
    scaling converged to the tolerance within the given iterations.

    games: (session, item, won, w, size) as ``contests`` gives them. items: (item LONG), every item to be ranked;
    an item without a comparison gets the smoothing's strength. An item on both sides of a contest counts on
    either. Null items are no items, repeated items count once; empty tables give an empty ranking.
    """
    spark = games.sparkSession
    items = cut(items.where(F.col("item").isNotNull()).select(F.col("item").cast("long").alias("item")).distinct())
    games = cut(games)
    n = items.count()
    if n == 0:
        return spark.createDataFrame([], RESULT)
    seats = games.count()
    cores = max(1, spark.sparkContext.defaultParallelism)
    blocks = max(-(-seats // rules.block_seats), min(cores, -(-seats // rules.least)), 1)
    parts = max(-(-n // rules.part_items), min(cores, -(-n // rules.least)), 1)
    block_of, part_of = (F.array(*[F.lit(x) for x in _labels(spark, k)]) if k <= 10_000 else None for k in (blocks, parts))
    pick = lambda c, labels, k: (F.pmod(F.xxhash64(c), F.lit(k)).cast("int") if labels is None else F.get(labels, F.pmod(F.xxhash64(c), F.lit(k)).cast("int")))
    p = pick("item", part_of, parts).alias("p")

    # Contests larger than a block: fewer than seats / block_seats, so their numbers may pass the driver.
    large = {r[0]: i for i, r in enumerate(games.where(F.col("size") > rules.block_seats).select("session").distinct().collect())}
    own = items.select(p, "item", F.lit(None).cast("int").alias("large"), F.lit(None).cast("boolean").alias("won"), F.lit(None).cast("double").alias("w"))
    if large:
        numbers = F.broadcast(spark.createDataFrame(list(large.items()), f"session {games.schema['session'].dataType.simpleString()}, large int"))
        own = own.unionByName(games.where(F.col("size") > rules.block_seats).join(numbers, "session").select(p, "item", "large", "won", "w"))
    small = games.where(F.col("size") <= rules.block_seats).select(pick("session", block_of, blocks).alias("b"), "session", "item", p, "won", "w")

    with _static(spark, max(blocks, parts)):
        packed = cut(small.repartition(blocks, "b").groupBy("b").applyInArrow(_pack_block, BLOCK))
        held = packed.select("b", "ps", "cuts", "ids").mapInArrow(_routes, "p int, b int, ids binary")
        routed = cut(own.repartition(parts, "p").groupBy("p").cogroup(held.repartition(parts, "p").groupBy("p")).applyInArrow(_pack_part, PART))
        # The packed rows stand in the partitioning of their keys; only the plan has to be told.
        packed, routed = cut(packed.drop("ids").repartition(blocks, "b")), cut(routed.repartition(parts, "p"))

        def half(mode: str, sent: DataFrame | None, before: DataFrame | None, smooth: float = 0.0, shares: dict | None = None, reach: float = 1.0):
            """(checkpointed output of the parts, sum of the inverse values, largest move, shares of the large contests)."""
            if mode == "start":
                sums = spark.createDataFrame([], SENT)
            else:
                sums = packed.groupBy("b").cogroup(sent.where("b >= 0").groupBy("b")).applyInArrow(_block_step(mode), SENT)
                if before is not None:
                    sums = sums.unionByName(before.where(F.col("b") == STATE))
            seen = Observation()
            out = routed.groupBy("p").cogroup(sums.groupBy("p")).applyInArrow(_part_step(mode, smooth, shares or {}, reach), SENT)
            out = cut(out.observe(seen, F.sum(F.when(F.col("b") == STATE, F.col("total"))).alias("total"), F.max("moved").alias("moved")))
            got = {r["p"]: r["s"] for r in out.where(F.col("b") == LARGE).groupBy("p").agg(F.sum("total").alias("s")).collect()} if large else {}
            return out, seen.get["total"], seen.get["moved"], {g: got.get(g, 0.0) for g in large.values()}

        d, total, _, shares = half("start", None, None)
        counts = half("n", d, None)[0]
        o, converged, reach, before, ratio = None, False, 1.0, None, None
        for _ in range(rules.iterations):
            o, total, moved, shares = half("o", d, o if o is not None else d, rules.alpha * total / n, shares, reach)
            d, total, _, shares = half("d", o, None, rules.alpha * total / n, shares)
            if moved is not None and moved < rules.tolerance:
                converged = True
                break
            last, ratio, reach = ratio, moved / before if before else None, 1.0
            if last and ratio and ratio < 1 and abs(ratio - last) < rules.steady:
                reach, ratio = 1 / (1 - ratio), None
            before = moved
        state = lambda df, name: df.where(F.col("b") == STATE).select("p", F.col("v").alias(name))
        whole = routed.select("p", "ids").join(state(o, "o"), "p").join(state(d, "d"), "p").join(state(counts, "n"), "p").select("ids", "o", "d", "n")
        raw = cut(whole.mapInArrow(_unpack, "item long, offence double, defence double, wins long, losses long"))
    raw = raw.withColumn("_s", F.col("offence") / F.col("defence"))
    scale = raw.agg(F.exp(F.avg(F.log("_s")))).scalar()
    out = raw.select("item", "offence", "defence", (F.col("_s") / scale).alias("strength"), "wins", "losses", F.lit(converged).alias("converged"))
    return number_rows(out, [F.col("strength").desc(), "item"], "rank").select(*[c.split()[0] for c in RESULT.split(", ")])
