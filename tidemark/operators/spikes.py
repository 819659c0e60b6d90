"""Implausible readings per source: tail cutoffs by peaks over threshold, stuck values, impossible values.

The three readings of a record form a chain (first -> second -> third, e.g. length -> mass -> experience);
each source has its own power-law curve for either link. All rows are reduced in one pass to a grid of
log-values per source and season whose size is bounded by the value range, not by the rows. One small
group per source then fits the curves (trimmed least squares), takes off the seasonal medians and fits a
generalised Pareto distribution to the residuals' exceedances; its quantile at a fixed risk is the
source's cutoff, whatever its size. Rows, stuck runs and parameters meet in one partitioning by source and
day, so that a source with a third of all rows is spread over its days.

Every reading comes out with the rule that caught it. A spike's distance from its source's curve is kept
as ``factor``, and ``implausible`` reports the spikes that are also off by the stated factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SEASONS = 4
TAILS = "src string, link int, rows long, a double, b double, s array<double>, u double, rate double, half double, shape double, n_tail double, place array<int>, weight array<double>"
BORDERS = "src string, c date, field int, before long, after long"


@dataclass(frozen=True)
class SpikeRules:
    """risk: probability that an ordinary reading exceeds the cutoff under the fitted tail. threshold: quantile over
    which the tail is fitted. ordinary: the ratio within which two readings fit each other. case: the ratio from
    which a spike is reported by ``implausible``; it has no part in the fit. stuck: shortest reported run."""

    risk: float = 1e-4
    threshold: float = 0.8
    ordinary: float = 3.0
    case: float = 4.0
    stuck: int = 6
    grid: float = 0.05
    bin: float = 0.02
    pool: float = 200.0
    least_rows: int = 20


def _quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
    """Weighted quantile of ascending values."""
    return float(x[min(len(x) - 1, int(np.searchsorted(np.cumsum(w), q * w.sum())))])


def tail_level(u: float, rate: float, half: float, shape: float, risk: float) -> float:
    """What a generalised Pareto tail over u exceeds with probability ``risk``; half is the exceedances' median."""
    if abs(shape) < 1e-6:
        return u + half / np.log(2) * np.log(rate / risk)
    return u + half / (2**shape - 1) * ((risk / rate) ** (-shape) - 1)


def tail_fit(r: np.ndarray, w: np.ndarray, q: float, risk: float) -> tuple[float, float, float, float, float]:
    """(u, rate, half, shape, n) of the tail of r over its quantile q: threshold, share, median and shape of the
    exceedances and their weight; n is 0 without five of them.

    Wild readings must not stretch the tail that is to tell them apart, so the first tail is the exponential one through
    the exceedances' median, which a share of wild ones hardly moves; what lies beyond its level is left out, and
    the shape is fitted by probability-weighted moments, again and again until nothing more falls out."""
    order = np.argsort(r)
    r, w = r[order], w[order]
    out = (float(r[-1]) if len(r) else 0.0, 1.0, 0.0, 0.0, 0.0)
    for turn in range(25 if len(r) else 0):
        total = w.sum()
        u = _quantile(r, w, q)
        y, v = r[r > u] - u, w[r > u]
        n = v.sum()
        if n < 5:
            return out
        half = _quantile(y, v, 0.5)
        if turn == 0:
            shape = 0.0
        else:
            mean = float((y * v).sum() / n)
            above = 1 - (np.cumsum(v) - v / 2) / n  # share of exceedances above each
            second = float((y * v * above).sum() / n)
            shape = float(np.clip(2 - mean / (mean - 2 * second), -1, 0.5)) if mean > 2 * second + 1e-12 else 0.5
        out = (u, float(n / total), half, shape, float(n))
        inside = r <= tail_level(*out[:4], risk)
        if inside.all() and turn:
            break
        r, w = r[inside], w[inside]
    return out


def fit_link(x: np.ndarray, y: np.ndarray, w: np.ndarray, season: np.ndarray, rules: SpikeRules):
    """(a, b, season offsets, residual sizes) of y ~ a + b x over weighted grid cells; NaN and no residuals for too few rows."""
    nothing = (float("nan"), float("nan"), [0.0] * SEASONS, np.zeros(0))
    if w.sum() < rules.least_rows or np.ptp(x) < 1e-9:
        return nothing

    def median(v: np.ndarray, k: np.ndarray) -> float:
        o = np.argsort(v)
        return _quantile(v[o], k[o], 0.5)

    # Start: medians of x-slices, which a few per cent of wild readings cannot move.
    edges = np.interp(np.linspace(0, 1, 9), np.cumsum(w[np.argsort(x)]) / w.sum(), np.sort(x))
    px, py = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        s = (x >= lo) & (x <= hi)
        if s.any():
            px.append(median(x[s], w[s]))
            py.append(median(y[s], w[s]))
    px, py = np.array(px), np.array(py)
    slopes = [(py[j] - py[i]) / (px[j] - px[i]) for i in range(len(px)) for j in range(i + 1, len(px)) if px[j] - px[i] > 1e-9]
    b = float(np.median(slopes)) if slopes else 0.0
    a = median(y - b * x, w)
    for _ in range(6):
        k = np.where(np.abs(y - a - b * x) < np.log(rules.ordinary), w, 0.0)
        if k.sum() < 3:
            break
        mx, my = (k * x).sum() / k.sum(), (k * y).sum() / k.sum()
        var = (k * (x - mx) ** 2).sum()
        if var < 1e-9:
            break
        b = float((k * (x - mx) * (y - my)).sum() / var)
        a = float(my - b * mx)
    r = y - a - b * x
    offsets = []
    for s in range(SEASONS):
        m = (season == s) & (np.abs(r) < np.log(rules.ordinary))
        n = w[m].sum()
        offsets.append(float(median(r[m], w[m]) * n / (n + 50)) if n else 0.0)
    return a, b, offsets, np.abs(r - np.array(offsets)[season])


def _season(at: Column) -> Column:
    return F.floor(F.hour(at) * SEASONS / 24).cast("int")


def clean_readings(table: DataFrame, record: str, source: str, at: str, chain: tuple[str, str, str]) -> DataFrame:
    """Checkpointed (id, src, at, x0, x1, x2): repeated records once (the first by value order), sources folded;
    rows with a null id, source or time are left out."""
    return cut(
        table.select(F.col(record).alias("id"), F.lower(F.btrim(F.col(source))).alias("src"), F.col(at).alias("at"), *[F.col(c).cast("long").alias(f"x{i}") for i, c in enumerate(chain)])
        .where(F.col("id").isNotNull() & F.col("src").isNotNull() & F.col("at").isNotNull())
        .groupBy("id").agg(F.min(F.struct("src", "at", "x0", "x1", "x2")).alias("r")).select("id", "r.*")
    )


def source_curves(rows: DataFrame, rules: SpikeRules) -> DataFrame:
    """One parameter row per source from rows (src, at, x0, x1, x2): n, and per link the curve a, b, the seasonal offsets s
    and the cutoff of a residual's size.

    A source with few exceedances does not show the shape of its own tail, so its shape is drawn to that of all
    sources' exceedances together, each divided by its source's median, as ``pool`` exceedances would draw it;
    threshold and scale stay the source's own. The joint tail is one histogram of bounded size per link."""
    cells = F.explode(F.array(*[
        F.when((F.col(f"x{n - 1}") > 0) & (F.col(f"x{n}") > 0), F.struct(F.lit(n).alias("link"), F.log(F.col(f"x{n - 1}").cast("double")).alias("lx"), F.log(F.col(f"x{n}").cast("double")).alias("ly")))
        for n in (1, 2)
    ])).alias("_l")
    grid = (
        rows.select("src", _season(F.col("at")).alias("season"), cells).where("_l is not null").select("src", "season", "_l.*")
        .groupBy("src", "link", "season", F.floor(F.col("lx") / rules.grid).alias("gx"), F.floor(F.col("ly") / rules.grid).alias("gy"))
        .agg(F.count("*").alias("n"), F.avg("lx").alias("lx"), F.avg("ly").alias("ly"))
    )

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in (1, 2):
            h = g[g.link == k].sort_values(["season", "gx", "gy"])
            w = h.n.to_numpy(float)
            a, b, s, r = fit_link(h.lx.to_numpy(), h.ly.to_numpy(), w, h.season.to_numpy(int), rules)
            u, rate, half, shape, n = tail_fit(r, w[: len(r)], rules.threshold, rules.risk)
            z = np.minimum((r[r > u] - u) / half / rules.bin, 2**20).astype(int) if n and half > 0 else np.zeros(0, int)
            place, sums = np.unique(z, return_inverse=True) if len(z) else (z, z)
            out.append((key[0], k, int(w.sum()), a, b, s, u, rate, half, shape, n, place.tolist(), np.bincount(sums, w[: len(r)][r > u]).tolist() if len(z) else []))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TAILS.split(", ")])

    def pooled(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, _, _, shape, n = tail_fit((g.z.to_numpy(float) + 0.5) * rules.bin, g.w.to_numpy(float), 0.0, rules.risk / (1 - rules.threshold))
        return pd.DataFrame({"link": [key[0]], "common": [shape if n else 0.0]})

    tails = cut(grid.groupBy("src").applyInPandas(fit, TAILS))
    shares = tails.select("link", F.explode(F.arrays_zip("place", "weight")).alias("e")).groupBy("link", F.col("e.place").alias("z")).agg(F.sum("e.weight").alias("w"))
    common = shares.groupBy("link").applyInPandas(pooled, "link int, common double")
    t = tails.join(common, "link", "left").withColumn("shape", (F.col("shape") * F.col("n_tail") + F.coalesce("common", F.lit(0.0)) * rules.pool) / (F.col("n_tail") + rules.pool))
    power = F.pow(rules.risk / F.col("rate"), -F.col("shape"))
    level = F.when(F.abs("shape") < 1e-6, F.col("u") + F.col("half") / float(np.log(2)) * F.log(F.col("rate") / rules.risk)).otherwise(F.col("u") + F.col("half") / (F.pow(F.lit(2.0), F.col("shape")) - 1) * (power - 1))
    t = t.withColumn("cutoff", F.when(F.col("n_tail") > 0, level).otherwise(F.col("u")))
    of = lambda c, k: F.max(F.when(F.col("link") == k, F.col(c)))
    return t.groupBy("src").agg(of("rows", 1).alias("n"), *[of(c, k).alias(f"{n}{k}") for k in (1, 2) for c, n in (("a", "a"), ("b", "b"), ("s", "s"), ("cutoff", "cut"))])


def _carry(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Readings of a run that lie in earlier and later days, from one summary row per day of a (source, field)."""
    g = g.sort_values("c")
    first, last, head, tail, single = (g[c].to_numpy() for c in ("first_v", "last_v", "head", "tail", "single"))
    n = len(g)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, n):
        if last[i - 1] == first[i]:
            before[i] = tail[i - 1] + (before[i - 1] if single[i - 1] else 0)
    for i in range(n - 2, -1, -1):
        if last[i] == first[i + 1]:
            after[i] = head[i + 1] + (after[i + 1] if single[i + 1] else 0)
    return pd.DataFrame({"src": key[0], "c": g["c"], "field": key[1], "before": before, "after": after})


def run_lengths(rows: DataFrame, fields: int = 3) -> DataFrame:
    """Rows (id, src, at, x0..) with ``n0``..: the length of the run of equal consecutive values each reading is in.

    Runs follow (at, id) within a source and skip nulls (length 0). They are measured inside (source, day) by
    two ordered passes over all fields at once. A run that crosses midnight is completed from one summary row
    per source, field and day, so neither a hot source nor one that is frozen for good gathers in one task."""
    k = range(fields)
    r = rows.withColumn("c", F.to_date("at"))
    up = Window.partitionBy("src", "c").orderBy("at", "id")
    down = Window.partitionBy("src", "c").orderBy(F.col("at").desc(), F.col("id").desc())
    so_far, earlier, later = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    r = r.select("*", *[F.count(f"x{i}").over(so_far).alias(f"_i{i}") for i in k], *[F.last(f"x{i}", True).over(earlier).alias(f"_p{i}") for i in k])
    starts = [F.when(F.col(f"x{i}").isNotNull() & ~F.col(f"x{i}").eqNullSafe(F.col(f"_p{i}")), F.col(f"_i{i}")) for i in k]
    r = r.select("*", *[s.alias(f"_s{i}") for i, s in enumerate(starts)])
    r = r.select("*", *[F.last(f"_s{i}", True).over(so_far).alias(f"_a{i}") for i in k])
    # In falling order the starts seen so far are those of later runs; the last of all readings ends the last run.
    r = r.select("*", *[F.last(f"_s{i}", True).over(later).alias(f"_z{i}") for i in k], *[F.max(f"_i{i}").over(Window.partitionBy("src", "c")).alias(f"_t{i}") for i in k])
    r = r.select("*", *[(F.coalesce(F.col(f"_z{i}"), F.col(f"_t{i}") + 1) - F.col(f"_a{i}")).alias(f"_n{i}") for i in k])
    days = r.groupBy("src", "c").agg(*[
        F.struct(
            F.lit(i).alias("field"), F.min_by(f"x{i}", F.when(F.col(f"x{i}").isNotNull(), F.col(f"_i{i}"))).alias("first_v"), F.max_by(f"x{i}", F.when(F.col(f"x{i}").isNotNull(), F.col(f"_i{i}"))).alias("last_v"),
            F.max(F.when(F.col(f"_s{i}") == 1, F.col(f"_n{i}"))).alias("head"), F.max(F.when(F.col(f"_z{i}").isNull() & F.col(f"x{i}").isNotNull(), F.col(f"_n{i}"))).alias("tail"),
            (F.max(f"_a{i}") == 1).alias("single"),
        ).alias(f"f{i}") for i in k])
    summary = days.select("src", "c", F.explode(F.array(*[f"f{i}" for i in k])).alias("f")).select("src", "c", "f.*").where("first_v is not null")
    borders = summary.groupBy("src", "field").applyInPandas(_carry, BORDERS).where("before > 0 or after > 0")
    wide = borders.groupBy("src", "c").agg(*[x for i in k for x in (F.max(F.when(F.col("field") == i, F.col("before"))).alias(f"_b{i}"), F.max(F.when(F.col("field") == i, F.col("after"))).alias(f"_e{i}"))])
    r = r.join(wide, ["src", "c"], "left")
    zero = F.lit(0).cast("long")
    whole = [
        F.when(F.col(f"x{i}").isNotNull(), F.col(f"_n{i}") + F.when(F.col(f"_a{i}") == 1, F.coalesce(f"_b{i}", zero)).otherwise(0) + F.when(F.col(f"_z{i}").isNull(), F.coalesce(f"_e{i}", zero)).otherwise(0)).otherwise(0).alias(f"n{i}")
        for i in k
    ]
    return r.select(*rows.columns, *whole)


def judged(rows: DataFrame, rules: SpikeRules = SpikeRules(), names: tuple[str, str, str] = ("x0", "x1", "x2")) -> DataFrame:
    """(id, field, rule, factor) of every reading that a rule catches; a reading may be caught by several.

    impossible: zero or negative. stuck: in a run of ``stuck`` or more equal values. spike: beyond the source's
    fitted cutoff against its neighbour in the chain, while the two other readings fit each other and neither
    of them is in a stuck run, which shows nothing about the record; ``factor`` is the ratio to what the curve
    shows (1 or more), null for the other rules. rows are those of ``clean_readings``."""
    runs = run_lengths(rows)
    r = runs.join(source_curves(rows, rules), "src", "left")
    o = {n: F.get(f"s{n}", _season(F.col("at"))) for n in (1, 2)}
    log = [F.when(F.col(f"x{i}") > 0, F.log(F.col(f"x{i}").cast("double"))) for i in range(3)]
    r = r.select("id", "x0", "x1", "x2", "n0", "n1", "n2", "b1", "b2", "cut1", "cut2", (log[1] - F.col("a1") - F.col("b1") * log[0] - o[1]).alias("r1"), (log[2] - F.col("a2") - F.col("b2") * log[1] - o[2]).alias("r2"),
                 (log[2] - F.col("a2") - F.col("b2") * (F.col("a1") + F.col("b1") * log[0] + o[1]) - o[2]).alias("r3"))
    frozen = [F.col(f"n{i}") >= rules.stuck for i in range(3)]
    fits = lambda x: F.abs(F.col(x)) <= float(np.log(rules.ordinary))
    beyond = lambda x, c: F.abs(F.col(x)) > F.col(c)
    # The second reading is judged by the first as the third confirms it; its own two residuals then point apart.
    spike = [
        (~frozen[1] & ~frozen[2] & fits("r2") & beyond("r1", "cut1"), F.abs(F.try_divide(F.col("r1"), F.col("b1")))),
        (~frozen[0] & ~frozen[2] & fits("r3") & beyond("r1", "cut1") & (F.signum("r1") != F.signum("r2")), F.abs("r1")),
        (~frozen[0] & ~frozen[1] & fits("r1") & beyond("r2", "cut2"), F.abs("r2")),
    ]
    none = F.lit(None).cast("double")
    caught = []
    for i, n in enumerate(names):
        for rule, when, factor in (("impossible", F.col(f"x{i}") <= 0, none), ("stuck", frozen[i], none), ("spike", spike[i][0], F.exp(spike[i][1]))):
            caught.append(F.when(when, F.struct(F.lit(n).alias("field"), F.lit(rule).alias("rule"), factor.alias("factor"))))
    return r.select("id", F.explode(F.filter(F.array(*caught), lambda v: v.isNotNull())).alias("v")).select("id", "v.*")


def implausible(
    table: DataFrame, record: str, source: str, at: str, chain: tuple[str, str, str], rules: SpikeRules = SpikeRules()
) -> DataFrame:
    """(record id, field) of every untrustworthy reading of the three fields of ``chain``.

    The readings that ``judged`` catches, of the spikes those that are off by the factor ``case`` or more.
    Repeated records count once; null readings are left out; rows with a null id, source or time are left
    out; sources are compared without case and outer blanks. Sources with fewer than ``least_rows`` rows have
    no curve, so only the other rules apply. Ties in time are ordered by id. Empty table: empty result. Extra
    columns are ignored.
    """
    found = judged(clean_readings(table, record, source, at, chain), rules, chain)
    return found.where((F.col("rule") != "spike") | (F.col("factor") >= rules.case)).select(F.col("id").alias(record), "field").distinct()
