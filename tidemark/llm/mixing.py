"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]; the schedules add up to 1 at every t and
integrate to the target shares. A source's cumulative token demand is the integral of its schedule times the
budget. A document copy takes its place where its source's demand reaches the middle of the copy's tokens:
the demand is inverted there, and all copies are range-sorted by that time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ranks import cut, number_rows
from tidemark.llm.tokens import RANKS, with_tokens


@dataclass(frozen=True)
class MixRules:
    """budget: tokens of the mixture; None takes the largest budget at which every source with tokens and repeats reaches
    its share; the others get none.
    tilt: how strongly weights may rise or fall over the training (0 keeps them constant, below 1)."""

    budget: int | None = None
    tilt: float = 0.5
    seed: int = 17
    spread: int = 1024


def regular(c: Column) -> Column:
    """A source's regular spelling: lower case, no outer blanks, '_' for '-' and blanks."""
    return F.regexp_replace(F.lower(F.btrim(c)), "[-\\s]+", "_")


def plan_mix(available: list[tuple[str, int]], targets: list[tuple[str, float, int]], rules: MixRules) -> list[dict]:
    """Per source: tokens to take, passes, and its schedule share * (1 + tilt (2t - 1)).

    available has one row per source of the targets (bounded by that table), never one per document."""
    have = dict(available)
    live = [(s, w, r) for s, w, r in targets if s is not None and w and w > 0]
    total = sum(w for _, w, _ in live) or 1.0
    live = sorted((s, w / total, max(0, r or 0)) for s, w, r in live)
    caps = {s: have.get(s, 0) * r for s, _, r in live}
    most = min((caps[s] / w for s, w, _ in live if caps[s] > 0), default=0.0)
    budget = float(rules.budget) if rules.budget is not None else most
    raw = {s: rules.tilt * (1 - 2 * i / max(1, len(live) - 1)) for i, (s, _, _) in enumerate(live)}
    mean = sum(w * raw[s] for s, w, _ in live)
    bound = max([1.0, *(abs(raw[s] - mean) / 0.95 for s in raw)])
    out = []
    for s, w, r in live:
        want = float(min(w * budget, caps[s]))
        t = have.get(s, 0)
        out.append({"source": s, "share": w, "repeats": r, "have": t, "want": want, "passes": min(r, math.ceil(want / t)) if t else 0, "tilt": (raw[s] - mean) / bound})
    return out


def when_demanded(x: Column, tilt: Column) -> Column:
    """The t in [0, 1] at which a source has been asked for the share x of its tokens.

    Inverts D(t) = t + tilt (t^2 - t), the integral of 1 + tilt (2t - 1)."""
    root = F.sqrt(F.greatest((1 - tilt) * (1 - tilt) + 4 * tilt * x, F.lit(0.0)))
    return F.when(F.abs(tilt) < 1e-9, x).otherwise((root - (1 - tilt)) / F.when(F.abs(tilt) < 1e-9, F.lit(1.0)).otherwise(2 * tilt))


def sizes(documents: DataFrame, key: str, text: str, source: str, path: str = RANKS) -> DataFrame:
    """Checkpointed (doc_id, source, tokens) of all documents; null sources, null keys and empty texts have no place."""
    d = documents.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(F.col(key).alias("doc_id"), regular(F.col(source)).alias("source"), F.col(text).alias("_text"))
    return cut(with_tokens(d, "_text", "tokens", path, ["doc_id", "source"]).where("tokens > 0"))


def mix(sized: DataFrame, targets: DataFrame, rules: MixRules = MixRules()) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) from (doc_id, source, tokens) and (source, target_share, max_repeats).

    mixture: doc_id, source, copy (1 for the first use), tokens, position (1.. in training order). A pass
    over a source takes its documents in an order drawn per pass; the last pass ends where the demand does,
    to half a document. shares: per target source the wanted and reached share, the tokens asked for and taken, documents, copies
    and the repeats used. Sources without a target are left out; targets without documents reach 0; a
    repeated doc_id is two documents; ties are ordered by key and copy. Extra columns are ignored.
    """
    spark = sized.sparkSession
    wanted = [(r[0], r[1], r[2]) for r in targets.groupBy(regular(F.col("source")).alias("source")).agg(F.max("target_share"), F.max("max_repeats")).collect()]
    have = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(spark.createDataFrame([(w[0],) for w in wanted], "source string")), "source").collect()]
    plan = plan_mix(have, wanted, rules)
    table = spark.createDataFrame([tuple(p.values()) for p in plan], "source string, share double, repeats int, have long, want double, passes int, tilt double")
    copies = (
        sized.select("doc_id", "source", "tokens").join(F.broadcast(table.where("passes > 0")), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("_h", F.xxhash64("doc_id", "copy", F.lit(rules.seed)))
        .withColumn("_cell", F.pmod("_h", F.lit(rules.spread)))
    )
    # Running tokens per source and pass in two steps, so that no source is one task: over the hash cells, then inside each.
    cells = copies.groupBy("source", "copy", "_cell").agg(F.sum("tokens").alias("_t"))
    earlier = Window.partitionBy("source").orderBy("copy", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "copy", "_cell", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("source", "copy", "_cell").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.withColumn("_upto", F.sum("tokens").over(inside)).join(starts, ["source", "copy", "_cell"])
    middle = F.col("_from") + F.col("_upto") - F.col("tokens") / 2
    taken = placed.where(middle < F.col("want")).select("doc_id", "source", "copy", "tokens", when_demanded(middle / F.col("want"), F.col("tilt")).alias("_time"))
    mixture = number_rows(taken, ["_time", "source", "doc_id", "copy"], "position").select("doc_id", "source", "copy", "tokens", "_time", "position").withColumnRenamed("_time", "time")
    used = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_repeats"))
    whole = mixture.agg(F.sum("tokens")).scalar()
    shares = table.join(used, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("have").alias("available_tokens"), F.col("want").alias("asked_tokens"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
    )
    return mixture, shares
