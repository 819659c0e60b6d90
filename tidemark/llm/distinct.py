"""Distinct counts over huge identifier sets by stochastic averaging (bit matrices of hash ranks).

A sketch is a matrix of ``buckets`` rows of 64 bits: an identifier's hash picks a row by its low bits and sets
the bit of the lowest one in the rest. Matrices of any groups merge by bitwise or, so days can be added up
later, from the rows that ``distinct_counts`` returns beside the groups' figures. The count is the maximum-likelihood estimate under the Poisson model of the bits, and its variance is
the inverse Fisher information less the part that the Poisson model adds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

RANKS = 52


def sketch_rows(rows: DataFrame, groups: dict[str, Column], identifiers: dict[str, Column], log2_buckets: int = 11) -> DataFrame:
    """(groups..., field, bucket INT, bits BIGINT): the non-empty matrix rows of every group and identifier.

    Partial aggregation sets the bits before the shuffle: a group that holds a third of all rows sends at
    most ``buckets`` rows per task. Null identifiers are not counted; null group values form a group.
    """
    ids = F.array(*[F.struct(F.lit(n).alias("field"), F.xxhash64(c).alias("h"), c.isNull().alias("none")) for n, c in identifiers.items()])
    cells = rows.select(*[c.alias(n) for n, c in groups.items()], F.explode(ids).alias("_i")).where("not _i.none")
    rest = F.shiftrightunsigned(F.col("_i.h"), log2_buckets)
    lowest = F.when(rest == 0, F.lit(1 << RANKS)).otherwise(rest.bitwiseAND(-rest))
    return (
        cells.select(*groups, "_i.field", F.col("_i.h").bitwiseAND((1 << log2_buckets) - 1).cast("int").alias("bucket"), lowest.alias("b"))
        .groupBy(*groups, "field", "bucket").agg(F.bit_or("b").alias("bits"))
    )


def merge(sketches: DataFrame, keep: list[str]) -> DataFrame:
    """Bitwise union of matrices over all group columns that are not in ``keep``."""
    return sketches.groupBy(*keep, "field", "bucket").agg(F.bit_or("bits").alias("bits"))


def likeliest(counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors from the numbers of buckets in which each rank's bit is set."""
    w = 2.0 ** -(np.arange(counts.shape[1]) + 1)
    lo, hi = np.full(len(counts), -40.0), np.full(len(counts), 50.0)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(80):
            mid = (lo + hi) / 2
            x = np.exp(mid)[:, None] * w
            slope = (counts * w / np.expm1(x) - (buckets - counts) * w).sum(1)
            lo, hi = np.where(slope > 0, mid, lo), np.where(slope > 0, hi, mid)
        rate = np.exp((lo + hi) / 2)
        info = (w**2 / np.expm1(rate[:, None] * w)).sum(1)
    n = np.where(counts.sum(1) > 0, rate * buckets, 0.0)
    return n, np.sqrt(np.maximum(np.where(n > 0, buckets / np.where(info > 0, info, np.inf) - n, 0.0), 0.0))


def estimate(sketches: DataFrame, groups: list[str], log2_buckets: int = 11, z: float = 2.576) -> DataFrame:
    """One row per group and field: estimate, std_error, lower, upper (z standard errors; 99 % by default)."""
    buckets = 1 << log2_buckets

    @F.pandas_udf("n double, se double")
    def fit(c: pd.Series) -> pd.DataFrame:
        n, se = likeliest(np.stack(c.to_list()).astype(float), buckets)
        return pd.DataFrame({"n": n, "se": se})

    bit = lambda k: F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1).cast("long")))
    whole = sketches.groupBy(*groups, "field").agg(F.array(*[bit(k) for k in range(RANKS + 1)]).alias("_c"), F.count("*").alias("_rows"))
    # An identifier leaves at least one bit, so no group has fewer identifiers than non-empty rows.
    return whole.withColumn("_e", fit("_c")).select(
        *groups, "field",
        F.round("_e.n").cast("long").alias("estimate"),
        F.col("_e.se").alias("std_error"),
        F.greatest(F.floor(F.col("_e.n") - z * F.col("_e.se")), F.col("_rows")).cast("long").alias("lower"),
        F.ceil(F.col("_e.n") + z * F.col("_e.se")).cast("long").alias("upper"),
    )


def level_sketches(rows: DataFrame, first: tuple[str, Column], second: tuple[str, Column], identifiers: dict[str, Column], log2_buckets: int = 11) -> DataFrame:
    """(level, first, second, field, bucket, bits): the matrix rows per first key, per second key and per combination.

    The combinations' matrices are built in one pass over the rows; both roll-ups merge those matrices.
    ``level`` separates "all values" from a null key."""
    (a, ca), (b, cb) = first, second
    base = sketch_rows(rows, {a: ca, b: cb}, identifiers, log2_buckets)
    null = lambda c: F.lit(None).cast(base.schema[c].dataType)
    levels = F.explode(F.array(
        F.struct(F.lit(f"{a},{b}").alias("level"), F.col(a), F.col(b)),
        F.struct(F.lit(a).alias("level"), F.col(a), null(b).alias(b)),
        F.struct(F.lit(b).alias("level"), null(a).alias(a), F.col(b)),
    )).alias("_l")
    return merge(base.select(levels, "field", "bucket", "bits").select("_l.*", "field", "bucket", "bits"), ["level", a, b])


def group_counts(rows: DataFrame, first: tuple[str, Column], second: tuple[str, Column], identifiers: dict[str, Column], log2_buckets: int = 11, z: float = 2.576) -> DataFrame:
    """One row per level, group and field with its estimate and bounds; ``distinct_counts`` without the matrices."""
    return estimate(level_sketches(rows, first, second, identifiers, log2_buckets), ["level", first[0], second[0]], log2_buckets, z)


def distinct_counts(
    rows: DataFrame, first: tuple[str, Column], second: tuple[str, Column], identifiers: dict[str, Column], log2_buckets: int = 11
) -> DataFrame:
    """Per first key, per second key and per combination (column ``level`` tells which): the non-empty rows of the
    group's matrix (bucket, bits) with the group's estimate, standard error and 99 % bounds.

    This is the form in which groups can be added up later: ``merge`` over the days in question, then ``estimate``.
    Empty table: empty result. Repeated rows do not count twice. Other columns are ignored. The matrices are
    checkpointed once, as both the figures and the result read them.
    """
    matrices = cut(level_sketches(rows, first, second, identifiers, log2_buckets))
    keys = ["level", first[0], second[0]]
    figures = estimate(matrices, keys, log2_buckets)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*keys, "field")]
    # One small row per group: the planner broadcasts it where its measured size allows, else both sides are shuffled.
    return matrices.alias("m").join(figures.alias("g"), same).select(*[f"m.{c}" for c in (*keys, "field", "bucket", "bits")], "g.estimate", "g.std_error", "g.lower", "g.upper")
