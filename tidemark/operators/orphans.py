"""References to records that do not exist, or are not alive at the time of the reference.

1. A Bloom filter of each parent's keys (a bit array built with ``bit_or``, held in a scalar subquery, so that
   it reaches every task once) proves that a reference whose bits are not all set is an orphan.
2. Only the filter-positive references are verified. Parents below ``small`` rows (counted first) are
   broadcast to an exact anti-join. All larger ones go through one exchange: references and lifetimes meet
   in the order of time under their key, and a reference is alive when the running maximum of the lifetimes'
   ends lies behind its time. A proven orphan passes through without a key.
3. Keys that hold more than one in ``hot`` of the references or lifetimes (so fewer than ``hot`` a field each) are
   also split by time at quantiles of the references; one row per earlier chunk carries the ends across.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = 2**63 - 1


@dataclass(frozen=True)
class Link:
    """A field of the references and the table that it names records of; ``start`` and ``end`` bound a record's life."""

    field: str
    key: Column
    parents: DataFrame
    parent_key: Column
    start: str
    end: str


def bloom_size(rows: int, bits_per_key: int = 12, most_bits: int = 1 << 28) -> tuple[int, int]:
    """(bits, hashes) of the filter: a power of two near ``bits_per_key`` bits a key, ``most_bits`` (32 MB) at most.

    The number of hashes is the best one for the bits that a key gets. At the bound, 100 million keys have 2.7 bits
    each and the filter still proves seven in ten orphans; beyond it proves fewer and the result stays exact, as
    every positive is verified."""
    bits = max(1 << 12, min(most_bits, 1 << math.ceil(math.log2(max(1, rows) * bits_per_key))))
    return bits, max(1, min(6, round(bits / max(1, rows) * math.log(2))))


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    """Double hashing: both halves of one 64-bit hash give all places."""
    h = F.xxhash64(key)
    first, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(first + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def bloom_words(keys: DataFrame, bits: int, hashes: int) -> Column:
    """The filter over the only column of ``keys`` as a scalar subquery of ARRAY<BIGINT> (64 bits a word).

    Null keys are not entered. An empty table gives an array of zeros."""
    k = F.col(keys.columns[0])
    spark = keys.sparkSession
    words = (
        keys.where(k.isNotNull())
        .select(F.explode(F.array(*_places(k, bits, hashes))).alias("_b"))
        .groupBy(F.shiftright("_b", 6).alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_x"))
    )
    dense = spark.range(bits // 64).withColumnRenamed("id", "_w").join(words, "_w", "left").select("_w", F.coalesce("_x", F.lit(0).cast("long")).alias("_x"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_x"))), lambda s: s["_x"]).alias("_words")).scalar()


def might_contain(words: Column, key: Column, bits: int, hashes: int) -> Column:
    """False only if the key was certainly not entered."""
    out = F.lit(True)
    for p in _places(key, bits, hashes):
        out = out & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return out


def lifetimes(parents: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """Distinct (k, s, e) of a parent table. Null start: never alive. Null end: open. Empty intervals go."""
    return (
        parents.select(key.alias("k"), F.col(start).alias("s"), F.coalesce(F.col(end), F.lit(FOREVER)).alias("e"))
        .where(F.col("k").isNotNull() & F.col("s").isNotNull() & (F.col("s") < F.col("e")))
        .distinct()
    )


def orphans(
    refs: DataFrame, ref_id: str, at: str, links: list[Link], small: int = 50_000, most_bits: int = 1 << 28, hot: int = 64, chunks: int = 32,
) -> DataFrame:
    """One row (id LONG, field) per reference of ``refs`` that no record of the field's parents covers at its time.

    A record covers ``start <= at < end``; a null end is open, a null start never covers. Null keys are no
    references; a reference with a null time names nothing alive, so it is an orphan. Repeated parents and
    several lives of a key: one that covers is enough. ``ref_id`` should be unique; ids that repeat are
    reported as often as they dangle. Empty parents: every reference is an orphan. Extra columns of either
    table are ignored.
    """
    base = refs.select(F.col(ref_id).cast("long").alias("id"), F.col(at).alias("t"), *[x.key.alias(f"k{i}") for i, x in enumerate(links)])
    whole = [t in ("tinyint", "smallint", "int", "bigint") for t in (base.schema[f"k{i}"].dataType.simpleString() for i in range(len(links)))]

    def keyed(i: int, k: str) -> list[Column]:
        """The key as a number or as text, the other null."""
        k = F.col(k)
        return [(k.cast("long") if whole[i] else F.lit(None).cast("long")).alias("n"), (F.lit(None).cast("string") if whole[i] else k.cast("string")).alias("x")]

    lives = [lifetimes(x.parents, x.parent_key, x.start, x.end) for x in links]
    sizes = [x.count() for x in lives]
    lives = [x.select(F.lit(i).alias("f"), *keyed(i, "k"), "s", "e") for i, x in enumerate(lives)]
    maybe = []
    for i, x in enumerate(links):
        bits, hashes = bloom_size(sizes[i], most_bits=most_bits)
        # Hashed like the references: by the number or the text, whatever the parent's own type is.
        words = bloom_words(lives[i].select("n" if whole[i] else "x"), bits, hashes)
        k = F.col(f"k{i}").cast("long" if whole[i] else "string")
        maybe.append((F.col("t").isNotNull() & might_contain(words, k, bits, hashes)).alias(f"m{i}"))

    def cells(df: DataFrame, which: list[int], *more) -> DataFrame:
        parts = [F.when(F.col(f"k{i}").isNotNull(), F.struct(F.lit(i).alias("f"), *keyed(i, f"k{i}"), *[F.col(f"{m}{i}").alias(m) for m in more])) for i in which]
        return df.select("id", "t", F.explode(F.array(*parts)).alias("c")).where("c is not null").select("id", "t", "c.*")

    asked = cells(base.select("*", *maybe), list(range(len(links))), "m")
    name = F.element_at(F.array(*[F.lit(x.field) for x in links]), F.col("f") + 1).alias("field")
    few, many = [i for i, n in enumerate(sizes) if n <= small], [i for i, n in enumerate(sizes) if n > small]
    if few:
        near = lives[few[0]]
        for i in few[1:]:
            near = near.unionByName(lives[i])
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("f", "n", "x")]
        asked = asked.alias("a").join(F.broadcast(near).alias("b"), [*same, F.col("a.m"), F.col("b.s") <= F.col("a.t"), F.col("a.t") < F.col("b.e")], "left_anti")
    if not many:
        return asked.select("id", name)
    key = ["f", "n", "x"]
    far = lives[many[0]]
    for i in many[1:]:
        far = far.unionByName(lives[i])
    total, edges = base.agg(F.count("*"), F.percentile_approx("t", [i / chunks for i in range(1, chunks)], 1000)).first()
    often = [r for df, least in ((cells(base, many).select(*key), total), (far, max(sizes))) for r in df.groupBy(*key).count().where(F.col("count") > max(least / hot, 1000)).collect()]
    is_hot = F.lit(False)
    for i in many:
        hits = {r["n"] if whole[i] else r["x"] for r in often if r["f"] == i}
        if hits:
            is_hot = is_hot | ((F.col("f") == i) & F.col("n" if whole[i] else "x").isin(*hits))
    steps = F.array(*[F.lit(e) for e in sorted(set(edges or []))] or [F.lit(0)])
    chunk = lambda t: F.when(is_hot, F.size(F.filter(steps, lambda e: e <= F.col(t))).cast("long")).otherwise(F.lit(-1).cast("long")).alias("c")
    none = F.lit(None).cast("long")
    open_ = F.col("m") & F.col("f").isin(*many)
    events = asked.select("f", *[F.when(open_, F.col(c)).alias(c) for c in ("n", "x")], F.when(open_, chunk("t")).otherwise(F.col("id")).alias("c"), "t", none.alias("e"), F.lit(1).alias("o"), "id", open_.alias("open"))
    starts = far.select(*key, chunk("s"), F.col("s").alias("t"), "e", F.lit(0).alias("o"), none.alias("id"), F.lit(True).alias("open"))
    carried = (
        starts.where("c >= 0").groupBy(*key, "c").agg(F.max("e").alias("e"))
        .select(*key, "e", F.explode(F.sequence(F.col("c") + 1, F.lit(chunks).cast("long"))).alias("c")).groupBy(*key, "c").agg(F.max("e").alias("e"))
        .select(*key, "c", none.alias("t"), "e", F.lit(0).alias("o"), none.alias("id"), F.lit(True).alias("open"))
    )
    so_far = Window.partitionBy(*key, "c").orderBy(F.col("t").asc_nulls_first(), "o").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(starts).unionByName(carried).select("id", "f", "t", "open", F.max("e").over(so_far).alias("until"))
    return seen.where(F.col("id").isNotNull() & (~F.col("open") | F.col("until").isNull() | (F.col("until") <= F.col("t")))).select("id", name)


def orphan_report(refs: DataFrame, found: DataFrame, key: str, at: str) -> DataFrame:
    """Orphans per referenced field and UTC day: (field, day, orphans). ``found`` has (``key``, field)."""
    day = F.to_date(F.timestamp_millis(F.col(at)))
    return (
        found.join(refs.select(F.col(key), day.alias("day")), key)
        .groupBy("field", "day").agg(F.count("*").alias("orphans"))
    )
