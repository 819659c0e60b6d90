"""Rows that fail to parse: typed records on one side, rejected lines with their reasons on the other.

Structure (quoting, column counts, braces, keys) is checked per line with array expressions. Values are
checked and cast once per distinct value of a column: the lines are unfolded to (column, value), and the
distinct pairs form a dictionary of typed values and reasons. Its invalid part is joined back for the
rejected lines, its valid part for the records, so no line is cast again. Values that fill more than one
in ``HOT`` of a column (at most that many a column) are looked up in a broadcast, the others by a shuffle
in which no value is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

SEP, ESC = "\u0001", "\u0002"
BLANKS = " \t"
HOT = 64


@dataclass(frozen=True)
class Field:
    """One column of a record. kind: int, hex, flag or text; lo/hi bound integers (inclusive)."""

    name: str
    kind: str
    sql_type: str
    lo: int | None = None
    hi: int | None = None
    may_be_empty: bool = False
    checked: bool = True


@dataclass(frozen=True)
class Format:
    """style 'quoted': positional fields separated by sep, optional double quotes.
    style 'pairs': ``key:value`` entries in any order; fields in ``required`` must be present."""

    style: str
    fields: tuple[Field, ...]
    sep: str = ";"
    required: tuple[str, ...] = ()


BATTLE_FORMAT = Format(
    "quoted",
    (
        Field("user_id", "int", "bigint", 1, 2**63 - 1),
        Field("session_id", "hex", "decimal(20,0)"),
        Field("commit_time", "int", "bigint", 1262304000000, 1735689599999),
        Field("team", "int", "tinyint", 1, 2),
        Field("battle_score", "int", "bigint", 0, 2**32 - 1, may_be_empty=True),
        Field("victories", "flag", "boolean", may_be_empty=True),
        Field("early_quit", "flag", "boolean", may_be_empty=True),
        Field("team_score_top_20_percent", "flag", "boolean", may_be_empty=True),
        Field("faction", "text", "string"),
        Field("remark", "text", "string", may_be_empty=True, checked=False),
    ),
)
LEADERBOARD_FORMAT = Format(
    "pairs",
    (
        Field("user_id", "int", "bigint", 1, 2**63 - 1),
        *(Field(n, "int", "bigint", 0, 2**32 - 1) for n in ("mmr", "battles", "victories", "early_quites", "top_20", "battle_score")),
        Field("last_session", "int", "bigint", 0, 2**63 - 1),
    ),
    sep=",",
    required=("user_id",),
)


def _number(fmt: Format, name: Column, value: Column) -> Column:
    """The typed value of an int, hex or flag column as DECIMAL(20,0); null for text and for what is empty or no number."""
    digits = F.when(F.length(F.ltrim(value, F.lit("0"))) <= 20, value).try_cast("decimal(20,0)")
    hexa = F.when(value.rlike("^[0-9a-fA-F]{1,16}\\z"), F.conv(value, 16, 10)).cast("decimal(20,0)")
    of = lambda *kinds: name.isin(*[f.name for f in fmt.fields if f.checked and f.kind in kinds])
    return F.when(of("hex"), hexa).when(of("int", "flag") & value.rlike("^[0-9]+\\z"), digits)


def _reason(fmt: Format, name: Column, value: Column, number: Column) -> Column:
    """Why a value is invalid for its column, null where it is valid; ``number`` is its typed value."""
    out = F.lit(None).cast("string")
    for f in fmt.fields:
        if not f.checked:
            continue
        if f.kind == "int":
            inside = number.between(F.lit(str(f.lo)).cast("decimal(20,0)"), F.lit(str(f.hi)).cast("decimal(20,0)"))
            rule = F.when(~value.rlike("^[0-9]+\\z"), F.lit("not a number")).when(~F.coalesce(inside, F.lit(False)), F.lit("out of range"))
        elif f.kind == "hex":
            rule = F.when(number.isNull(), F.lit("not 1 to 16 hexadecimal digits"))
        elif f.kind == "flag":
            rule = F.when(~value.isin("0", "1"), F.lit("not a flag"))
        else:
            rule = F.lit(None).cast("string")
        empty = F.lit(None).cast("string") if f.may_be_empty else F.lit("empty")
        out = F.when(name == f.name, F.when(value == "", empty).otherwise(rule)).otherwise(out)
    return out


def _typed(f: Field) -> Column:
    x = F.col(f"t.{f.name}")
    return (x == 1 if f.kind == "flag" else x.cast(f.sql_type)).alias(f.name)


def _quoted(df: DataFrame, fmt: Format) -> DataFrame:
    """Splits at double quotes: pieces at odd places lie inside quotes, so only the even ones separate."""
    line = F.regexp_replace(F.regexp_replace(F.col("_line"), "^\\uFEFF", ""), "\r\\z", "")
    line = F.regexp_replace(F.regexp_replace(line, ESC, ESC + "a"), SEP, ESC + "b")
    # Lambdas see only their element and its place: what they refer to else is computed anew for each element.
    p = F.split(line, '"', -1)
    n, sep = F.size(p), fmt.sep
    df = df.withColumn("_first", F.get(p, F.lit(0))).withColumn("_last", F.get(p, n - 1)).withColumn("_n", n)
    df = df.withColumn("_inner", F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))))
    first, last, n = F.col("_first"), F.col("_last"), F.col("_n")

    def misplaced(x: Column, j: Column) -> Column:
        return (j % 2 == 1) & (x != "") & ~(x.startswith(sep) & x.endswith(sep))

    def even(x: Column) -> Column:
        return F.regexp_replace(x, f"[{BLANKS}]*{sep}[{BLANKS}]*", SEP)

    def rebuilt(x: Column, j: Column) -> Column:
        return F.when(j % 2 == 0, x).when(x == "", F.lit('"')).otherwise(even(x))

    beside = (n > 1) & (((first != "") & ~first.endswith(sep)) | ((last != "") & ~last.startswith(sep)))
    df = df.withColumn(
        "_broken",
        F.when(F.col("_line").isNull(), F.lit("line is null"))
        .when(n % 2 == 0, F.lit("unclosed quote"))
        .when(beside | (F.size(F.filter("_inner", misplaced)) > 0), F.lit("text beside quotes")),
    )
    blank = F.lit(BLANKS)
    whole = F.when(n == 1, F.btrim(even(first), blank)).otherwise(
        F.concat(F.ltrim(even(first), blank), F.array_join(F.transform("_inner", rebuilt), ""), F.rtrim(even(last), blank)))
    back = lambda x: F.regexp_replace(F.regexp_replace(x, ESC + "b", SEP), ESC + "a", ESC)
    values = F.transform(F.split(whole, SEP, -1), back)
    df = df.withColumn("_v", F.when(F.col("_broken").isNull(), values))
    k = len(fmt.fields)
    count = F.when(F.size("_v") != k, F.concat(F.lit(f"expected {k} fields, found "), F.size("_v").cast("string")))
    df = df.withColumn("_broken", F.coalesce("_broken", count))
    names = F.array(*[F.lit(f.name) for f in fmt.fields])
    return df.withColumn("_kv", F.when(F.col("_broken").isNull(), F.map_from_arrays(names, F.col("_v"))))


def _pairs(df: DataFrame, fmt: Format) -> DataFrame:
    def bare(x: Column) -> Column:
        x = F.btrim(x, F.lit(BLANKS))
        return F.when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)

    t = F.btrim(F.col("_line"), F.lit(BLANKS + "\r"))
    df = df.withColumn("_t", t)
    t = F.col("_t")
    opened, closed = t.startswith("{"), t.endswith("}")
    both = opened & closed & (F.length(t) >= 2)
    inner = F.when(both, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)
    df = df.withColumn("_e", F.transform(F.split(inner, fmt.sep, -1), lambda e: F.split(e, ":", -1)))
    df = df.withColumn("_k", F.transform("_e", lambda e: bare(e[0])))
    known = [f.name for f in fmt.fields]
    missing = F.lit(False)
    for r in fmt.required:
        missing = missing | ~F.array_contains("_k", r)
    df = df.withColumn(
        "_broken",
        F.when(F.col("_line").isNull(), F.lit("line is null"))
        .when((opened | closed) & ~both, F.lit("unbalanced braces"))
        .when(F.exists("_e", lambda e: F.size(e) != 2), F.lit("entry without exactly one colon"))
        .when(F.exists("_k", lambda k: ~k.isin(known)), F.lit("unknown key"))
        .when(F.size(F.array_distinct("_k")) != F.size("_k"), F.lit("repeated key"))
        .when(missing, F.lit("required key missing")),
    )
    values = F.transform("_e", lambda e: bare(e[1]))
    return df.withColumn("_kv", F.when(F.col("_broken").isNull(), F.map_from_arrays(F.col("_k"), values)))


def split_records(lines: DataFrame, fmt: Format, line: str = "line", key: tuple[str, ...] = ("line_id",)) -> tuple[DataFrame, DataFrame]:
    """Returns (records, rejects) of a table of text lines.

    records: the key columns and one typed column per field of ``fmt`` (null where an optional value is
    empty or absent). rejects: the key columns, the line and ``reasons`` (sorted array, one entry per
    structural fault or per invalid column). Every input row lands in exactly one of the two.

    Null line: rejected, "line is null". Empty line: rejected by its field count or entry. Null keys and
    repeated rows are kept as they are (the join back is null-safe and uses the key and the line's hash).
    Empty table: both results empty. Other columns of ``lines`` are ignored, whatever their names.
    """
    base = lines.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], F.col(line).alias("_line"))
    base = base.withColumn("_h", F.xxhash64("_line"))
    ids = [f"_key{i}" for i in range(len(key))] + ["_h"]
    # The parsed lines feed the dictionary, the join back and the result: parsing them once is worth a checkpoint.
    parsed = cut((_quoted(base, fmt) if fmt.style == "quoted" else _pairs(base, fmt)).select(*ids, "_line", "_broken", "_kv"))
    checked = F.array(*[F.lit(f.name) for f in fmt.fields if f.checked])
    cells = parsed.where(F.col("_kv").isNotNull()).select(*ids, F.explode(F.map_filter("_kv", lambda k, _: F.array_contains(checked, k))).alias("_c", "_x"))
    c, x = F.col("_c"), F.col("_x")
    cast_once = cells.groupBy("_c", "_x").agg(F.count("*").alias("_n")).withColumn("_num", _number(fmt, c, x))
    dictionary = cut(cast_once.select("_c", "_x", "_n", _reason(fmt, c, x, F.col("_num")).alias("_why"), "_num"))
    often = F.col("_n") > parsed.count() / HOT

    def looked_up(part: DataFrame) -> DataFrame:
        """Cells with their entry of ``part`` of the dictionary; cells without one are left out."""
        entry = ["_c", "_x", "_why", "_num"]
        hot = cells.join(F.broadcast(part.where(often).select(*entry)), ["_c", "_x"])
        usual = cells.join(F.broadcast(dictionary.where(often).select("_c", "_x")), ["_c", "_x"], "left_anti")
        return hot.unionByName(usual.join(part.where(~often).select(*entry), ["_c", "_x"]))

    by_value = looked_up(dictionary.where("_why is not null")).groupBy(*ids).agg(F.array_sort(F.collect_set(F.concat_ws(": ", "_c", "_why"))).alias("_bad"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ids]
    whole = parsed.alias("l").join(by_value.alias("r"), same, "left").select(
        *[F.col(f"l.{c}") for c in ids], F.col("l._line"), F.col("l._kv"),
        F.coalesce(F.when(F.col("l._broken").isNotNull(), F.array("l._broken")), F.col("r._bad")).alias("_bad"),
    )
    keys = [F.col(f"_key{i}").alias(k) for i, k in enumerate(key)]
    rejects = whole.where(F.col("_bad").isNotNull()).select(*keys, F.col("_line").alias(line), F.col("_bad").alias("reasons"))
    # One typed row per line, repeated lines once: the largest of equal values.
    of = lambda f: F.max(F.when(F.col("_c") == f.name, F.col("_x" if f.kind == "text" else "_num"))).alias(f.name)
    typed = looked_up(dictionary.where("_why is null")).groupBy(*ids).agg(*[of(f) for f in fmt.fields if f.checked])
    good = whole.where(F.col("_bad").isNull())
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ids]
    joined = good.alias("w").join(typed.alias("t"), same, "left")
    keys = [F.col(f"w._key{i}").alias(k) for i, k in enumerate(key)]
    records = joined.select(*keys, *[_typed(f) if f.checked else F.col("w._kv").getItem(f.name).cast(f.sql_type).alias(f.name) for f in fmt.fields])
    return records, rejects
