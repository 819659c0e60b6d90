"""Scalar functions with the saturating, truncating arithmetic the ratings need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX, UINT_MAX = -(2**31), 2**31 - 1, 2**32 - 1


def sat_int(x: Column, lo: int = INT_MIN, hi: int = INT_MAX) -> Column:
    """Truncation toward zero into [lo, hi]; NaN and null give 0."""
    cut = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")
    return F.when(x.isNull() | F.isnan(x), F.lit(0).cast("long")).when(x >= hi, F.lit(hi).cast("long")).when(x <= lo, F.lit(lo).cast("long")).otherwise(cut)


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division toward zero; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.try_divide(a - F.try_mod(a, b), b).cast("long")


def bucket(v: Column, width: int) -> Column:
    """(v / width) * width with integer division toward zero: the bucket 0 spans (-width, width)."""
    return v - (v % F.lit(width))


def sign_power(x: Column, p: float, a: float, b: float) -> Column:
    return F.when(x < 0, -1.0).otherwise(1.0) * a * F.pow(F.abs(x), F.lit(p)) + b


def arctan_curve(x: Column, a: float, b: float) -> Column:
    return F.atan(x) * a + b


def arcsin_curve(x: Column, a: float, b: float) -> Column:
    return F.asin(x) * a + b


def power_curve(x: Column, p: float, a: float, b: float) -> Column:
    return F.pow(x, F.lit(p)) * a + b


def ratio_or_one(top: Column, down: Column) -> Column:
    """top / down, but 1 if they are equal or down is below 1e-8 (negative included)."""
    return F.when((top == down) | (down < 1e-8), F.lit(1.0)).otherwise(F.try_divide(top.cast("double"), down.cast("double")))


def sigmoid(x: Column, steep: float, middle: float, height: float, base: float) -> Column:
    return F.lit(height) / (1.0 + F.exp(-steep * (x - middle))) + base


def low_place_weight(x: Column, top: Column) -> Column:
    """Weight of a rating x in a team whose best rating is ``top``: low ratings weigh more than 1."""
    x, top = x.cast("double"), top.cast("double")
    n = F.when(top < 1e-6, top).otherwise(F.try_divide(0.99 * top, x))
    return F.when(x < 1e-8, F.lit(1.0)).otherwise(-n / (1.0 + F.exp(-1.5 * n * (F.try_divide(x, top) - 0.5))) + n + 1.0)


def calibrated(battles: Column) -> Column:
    return F.coalesce(battles, F.lit(0)) > 5


def rating_kind(battles: Column) -> Column:
    return F.when(battles.isNull(), "None").when(battles > 5, "MMR").otherwise("NotEnough")


def closest_share(base: Column, x: Column) -> Column:
    """Of a quarter, half and all of ``base`` the one nearest to x; ties go to the smaller share."""
    options = F.array(*[F.struct(F.abs(v - x).alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate((int_div(base, 4), int_div(base, 2), base))])
    return F.array_min(options)["v"]
