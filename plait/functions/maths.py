"""Math functions: null for what has no real value, rounding to even by default."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.sem import col, no_nan, scalar_max, scalar_min


def round_(x: Any, digits: int = 0, mode: str = "to_even") -> Column:
    if mode not in ("to_even", "away_from_zero"):
        raise ValueError(f"rounding mode {mode} is not supported")
    return (F.bround if mode == "to_even" else F.round)(col(x), digits)


def clamp(x: Any, lo: Any, hi: Any) -> Column:
    if not isinstance(lo, Column) and not isinstance(hi, Column) and lo > hi:
        raise ValueError("clamp: the least is above the most")
    return scalar_min(scalar_max(x, lo), hi)


def sign(x: Any) -> Column:
    x = col(x)
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def ceiling(x: Any) -> Column:
    return F.ceil(col(x)).cast("double")


def floor(x: Any) -> Column:
    return F.floor(col(x)).cast("double")


def truncate(x: Any) -> Column:
    x = col(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _real(fn):
    return lambda x: no_nan(fn(col(x).cast("double")))


abs_ = lambda x: F.abs(col(x))
sqrt, cbrt, exp = _real(F.sqrt), _real(F.cbrt), _real(F.exp)
ln, log10, log2 = _real(F.ln), _real(F.log10), _real(F.log2)
sin, cos, tan, asin, acos, atan = (_real(f) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))
sinh, cosh, tanh, asinh, acosh, atanh = (_real(f) for f in (F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh))
radians, degrees = _real(F.radians), _real(F.degrees)


def atan2(y: Any, x: Any) -> Column:
    return no_nan(F.atan2(col(y).cast("double"), col(x).cast("double")))


def pow_(x: Any, y: Any) -> Column:
    return no_nan(F.pow(col(x).cast("double"), col(y).cast("double")))


def log(x: Any, base: Any) -> Column:
    return F.try_divide(ln(x), ln(base))


def to_int(x: Any) -> Column:
    """A real as integer, half away from zero."""
    return F.round(col(x)).cast("int")


def to_long(x: Any) -> Column:
    return F.round(col(x)).cast("bigint")


def has_flag(x: Any, flag: Any) -> Column:
    return col(x).bitwiseAND(col(flag)) == col(flag)


def shift_left(x: Any, n: int) -> Column:
    return F.shiftleft(col(x).cast("bigint"), n & 63)


def shift_right(x: Any, n: int) -> Column:
    return F.shiftright(col(x).cast("bigint"), n & 63)


def enum_name(x: Any, names: dict[int, str]) -> Column:
    """The member's name, or its number as text."""
    out = col(x).cast("string")
    for value, name in names.items():
        out = F.when(col(x) == value, name).otherwise(out)
    return out


def enum_value(x: Any, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("int")
    for value, name in names.items():
        out = F.when(col(x) == name, value).otherwise(out)
    return out
