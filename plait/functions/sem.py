"""Null, number and text rules of the query surface where Spark's defaults differ."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def col(x: Any) -> Column:
    """x as a column; a str is a literal here (name columns with F.col)."""
    return x if isinstance(x, Column) else F.lit(x)


def ascii_lower(x: Any) -> Column:
    return F.translate(col(x), ASCII_UPPER, ASCII_LOWER)


def ascii_upper(x: Any) -> Column:
    return F.translate(col(x), ASCII_LOWER, ASCII_UPPER)


def eq(a: Any, b: Any, nullable: bool = True) -> Column:
    """Null-safe between nullable columns; = against a constant; IS NULL against None."""
    if a is None or b is None:
        return F.lit(True) if a is b else col(b if a is None else a).isNull()
    if isinstance(a, Column) and isinstance(b, Column) and nullable:
        return a.eqNullSafe(b)
    return col(a) == col(b)


def ne(a: Any, b: Any, nullable: bool = True) -> Column:
    """IS NOT when either side may be null, so a null differs from a constant."""
    if a is None or b is None:
        return ~eq(a, b)
    return ~col(a).eqNullSafe(col(b)) if nullable else col(a) != col(b)


def negate(pred: Column) -> Column:
    """NOT of a comparison that may be null: null counts as false, so this is true."""
    return ~F.coalesce(pred, F.lit(False))


def xor(a: Column, b: Column) -> Column:
    return a != b


def all_of(preds: list[Column]) -> Column:
    return reduce(and_, preds, F.lit(True))


def any_of(preds: list[Column]) -> Column:
    return reduce(or_, preds) if preds else F.lit(False)


class WhereBuilder:
    """Collects predicates; nested builders make groups."""

    def __init__(self) -> None:
        self._pred: Column | None = None

    def _add(self, pred: Column | WhereBuilder, op) -> WhereBuilder:
        p = pred.build() if isinstance(pred, WhereBuilder) else pred
        self._pred = p if self._pred is None else op(self._pred, p)
        return self

    def And(self, pred: Column | WhereBuilder) -> WhereBuilder:  # noqa: N802
        return self._add(pred, and_)

    def Or(self, pred: Column | WhereBuilder) -> WhereBuilder:  # noqa: N802
        return self._add(pred, or_)

    def build(self) -> Column:
        return F.lit(True) if self._pred is None else self._pred


def int_div(a: Any, b: Any) -> Column:
    """Truncating division; null by zero."""
    a, b = col(a), col(b)
    return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("bigint"))


def div(a: Any, b: Any) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def mod(a: Any, b: Any) -> Column:
    """Sign of the dividend; null by zero."""
    return F.try_mod(col(a), col(b))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def wrap_int(x: Any, bits: int, signed: bool = True) -> Column:
    """Keep the low bits of an integer, as an unchecked narrowing does."""
    size = 1 << bits
    y = F.pmod(col(x).cast("decimal(38,0)"), F.lit(size).cast("decimal(38,0)"))
    if signed:
        y = F.when(y >= size // 2, y - size).otherwise(y)
    return y.cast({8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits] if signed else "decimal(20,0)")


def parse_int(x: Any) -> Column:
    """The number that a text begins with; 0 if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(col(x), r"^\s*([+-]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def parse_real(x: Any) -> Column:
    got = F.regexp_extract(col(x), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(got, F.lit("")).try_cast("double"), F.lit(0.0))


def in_list(x: Column, values: list) -> Column:
    """IN with null as a value of the list; an empty list holds nothing."""
    some = [v for v in values if v is not None]
    p = x.isin(some) if some else F.lit(False)
    return p | x.isNull() if len(some) < len(values) else p


def between(x: Any, lo: Any, hi: Any) -> Column:
    return F.coalesce(col(x).between(col(lo), col(hi)), F.lit(False))


def distinct_from(a: Any, b: Any) -> Column:
    return ~col(a).eqNullSafe(col(b))


def scalar_min(*xs: Any) -> Column:
    cs = [col(x) for x in xs]
    return F.when(all_of([c.isNotNull() for c in cs]), F.least(*cs))


def scalar_max(*xs: Any) -> Column:
    cs = [col(x) for x in xs]
    return F.when(all_of([c.isNotNull() for c in cs]), F.greatest(*cs))


def collate_key(x: Any, collation: str) -> Column:
    """The key that compares x under Binary, NoCase (ASCII) or Rtrim."""
    return {"binary": col, "nocase": ascii_lower, "rtrim": lambda c: F.rtrim(col(c))}[collation.lower()](x)


# aggregates


def sum0(x: Any, where: Column | None = None) -> Column:
    x = col(x)
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0))


def total(x: Any, where: Column | None = None) -> Column:
    x = col(x).cast("double")
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0.0))


def count(where: Column | None = None) -> Column:
    return F.count(F.lit(1) if where is None else F.when(where, 1))


def filtered(agg, x: Any, where: Column) -> Column:
    """agg over the rows where the predicate holds."""
    return agg(F.when(where, col(x)))


def any_(pred: Column) -> Column:
    return F.coalesce(F.max(F.when(F.coalesce(pred, F.lit(False)), 1).otherwise(0)) == 1, F.lit(False))


def all_(pred: Column) -> Column:
    """A null predicate fails; no rows pass."""
    return F.coalesce(F.min(F.when(F.coalesce(pred, F.lit(False)), 1).otherwise(0)) == 1, F.lit(True))


def contains_value(x: Column, value: Any) -> Column:
    return any_(x.isNull() if value is None else x.eqNullSafe(col(value)))


def count_distinct(x: Column) -> Column:
    """NULL is one value."""
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def string_join(x: Column, sep: str, order: Column | tuple | None = None) -> Column:
    """Values joined in an order (given, or by value); a null is ''; no rows give ''.
    order: a column, or keys as (column, descending, nulls first or None) in turn."""
    value = F.coalesce(x.cast("string"), F.lit(""))
    if order is None or isinstance(order, tuple) and not order:
        return F.coalesce(F.array_join(F.sort_array(F.collect_list(value)), sep), F.lit(""))
    keys = [(order, False, None)] if isinstance(order, Column) else list(order)

    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)
        for i, (_, down, nulls) in reversed(list(enumerate(keys))):
            p, q, null = a[f"k{i}"], b[f"k{i}"], -1 if (nulls or ("last" if down else "first")) == "first" else 1
            less = 1 if down else -1
            out = F.when(p.eqNullSafe(q), out).when(p.isNull(), null).when(q.isNull(), -null).when(p < q, less).otherwise(-less)
        return out

    rows = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, (k, _, _) in enumerate(keys)], value.alias("v"))), compare)
    return F.coalesce(F.array_join(F.transform(rows, lambda r: r["v"]), sep), F.lit(""))
