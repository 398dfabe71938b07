"""Window functions with filters, GROUPS frames and EXCLUDE.

w = over("o_custkey", order=["o_orderdate", ("o_orderkey", True)], frame=rows(-2, 0))
df = apply(df, {"s": (sum_("o_totalprice"), w)})
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

START, END, CURRENT = Window.unboundedPreceding, Window.unboundedFollowing, 0


@dataclass(frozen=True)
class Frame:
    kind: str
    start: int
    end: int
    exclude: str | None = None  # current_row, group or ties


def rows(start: int, end: int, exclude: str | None = None) -> Frame:
    return Frame("rows", start, end, exclude)


def range_(start: int, end: int, exclude: str | None = None) -> Frame:
    return Frame("range", start, end, exclude)


def groups(start: int, end: int, exclude: str | None = None) -> Frame:
    return Frame("groups", start, end, exclude)


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


def over(*partition: Any, order: list | tuple = (), frame: Frame | None = None) -> Over:
    return Over(tuple(partition), tuple(order), frame)


@dataclass(frozen=True)
class Fn:
    """make: the function over its value column; fold: the same over an array of
    values in frame order and the type of their sum, for frames with exclusions; value None for *.
    sums: sum or count or avg, which over a whole partition need no arrays."""

    make: Callable[[Column], Column]
    value: Any = None
    fold: Callable[[Column, str], Column] | None = None
    sums: str | None = None
    pred: Column | None = None

    def filter(self, pred: Column) -> Fn:
        if self.fold is None:
            raise ValueError("only aggregates take a filter")
        return Fn(self.make, self.value, self.fold, self.sums, pred)

    def column(self) -> Column:
        v = F.lit(1) if self.value is None else _col(self.value)
        return v if self.pred is None else F.when(self.pred, v)


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _some(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _fold_sum(a: Column, kind: str) -> Column:
    """In the type that a sum of the values has."""
    return F.when(F.size(_some(a)) > 0, F.aggregate(_some(a), F.lit(0).cast(kind), lambda s, x: (s + x.cast(kind)).cast(kind)))


def sum_(v: Any) -> Fn:
    """A null counts 0; an empty frame is null."""
    x = F.coalesce(_col(v), F.lit(0))
    return Fn(F.sum, x, _fold_sum, "sum")


def avg(v: Any) -> Fn:
    return Fn(F.avg, v, lambda a, kind: _fold_sum(a, kind) / F.size(_some(a)), "avg")


def min_(v: Any) -> Fn:
    return Fn(F.min, v, lambda a, _: F.array_min(a))


def max_(v: Any) -> Fn:
    return Fn(F.max, v, lambda a, _: F.array_max(a))


def count(v: Any = None) -> Fn:
    return Fn(F.count, v, lambda a, _: F.size(_some(a)).cast("bigint"), "count")


def row_number() -> Fn:
    return Fn(lambda _: F.row_number())


def rank() -> Fn:
    return Fn(lambda _: F.rank())


def dense_rank() -> Fn:
    return Fn(lambda _: F.dense_rank())


def percent_rank() -> Fn:
    return Fn(lambda _: F.percent_rank())


def cume_dist() -> Fn:
    return Fn(lambda _: F.cume_dist())


def ntile(n: int) -> Fn:
    return Fn(lambda _: F.ntile(n))


def first_value(v: Any) -> Fn:
    return Fn(F.first_value, v, lambda a, _: F.get(a, F.lit(0)))


def last_value(v: Any) -> Fn:
    return Fn(F.last_value, v, lambda a, _: F.try_element_at(a, F.lit(-1)))


def nth_value(v: Any, n: int) -> Fn:
    return Fn(lambda c: F.nth_value(c, n), v, lambda a, _: F.get(a, F.lit(n - 1)))


def lag(v: Any, offset: int | Column = 1, default: Any = None) -> Fn:
    if isinstance(offset, Column):
        return _Shift(v, offset, default, -1)
    return Fn(lambda c: F.lag(c, offset, default), v)


def lead(v: Any, offset: int | Column = 1, default: Any = None) -> Fn:
    if isinstance(offset, Column):
        return _Shift(v, offset, default, 1)
    return Fn(lambda c: F.lead(c, offset, default), v)


class _Shift(Fn):
    """lag or lead by a column."""

    def __init__(self, v: Any, offset: Column, default: Any, sign: int):
        super().__init__(lambda c: c, v)
        object.__setattr__(self, "offset", offset)
        object.__setattr__(self, "default", default)
        object.__setattr__(self, "sign", sign)


def _spec(w: Over, order: list[Column] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*[_col(p) for p in w.partition])
    keys = _keys(w) if order is None else order
    return spec.orderBy(*keys) if keys else spec


def _keys(w: Over) -> list[Column]:
    return [_col(k[0]).desc() if isinstance(k, tuple) and k[1] else _col(k[0] if isinstance(k, tuple) else k).asc() for k in w.order]




def apply(df: DataFrame, columns: dict[str, tuple[Fn, Over]]) -> DataFrame:
    """df with a column for each function over its window."""
    names = df.columns
    for name, (fn, w) in columns.items():
        df = _one(df, name, fn, w).select(*names, name)
        names = [*names, name]
    return df


def _one(df: DataFrame, name: str, fn: Fn, w: Over) -> DataFrame:
    frame, spec = w.frame, _spec(w)
    if isinstance(fn, _Shift):
        before = spec.rowsBetween(START, CURRENT) if fn.sign < 0 else spec.rowsBetween(CURRENT, END)
        seen = F.collect_list(F.struct(fn.column().alias("v"))).over(before)
        at = F.size(seen) - fn.offset - 1 if fn.sign < 0 else fn.offset
        there = (at >= 0) & (at < F.size(seen))
        return df.withColumn(name, F.when(there, F.get(seen, at)["v"]).otherwise(F.lit(fn.default)))
    v = fn.column()
    if frame is None:
        rank_like = fn.value is None and fn.fold is None
        ordered = spec if w.order or not rank_like else _spec(w, [F.lit(1)])
        return df.withColumn(name, fn.make(v).over(ordered))
    if frame.kind == "groups":
        df = df.withColumn("__g", F.dense_rank().over(spec))
        ranged = _spec(w, [F.col("__g")]).rangeBetween(frame.start, frame.end)
    elif frame.kind == "rows":
        ranged = spec.rowsBetween(frame.start, frame.end)
    else:
        ranged = spec.rangeBetween(frame.start, frame.end)
    if frame.exclude is None:
        return df.withColumn(name, fn.make(v).over(ranged))
    if fn.fold is None:
        raise ValueError("this function takes no exclusion")
    if "__g" not in df.columns:
        df = df.withColumn("__g", F.dense_rank().over(spec))
    if fn.sums and (frame.start, frame.end) == (START, END):
        # every row's excluded rows lie within its frame: the whole less them
        whole, same = Window.partitionBy(*[_col(p) for p in w.partition]), Window.partitionBy(*[_col(p) for p in w.partition], "__g")

        def left(agg: Callable[[Column], Column], mine: Column) -> Column:
            group = F.coalesce(agg(v).over(same), F.lit(0))
            out = {"current_row": mine, "group": group, "ties": group - mine}[frame.exclude]
            return F.coalesce(agg(v).over(whole), F.lit(0)) - out

        n = left(F.count, F.when(v.isNotNull(), 1).otherwise(0))
        s = F.when(n > 0, left(F.sum, F.coalesce(v, F.lit(0))))
        return df.withColumn(name, {"count": n, "sum": s, "avg": s / n}[fn.sums])
    df = df.withColumn("__n", F.row_number().over(spec))
    if frame.kind != "rows":  # rows of a group in the order of their numbers
        ranged_list = F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__g").alias("g"), v.alias("v"))).over(ranged))
    else:
        ranged_list = F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__g").alias("g"), v.alias("v"))).over(ranged)
    df = df.withColumn("__l", ranged_list)
    n, g = F.col("__n"), F.col("__g")
    keep = {
        "current_row": lambda x: x["n"] != n,
        "group": lambda x: x["g"] != g,
        "ties": lambda x: (x["g"] != g) | (x["n"] == n),
    }[frame.exclude]
    kind = df.select(v.alias("v")).limit(0).groupBy().agg(F.sum("v")).schema[0].dataType.simpleString() if fn.sums else "double"
    return df.withColumn(name, fn.fold(F.transform(F.filter("__l", keep), lambda x: x["v"]), kind))
