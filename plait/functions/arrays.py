"""Collection columns: arrays and maps, positions from 0."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.sem import col

Fn = Callable[[Column], Column]
where, select, exists = F.filter, F.transform, F.exists
true_for_all = F.forall
distinct, union, intersect, except_ = F.array_distinct, F.array_union, F.array_intersect, F.array_except
append, prepend, concat, reverse = F.array_append, F.array_prepend, F.concat, F.reverse
min_, max_ = F.array_min, F.array_max
contains_key, keys, values, entries = F.map_contains_key, F.map_keys, F.map_values, F.map_entries


def count(a: Any, pred: Fn | None = None) -> Column:
    return F.size(a if pred is None else F.filter(a, pred))


def any_(a: Any, pred: Fn | None = None) -> Column:
    return F.size(a) > 0 if pred is None else F.exists(a, lambda x: F.coalesce(pred(x), F.lit(False)))


def all_(a: Any, pred: Fn) -> Column:
    return F.forall(a, lambda x: F.coalesce(pred(x), F.lit(False)))


def element_at(a: Any, i: int) -> Column:
    return F.get(a, F.lit(i))


def first(a: Any, pred: Fn | None = None) -> Column:
    return F.get(a if pred is None else F.filter(a, pred), F.lit(0))


def last(a: Any, pred: Fn | None = None) -> Column:
    return F.try_element_at(a if pred is None else F.filter(a, pred), F.lit(-1))


def single(a: Any, pred: Fn | None = None) -> Column:
    """The one element; null if there is none or more than one."""
    some = a if pred is None else F.filter(a, pred)
    return F.when(F.size(some) == 1, F.get(some, F.lit(0)))


def sum_(a: Any, kind: str = "bigint") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x.cast(kind), F.lit(0).cast(kind)))


def average(a: Any) -> Column:
    """Null for no elements; null elements don't count."""
    some = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(sum_(some, "double"), F.size(some).cast("double"))


def contains(a: Any, v: Any) -> Column:
    return F.exists(a, lambda x: x.eqNullSafe(col(v)))


def find_index(a: Any, pred: Fn) -> Column:
    at = F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(pred(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def find_last_index(a: Any, pred: Fn) -> Column:
    at = F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(pred(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1))


def index_of(a: Any, v: Any) -> Column:
    return find_index(a, lambda x: x.eqNullSafe(col(v)))


def last_index_of(a: Any, v: Any) -> Column:
    return find_last_index(a, lambda x: x.eqNullSafe(col(v)))


def skip(a: Any, n: int) -> Column:
    return F.slice(a, n + 1, 2**31 - 1)


def take(a: Any, n: int) -> Column:
    return F.slice(a, 1, n)


def get_range(a: Any, i: int, n: int) -> Column:
    return F.slice(a, i + 1, n)


def order_by(a: Any, *keys: Fn | tuple[Fn, bool]) -> Column:
    """Sorted by keys in turn, ties in place; (key, True) descends. Nulls come first, last when descending."""

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for k in reversed(keys):
            fn, down = k if isinstance(k, tuple) else (k, False)
            p, q = fn(x["v"]), fn(y["v"])
            less = F.coalesce(p < q, p.isNull() & q.isNotNull())
            out = F.when(p.eqNullSafe(q), out).when(less, 1 if down else -1).otherwise(-1 if down else 1)
        return F.when(out == 0, F.when(x["i"] < y["i"], -1).otherwise(1)).otherwise(out)

    tagged = F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(tagged, compare), lambda x: x["v"])


def select_many(a: Any, fn: Fn) -> Column:
    return F.flatten(F.transform(a, fn))


def group_by(a: Any, key: Fn) -> Column:
    """Array of (key, values), keys in order of their first element."""
    keys = F.array_distinct(F.transform(a, key))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(a, lambda x: key(x).eqNullSafe(k)).alias("values")))
