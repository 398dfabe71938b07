"""The fluent query surface: each call extends a DataFrame plan for Catalyst."""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plait.functions import sem
from plait.operators.wide import wide_join

Pred = Column | Callable[[DataFrame], Column] | str
MATCHED = "__matched"


class SequenceError(LookupError):
    """No element, or more than one, where one was asked for."""


class _Second:
    """The second occurrence of a frame that is joined to itself: its columns by their first names."""

    def __init__(self, df: DataFrame, names: dict[str, str]):
        self._df, self._names = df, names

    def __getitem__(self, name: str) -> Column:
        return self._df[self._names[name]]

    @property
    def columns(self) -> list[str]:
        return list(self._names)


class Query:
    """An immutable query. Keys of order are kept as (column, descending, nulls
    first or None), so that reverse and ordered aggregates know them."""

    def __init__(self, df: DataFrame, db: Any = None, order: tuple = ()):
        self.df, self.db, self._order = df, db, order

    def _with(self, df: DataFrame, order: tuple | None = None) -> Query:
        return Query(df, self.db, self._order if order is None else order)

    def _col(self, x: Any) -> Column:
        if callable(x) and not isinstance(x, Column):
            return x(self.df)
        return F.expr(x) if isinstance(x, str) else sem.col(x)

    # projection and filter

    def where(self, *preds: Pred) -> Query:
        return self._with(reduce(lambda df, p: df.filter(p), [self._col(p) for p in preds], self.df))

    def select(self, *cols: Any, **named: Any) -> Query:
        picked = [self._col(c) for c in cols] + [self._col(c).alias(n) for n, c in named.items()]
        return self._with(self.df.select(*picked), ())

    def with_column(self, name: str, c: Any) -> Query:
        return self._with(self.df.withColumn(name, self._col(c)))

    def select_client(self, fn: Callable, schema: str) -> Query:
        """Any Python over the rows, in Arrow batches: fn maps a pandas frame."""
        return self._with(self.df.mapInPandas(lambda it: (fn(x) for x in it), schema), ())

    def distinct(self) -> Query:
        return self._with(self.df.distinct(), ())

    def cast(self, _type: Any = None) -> Query:
        return self

    # order and paging

    def order_by(self, *keys: Any, descending: bool = False, nulls: str | None = None) -> Query:
        """Replaces any earlier order. Nulls sort as the least value unless nulls is first or last."""
        return self._ordered(tuple((self._col(k), descending, nulls) for k in keys))

    def order_by_descending(self, *keys: Any, nulls: str | None = None) -> Query:
        return self.order_by(*keys, descending=True, nulls=nulls)

    def then_by(self, *keys: Any, descending: bool = False, nulls: str | None = None) -> Query:
        return self._ordered(self._order + tuple((self._col(k), descending, nulls) for k in keys))

    def then_by_descending(self, *keys: Any, nulls: str | None = None) -> Query:
        return self.then_by(*keys, descending=True, nulls=nulls)

    def _ordered(self, order: tuple) -> Query:
        cols = []
        for c, down, nulls in order:
            nulls = nulls or ("last" if down else "first")
            cols.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{nulls}")())
        return self._with(self.df.orderBy(*cols), order)

    def reverse(self) -> Query:
        """The opposite order; of an unordered query, its order is undefined either way."""
        flip = {"first": "last", "last": "first", None: None}
        return self._ordered(tuple((c, not d, flip[n]) for c, d, n in self._order)) if self._order else self

    def take(self, n: int) -> Query:
        return self._with(self.df.limit(max(0, n)))

    def skip(self, n: int) -> Query:
        return self._with(self.df.offset(max(0, n)))

    def take_range(self, start: int, stop: int) -> Query:
        return self.skip(start).take(stop - max(0, start))

    # joins

    def _pair(self, other: Query | DataFrame, on: Any, how: str, nullable: tuple[str, ...] = ()) -> Query:
        """on: a column, function of both frames, or (left, right) key names. One
        key matches by =; of several, those named in `nullable` match null with
        null. In a join of a query to itself the right one's columns get the suffix _2."""
        right = other.df if isinstance(other, Query) else other
        names = right
        if right is self.df or right.columns == self.df.columns and right.sameSemantics(self.df):
            second = {c: f"{c}_2" for c in right.columns}
            right = right.toDF(*second.values())
            names = _Second(right, second)
        if callable(on) and not isinstance(on, Column):
            cond = on(self.df, names)
        elif isinstance(on, Column):
            cond = on
        else:
            keys = [(on, on)] if isinstance(on, str) else list(on)
            keys = [(k, k) if isinstance(k, str) else k for k in keys]
            safe = len(keys) > 1
            cond = reduce(and_, [self.df[a].eqNullSafe(names[b]) if safe and a in nullable else self.df[a] == names[b] for a, b in keys])
        return self._with(self.df.join(right, cond, how), ())

    def join(self, other, on, nullable=(), many: bool = False) -> Query:
        """many: few keys, many rows of each on both sides. Then the pairs are
        counted first and dealt out by that; on is key names, and no column name
        is in both."""
        if many:
            keys = [(k, k) if isinstance(k, str) else k for k in on]
            # structs are equal where their nulls are
            cols = [tuple(F.struct(F.col(c).alias("k")) if len(keys) > 1 and a in nullable else F.col(c) for c in (a, b)) for a, b in keys]
            return self._with(wide_join(self.df, other.df if isinstance(other, Query) else other, cols), ())
        return self._pair(other, on, "inner", nullable)

    def left_join(self, other, on, nullable=(), marker: str | None = None) -> Query:
        """marker: a column that is true where a row matched, so a missing row is told from a row of nulls."""
        right = other.df if isinstance(other, Query) else other
        if marker:
            right = right.withColumn(marker, F.lit(True))
        got = self._pair(right, on, "left", nullable)
        return got.with_column(marker, F.coalesce(F.col(marker), F.lit(False))) if marker else got

    def right_join(self, other, on, nullable=()) -> Query:
        return self._pair(other, on, "right", nullable)

    def full_join(self, other, on, nullable=()) -> Query:
        return self._pair(other, on, "full", nullable)

    def cross_join(self, other: Query, on: Callable[[DataFrame, DataFrame], Column] | None = None) -> Query:
        """All pairs, or with `on` those that meet any condition."""
        if on is None:
            return self._with(self.df.crossJoin(other.df), ())
        return self._with(self.df.join(other.df, on(self.df, other.df), "inner"), ())

    def group_join(self, other: Query, on, where: Pred | None = None, keep_empty: bool = True) -> Query:
        """Each row with each of its group; keep_empty also keeps rows without
        one. A filter of the group belongs to the match, not to the result."""
        if where is not None:
            other = other.where(where)
        return self._pair(other, on, "left" if keep_empty else "inner")

    def exists(self, other: Query, on) -> Query:
        return self._pair(other, on, "left_semi")

    def not_exists(self, other: Query, on) -> Query:
        return self._pair(other, on, "left_anti")

    def where_all(self, other: Query, on: Callable, pred: Callable) -> Query:
        """Rows for which every matching row of other meets pred; a null fails."""
        fails = lambda a, b: on(a, b) & ~F.coalesce(pred(a, b), F.lit(False))
        return self._pair(other, fails, "left_anti")

    def where_in(self, key: str, other: Query, other_key: str) -> Query:
        """Null-safe IN of a subquery."""
        return self._pair(other, lambda a, b: a[key].eqNullSafe(b[other_key]), "left_semi")

    def where_in_rows(self, keys: list[str], rows: list[tuple], ddl: str) -> Query:
        """Row-value IN of a list."""
        if not rows:
            return self.where(F.lit(False))
        some = self.df.sparkSession.createDataFrame(rows, ddl)
        return self._pair(some, lambda a, b: reduce(and_, [a[k].eqNullSafe(b[c]) for k, c in zip(keys, b.columns, strict=True)]), "left_semi")

    def scalar(self, other: Query, on: list[str] | list[tuple[str, str]], default: Any = None, **aggs: Column) -> Query:
        """A correlated scalar subquery for each row: aggregates of other by its
        keys, joined back; without a row, the default."""
        keys = [(k, k) if isinstance(k, str) else k for k in on]
        got = other.df.groupBy(*[F.col(b).alias(f"__{b}") for _, b in keys]).agg(*[c.alias(n) for n, c in aggs.items()])
        cond = reduce(and_, [self.df[a] == got[f"__{b}"] for a, b in keys])
        out = self.df.join(got, cond, "left").drop(*[f"__{b}" for _, b in keys])
        if default is not None:
            out = out.withColumns({n: F.coalesce(n, F.lit(default)) for n in aggs})
        return self._with(out)

    def scalar_first(self, other: Query, on: list, value: str, order: Column, name: str, default: Any = None) -> Query:
        """A correlated First: value of the least row by order (a struct compares its fields in turn)."""
        return self.scalar(other, on, default, **{name: F.min(F.struct(order.alias("o"), F.col(value).alias("v")))["v"]})

    # groups and sets

    def group_by(self, *keys: Any, **named: Any) -> Grouped:
        cols = [self._col(k) for k in keys] + [self._col(k).alias(n) for n, k in named.items()]
        return Grouped(self, cols)

    def _aligned(self, other: Query) -> DataFrame:
        if self.df.columns != other.df.columns:
            raise ValueError(f"set operation over {self.df.columns} and {other.df.columns}")
        return other.df

    def concat(self, other: Query) -> Query:
        return self._with(self.df.union(self._aligned(other)), ())

    def union(self, other: Query) -> Query:
        return self._with(self.df.union(self._aligned(other)).distinct(), ())

    def intersect(self, other: Query) -> Query:
        return self._with(self.df.intersect(self._aligned(other)), ())

    def except_(self, other: Query) -> Query:
        return self._with(self.df.subtract(self._aligned(other)), ())

    # scalars, as relations of one row

    def agg(self, **aggs: Column) -> Query:
        return self._with(self.df.agg(*[c.alias(n) for n, c in aggs.items()]), ())

    def any_(self, pred: Pred | None = None) -> Query:
        q = self.where(pred) if pred is not None else self
        return q._with(q.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result")), ())

    def all_(self, pred: Pred) -> Query:
        fails = self.df.filter(~F.coalesce(self._col(pred), F.lit(False)))
        return self._with(fails.limit(1).agg((F.count(F.lit(1)) == 0).alias("result")), ())

    def contains(self, column: str, value: Any) -> Query:
        return self.any_(sem.eq(F.col(column), value))

    def count_distinct_rows(self) -> Query:
        return self._with(self.df.distinct().agg(F.count(F.lit(1)).alias("result")), ())

    def string_join(self, c: Any, sep: str) -> Query:
        return self.agg(result=sem.string_join(self._col(c), sep, self._order))

    # terminals

    def to_list(self) -> list[Row]:
        return self.df.collect()

    def rows(self):
        """Rows one by one, a partition at a time on the driver."""
        return self.df.toLocalIterator()

    def to_hash_set(self) -> set[Row]:
        return set(self.df.distinct().collect())

    def to_dictionary(self, key: str) -> dict:
        """Rows by key; a key that comes twice is an error."""
        out: dict = {}
        for r in self.to_list():
            if r[key] in out:
                raise ValueError(f"key {r[key]!r} comes twice")
            out[r[key]] = r
        return out

    async def run_async(self, terminal: str, *args: Any, **named: Any) -> Any:
        """A terminal by name, off the event loop: await q.run_async("to_list")."""
        return await asyncio.to_thread(getattr(self, terminal), *args, **named)

    def to_lookup(self, key: str) -> dict:
        out: dict = {}
        for r in self.to_list():
            out.setdefault(r[key], []).append(r)
        return out

    def count(self, pred: Pred | None = None) -> int:
        return (self.where(pred) if pred is not None else self).df.count()

    def _value(self, c: Column) -> Any:
        return self.df.agg(c).first()[0]

    def sum(self, c: Any) -> Any:
        return self._value(sem.sum0(self._col(c)))

    def total(self, c: Any) -> float:
        return self._value(sem.total(self._col(c)))

    def _needed(self, fn, c: Any, nullable: bool) -> Any:
        got = self._value(fn(self._col(c)))
        if got is None and not nullable:
            raise SequenceError("no elements")
        return got

    def min(self, c: Any, nullable: bool = False) -> Any:
        return self._needed(F.min, c, nullable)

    def max(self, c: Any, nullable: bool = False) -> Any:
        return self._needed(F.max, c, nullable)

    def average(self, c: Any, nullable: bool = False) -> Any:
        return self._needed(F.avg, c, nullable)

    def first_or_default(self, pred: Pred | None = None, default: Any = None) -> Any:
        got = (self.where(pred) if pred is not None else self).df.take(1)
        return got[0] if got else default

    def first(self, pred: Pred | None = None) -> Row:
        got = (self.where(pred) if pred is not None else self).df.take(1)
        if not got:
            raise SequenceError("no elements")
        return got[0]

    def single_or_default(self, pred: Pred | None = None, default: Any = None) -> Any:
        got = (self.where(pred) if pred is not None else self).df.take(2)
        if len(got) > 1:
            raise SequenceError("more than one element")
        return got[0] if got else default

    def single(self, pred: Pred | None = None) -> Row:
        got = self.single_or_default(pred)
        if got is None:
            raise SequenceError("no elements")
        return got

    def element_at_or_default(self, i: int, default: Any = None) -> Any:
        got = self.df.offset(i).take(1) if i >= 0 else []
        return got[0] if got else default

    def element_at(self, i: int) -> Row:
        got = self.element_at_or_default(i)
        if got is None:
            raise SequenceError(f"no element {i}")
        return got

    def explain(self, mode: str = "formatted") -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


class Grouped:
    """Groups of a query. having() is a filter on aggregates, given by name."""

    def __init__(self, query: Query, keys: list[Column]):
        self.query, self.keys = query, keys

    def select(self, **aggs: Column) -> Query:
        got = self.query.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        return self.query._with(got, ())

    def having(self, pred: Callable[[DataFrame], Column], **aggs: Column) -> Query:
        return self.select(**aggs).where(pred)

    def count(self) -> int:
        return self.query.df.select(*self.keys).distinct().count()

    def count_groups(self) -> Query:
        return self.query._with(self.query.df.select(*self.keys).distinct().agg(F.count(F.lit(1)).alias("result")), ())

    def element_at(self, i: int, *order: Column) -> Query:
        """The i-th row of each group by an order (columns, asc() or desc()); groups without one have no row."""
        df, keys = self.query.df, [f"__k{j}" for j in range(len(self.keys))]
        df = df.withColumns(dict(zip(keys, self.keys, strict=True)))
        spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return self.query._with(df.withColumn("__n", spot).filter(F.col("__n") == i + 1).drop("__n", *keys), ())

    def first(self, *order: Column) -> Query:
        return self.element_at(0, *order)

    def rows(self, name: str = "rows") -> Query:
        """Each group with its rows: an array, so for groups that fit a row."""
        return self.select(**{name: F.collect_list(F.struct("*"))})
