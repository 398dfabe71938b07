"""Set-based changes as transforms of DataFrames: old rows in, new rows out.
Each change can also give the rows it touched (returning)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.sem import col


def _holds(pred: Column | None) -> Column:
    return F.lit(True) if pred is None else F.coalesce(pred, F.lit(False))


def update(df: DataFrame, setters: dict[str, Any], where: Column | None = None, returning: bool = False) -> DataFrame:
    """Columns set where the predicate holds; all setters see the old values."""
    hit = _holds(where)
    if returning:
        return df.filter(hit).select(*[col(setters[c]).cast(df.schema[c].dataType).alias(c) if c in setters else F.col(c) for c in df.columns])
    return df.select(*[F.when(hit, col(setters[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in setters else F.col(c) for c in df.columns])


def update_from(df: DataFrame, source: DataFrame, on: list[tuple[str, str]], setters: Callable[[DataFrame], dict[str, Column]], where: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """UPDATE .. FROM: setters and where see a row with its match. Of several
    matches that pass, the one with the least new values counts."""
    marked = source.withColumn("__hit", F.lit(True))
    mine = df.withColumn("__row", F.monotonically_increasing_id())
    both = mine.join(marked, reduce(and_, [mine[a] == marked[b] for a, b in on]), "left")
    hit = _holds(F.col("__hit") if where is None else F.col("__hit") & where(both))
    new = setters(both)
    cols = [F.when(hit, new[c].cast(df.schema[c].dataType)).otherwise(mine[c]).alias(c) if c in new else mine[c] for c in df.columns]
    out = both.select(*cols, mine["__row"], (~hit).alias("__miss"))
    best = F.row_number().over(Window.partitionBy("__row").orderBy("__miss", *[F.col(c) for c in new]))
    return out.withColumn("__n", best).filter("__n = 1").select(*df.columns)


def delete(df: DataFrame, where: Column | None = None, returning: bool = False) -> DataFrame:
    return df.filter(_holds(where) if returning else ~_holds(where))


def insert_from(df: DataFrame, source: DataFrame, returning: bool = False) -> DataFrame:
    """INSERT .. SELECT by column name; a name that the table lacks is an error, one that the source lacks is null."""
    extra = set(source.columns) - set(df.columns)
    if extra:
        raise ValueError(f"no columns {sorted(extra)} in the table")
    rows = source.select(*[(F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    return rows if returning else df.unionByName(rows)


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(and_, [a[k] == b[k] for k in key])


def _once(new: DataFrame, key: list[str], order: Column | None, last: bool) -> DataFrame:
    """One row of each key: the last (or first) by order, or by all its values. Null keys never conflict."""
    some = reduce(and_, [F.col(k).isNotNull() for k in key])
    by = [F.struct(*new.columns)] if order is None else [order, F.struct(*new.columns)]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*[b.desc() if last else b.asc() for b in by]))
    one = new.filter(some).withColumn("__n", best).filter("__n = 1").drop("__n")
    return one.unionByName(new.filter(~some))


def add_or_update(df: DataFrame, new: DataFrame, key: list[str], conflict: str = "replace", order: Column | None = None) -> DataFrame:
    """Keyed insert: replace takes the new row, ignore the old one, abort raises
    on any conflict. Of new rows of one key, replace takes the last by order and
    ignore the first (without one, by all values)."""
    new = new.select(*df.columns)
    if conflict in ("replace", "ignore"):
        new = _once(new, key, order, conflict == "replace")
    if conflict == "replace":
        return df.join(new, _same(df, new, key), "left_anti").unionByName(new)
    if conflict == "ignore":
        return df.unionByName(new.join(df, _same(new, df, key), "left_anti"))
    if conflict in ("abort", "fail", "rollback"):
        again = new.dropna(subset=key).groupBy(*key).count().filter("count > 1")
        if not new.join(df, _same(new, df, key), "left_semi").isEmpty() or not again.isEmpty():
            raise ValueError("a row of this key is there")
        return df.unionByName(new)
    raise ValueError(conflict)


def upsert(
    df: DataFrame, new: DataFrame, key: list[str], action: str = "update_all", columns: dict[str, Callable[[DataFrame, DataFrame], Column]] | None = None,
    where: Callable[[DataFrame, DataFrame], Column] | None = None, returning: bool = False, order: Column | None = None,
) -> DataFrame:
    """ON CONFLICT (key): nothing, update_all, or update with columns as
    functions of the old and the new row; where keeps the old row if it fails.
    Of new rows of one key the last by order counts (the first for nothing;
    without an order, by all values)."""
    new = _once(new.select(*df.columns), key, order, action != "nothing")
    old = df.withColumn("__old", F.lit(True)).alias("o")
    fresh = new.select(*df.columns).withColumn("__new", F.lit(True)).alias("n")
    both = old.join(fresh, reduce(and_, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]), "full")
    met = F.coalesce(F.col("o.__old"), F.lit(False)) & F.coalesce(F.col("n.__new"), F.lit(False))
    take = met & (_holds(where(_Side("o"), _Side("n"))) if where else F.lit(True))
    set_ = {c: F.col(f"n.{c}") for c in df.columns} if action == "update_all" else {}
    if action == "update":
        set_ = {c: fn(_Side("o"), _Side("n")) for c, fn in (columns or {}).items()}
    out = []
    for c in df.columns:
        base = F.when(F.col("o.__old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        out.append((F.when(take, set_[c]).otherwise(base) if c in set_ else base).alias(c))
    if returning:
        both = both.filter(F.col("o.__old").isNull() | (take if action != "nothing" else F.lit(False)))
    return both.select(*out)


class _Side:
    """Columns of the old or the new row by name."""

    def __init__(self, side: str):
        self._side = side

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self._side}.{name}")
