"""Bounding boxes as plain columns: min and max of each dimension (1 to 5)."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.functions.sem import col
from plait.operators.wide import row_hash, wide_join

Dims = list[tuple[str, str]]

#: Rows of one box in a list at most, on average.
LIST = 256


def as_boxes(df: DataFrame, dims: Dims, kind: str = "float") -> DataFrame:
    """Coordinates stored as 32-bit floats (or ints), least not above most."""
    if not 1 <= len(dims) <= 5:
        raise ValueError("1 to 5 dimensions")
    out = df.withColumns({c: F.col(c).cast({"float": "float", "int": "int"}[kind]) for d in dims for c in d})
    return out.filter(reduce(and_, [F.col(a) <= F.col(b) for a, b in dims]))


def holds_point(dims: Dims, *point: Any) -> Column:
    """Simple comparisons, so they reach the files' statistics."""
    return reduce(and_, [(F.col(a) <= col(p)) & (F.col(b) >= col(p)) for (a, b), p in zip(dims, point, strict=True)])


def overlaps(dims: Dims, *box: tuple[Any, Any]) -> Column:
    return reduce(and_, [(F.col(a) <= col(hi)) & (F.col(b) >= col(lo)) for (a, b), (lo, hi) in zip(dims, box, strict=True)])


def within(dims: Dims, *box: tuple[Any, Any]) -> Column:
    return reduce(and_, [(F.col(a) >= col(lo)) & (F.col(b) <= col(hi)) for (a, b), (lo, hi) in zip(dims, box, strict=True)])


def overlap_join(a: DataFrame, b: DataFrame, a_dims: Dims, b_dims: Dims, cell: list[float]) -> DataFrame:
    """Pairs of boxes that overlap. Rows of the same box are listed, so a box is
    compared once for all of a list. Both sides are dealt to the grid cells that
    they touch in the first dimensions of `cell`; a pair is kept in the cell of
    its intersection's least corner alone, so it comes once."""

    def dealt(df: DataFrame, dims: Dims, mark: str) -> DataFrame:
        box = [f"__{mark}{i}{e}" for i in range(len(dims)) for e in "lh"]
        rows = df.select(F.struct(*df.columns).alias(f"__{mark}r"), row_hash(df).alias("__h"), *[F.col(c).alias(n) for n, c in zip(box, [c for d in dims for c in d], strict=True)])
        lists = rows.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("__n"))
        got = rows.join(lists, box).groupBy(*box, F.pmod("__h", "__n").alias("__part")).agg(F.collect_list(f"__{mark}r").alias(f"__{mark}r")).drop("__part")
        for i, size in enumerate(cell):
            lo, hi = (F.floor(F.col(f"__{mark}{i}{e}") / F.lit(size)) for e in "lh")
            got = got.withColumn(f"__{mark}{i}", F.explode(F.sequence(lo, hi)))
        return got

    same = [(F.col(f"__a{i}"), F.col(f"__b{i}")) for i in range(len(cell))]
    meet = reduce(and_, [(F.col(f"__a{i}l") <= F.col(f"__b{i}h")) & (F.col(f"__a{i}h") >= F.col(f"__b{i}l")) for i in range(len(a_dims))])
    home = reduce(and_, [F.col(f"__a{i}") == F.floor(F.greatest(f"__a{i}l", f"__b{i}l") / F.lit(size)) for i, size in enumerate(cell)])
    got = wide_join(dealt(a, a_dims, "a"), dealt(b, b_dims, "b"), same, meet & home, (F.size("__ar"), F.size("__br")))
    got = got.select(F.explode("__ar").alias("__ar"), "__br").select("__ar", F.explode("__br").alias("__br"))
    return got.select("__ar.*", "__br.*")
