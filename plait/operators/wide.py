"""Joins that give far more rows than they read: few keys, many rows of each on both sides.

The size of such a join's inputs doesn't tell its work: adaptive execution would
merge them into a few tasks. So its work is counted first, and dealt by that.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, isqrt
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs up to which a plain join does; pairs of a task; tasks at most; rows of a block at least.
PLAIN, TASK, TASKS, BLOCK = 20_000_000, 4_000_000, 1_000, 2_048


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, of those that have one."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def wide_join(a: DataFrame, b: DataFrame, keys: list[tuple[Column, Column]], more: Column | None = None, weights: tuple[Column, Column] | None = None) -> DataFrame:
    """Inner join of frames without a common column name, by keys (of a, of b)
    and one more condition. weights: of a row of either side, 1 if left out;
    a pair costs their product. The rows of a key are cut into blocks by hash, on
    either side; each pair of blocks is joined for itself, so a task holds one
    block, and the tasks' number follows from the pairs to be tried. A row is
    copied once for each block that it meets: rows moved are pairs / block."""
    ids = [f"__k{i}" for i in range(len(keys))]
    x = a.withColumns({k: c for k, (c, _) in zip(ids, keys, strict=True)}).dropna(subset=ids)
    y = b.withColumns({k: c for k, (_, c) in zip(ids, keys, strict=True)}).dropna(subset=ids)
    n, m = weights or (F.lit(1), F.lit(1))
    counts = x.groupBy(*ids).agg(F.sum(n).alias("__n")).join(y.groupBy(*ids).agg(F.sum(m).alias("__m")), ids)
    # as a double: pairs may exceed a bigint
    pairs = counts.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0.0
    meet = [F.col(f"{k}x") == F.col(f"{k}y") for k in ids]
    cond = reduce(and_, meet if more is None else [*meet, more])
    if pairs <= PLAIN:
        return x.withColumnsRenamed({k: f"{k}x" for k in ids}).join(y.withColumnsRenamed({k: f"{k}y" for k in ids}), cond).select(*a.columns, *b.columns)
    block = max(BLOCK, isqrt(int(pairs / (4 * TASKS))))
    cut = lambda n: F.ceil(F.col(n) / block)
    counts = counts.select(*ids, cut("__n").alias("__n"), cut("__m").alias("__m"))

    def dealt(df: DataFrame, mark: str, own: str, other: str) -> DataFrame:
        got = df.join(counts, ids).withColumns({f"__i{own}": F.pmod(row_hash(df), own), f"__i{other}": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))})
        got = got.drop("__n", "__m").withColumnsRenamed({k: f"{k}{mark}" for k in (*ids, "__i__n", "__i__m")})
        return got.repartition(min(TASKS, ceil(pairs / TASK)), *[f"{k}{mark}" for k in (*ids, "__i__n", "__i__m")])

    both = reduce(and_, [F.col(f"{k}x") == F.col(f"{k}y") for k in ("__i__n", "__i__m")])
    return dealt(x, "x", "__n", "__m").join(dealt(y, "y", "__m", "__n").hint("merge"), both & cond).select(*a.columns, *b.columns)
