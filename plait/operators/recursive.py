"""Recursive queries: a seed and a step over the rows found last."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that the executors share."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="plait-"))
    return df.checkpoint()


def recursive_union_all(seed: DataFrame, step: Step, most: int = 1000) -> DataFrame:
    """Rows of the seed and of each step over the rows before; a step's columns
    go by place. More than `most` steps is an error."""
    found, front = [seed], seed
    for _ in range(most):
        front = _cut(step(front).toDF(*seed.columns))
        if front.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(front)
    raise RecursionError(f"no end after {most} steps")


def recursive_union(seed: DataFrame, step: Step, most: int = 1000) -> DataFrame:
    """As above with distinct rows: ends on cycles (semi-naive evaluation)."""
    seen = front = _cut(seed.distinct())
    for _ in range(most):
        new = step(front).toDF(*seed.columns).distinct().alias("n")
        old = seen.alias("o")
        same = reduce(and_, [new[c].eqNullSafe(old[c]) for c in seed.columns])
        front = _cut(new.join(old, same, "left_anti"))
        if front.isEmpty():
            return seen
        seen = _cut(seen.union(front))
    raise RecursionError(f"no end after {most} steps")
