"""Joins whose output is far larger than their input."""

from itertools import product

from pyspark.sql import functions as F

from plait.operators import spatial, wide
from plait.plans.query import Query


def _boxes(spark, n, mark, spread):
    return spark.range(n).select(
        F.col("id").alias(f"k{mark}"),
        *[((F.col("id") * p) % spread + q).cast("float").alias(f"{c}{e}{mark}") for c, p in (("x", 7), ("y", 3)) for e, q in ((0, 0), (1, 2))],
    )


DIMS, DIMS2 = [("x0", "x1"), ("y0", "y1")], [("x02", "x12"), ("y02", "y12")]


def test_blocks_give_the_pairs_of_a_plain_join(spark, monkeypatch):
    a, b = _boxes(spark, 60, "", 11), _boxes(spark, 50, "2", 13)
    want = sorted((x.k, y.k2) for x, y in product(a.collect(), b.collect()) if x.x0 <= y.x12 and x.x1 >= y.x02 and x.y0 <= y.y12 and x.y1 >= y.y02)
    for block, most in ((2_048, 4), (3, 4), (3, 10_000)):
        monkeypatch.setattr(wide, "BLOCK", block)
        monkeypatch.setattr(wide, "PLAIN", 0)
        monkeypatch.setattr(spatial, "LIST", most)
        assert sorted(map(tuple, spatial.overlap_join(a, b, DIMS, DIMS2, [4.0, 4.0]).select("k", "k2").collect())) == want, (block, most)


def test_tasks_follow_from_the_pairs(spark):
    """12,000 rows of one box on both sides: 144 million pairs, not for one task."""
    a, b = _boxes(spark, 12_000, "", 1), _boxes(spark, 12_000, "2", 1)
    got = spatial.overlap_join(a, b, DIMS, DIMS2, [4.0, 4.0])
    assert got.rdd.getNumPartitions() >= 30
    assert got.count() == 12_000**2


def test_a_join_of_many_by_many(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else "abc"[i % 3], None if i % 11 == 0 else i % 4) for i in range(90)]
    a = Query(spark.createDataFrame(rows, "x int, s string, n int"))
    b = a.select(y="x", s2="s", n2="n")
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[2] is not None and p[2] == q[2])
    for block, plain in ((2_048, wide.PLAIN), (2_048, 0), (4, 0)):
        monkeypatch.setattr(wide, "BLOCK", block)
        monkeypatch.setattr(wide, "PLAIN", plain)
        got = a.join(b, [("s", "s2"), ("n", "n2")], nullable=("s",), many=True).select("x", "y")
        assert sorted(map(tuple, got.to_list())) == want, (block, plain)
    monkeypatch.undo()
    big = Query(spark.range(10_000).select(F.col("id").alias("x"), (F.col("id") % 1).alias("n")))
    got = big.join(big.select(y="x", n2="n"), [("n", "n2")], many=True)
    assert got.df.rdd.getNumPartitions() >= 20 and got.df.count() == 10_000**2
