"""Connected components of a graph, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """From edges (a, b): node and root, the least node that it reaches.

    Each round every node takes the least label among its neighbours and then
    that label's own label, so long chains halve; a round is written to the
    shared folder and only the number of changes comes to the driver. A node of
    very many edges is summed by partial aggregation."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(
            labels.select("node", "root").join(near.withColumnRenamed("a", "node"), "node")
            .join(jump, "root", "left")
            .select("node", F.col("root").alias("old"), F.least("root", "m", "up").alias("root")),
            "labels",
        )
        discard(labels)
        labels = new
        if not new.filter("old <> root").limit(1).count():
            discard(both)
            out = new.drop("old")
            out._plait_path = new._plait_path
            return out
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
