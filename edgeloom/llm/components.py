"""Connected components of a link table, as joins and minimum sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import durable


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``links``.

    Each round gives a node, and the node that it points to, the least parent among its
    neighbours, then halves the paths. Rounds grow with the logarithm of a component's
    diameter in practice. All grouping is by minimum, which Spark combines before the
    shuffle, and each join has one row per key on its right side, so that a component
    with most of the nodes is dealt out. Each round is written to the shared folder.
    """
    both = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    both = durable(both.union(both.select("b", "a")).distinct(), "components-links")
    nodes = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent")), "components-0")
    while True:
        seen = both.join(nodes, F.col("b") == F.col("node")).groupBy("a").agg(F.min("parent").alias("low"))
        own = nodes.join(seen, F.col("node") == F.col("a")).select("node", "parent", F.least("parent", "low").alias("low"))
        hooks = own.filter("low < parent").groupBy(F.col("parent").alias("root")).agg(F.min("low").alias("hook"))
        hooked = own.join(hooks, F.col("node") == F.col("root"), "left").select("node", "parent", F.least("low", "hook").alias("next"))
        jump = hooked.select(F.col("node").alias("via"), F.col("next").alias("far"))
        moved = hooked.join(jump, F.col("next") == F.col("via")).select("node", F.col("far").alias("parent"), (F.col("far") != F.col("parent")).alias("moved"))
        moved = durable(moved, "components-round")
        nodes = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return nodes.withColumnRenamed("parent", "component")
