"""Connected components of a link table, as joins and minimum sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import durable


def linked_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``links`` (``src``, ``dst``).

    A round gives each node the least parent among its own and its neighbours', hands it
    on to the parent itself, and halves the paths. Minima are taken before the shuffle and
    joins have one row per key on one side. Each round is written to the shared folder.
    """
    both = links.filter("src <> dst")
    both = durable(both.select("src", "dst").union(both.select("dst", "src")).distinct(), "linked")
    state = durable(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("parent")), "linked-round")
    while True:
        around = both.join(state, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("of")).agg(F.min("parent").alias("around"))
        own = state.join(around, F.col("node") == F.col("of")).select("node", "parent", F.least("parent", "around").alias("best"))
        told = own.groupBy(F.col("parent").alias("root")).agg(F.min("best").alias("told"))
        next_ = own.join(told, F.col("node") == F.col("root"), "left").select("node", "parent", F.least("best", "told").alias("next"))
        far = next_.select(F.col("node").alias("via"), F.col("next").alias("far"))
        state = durable(next_.join(far, F.col("next") == F.col("via")).select("node", F.col("far").alias("parent"), (F.col("far") != F.col("parent")).alias("moved")), "linked-round")
        if state.filter("moved").isEmpty():
            return state.select("node", F.col("parent").alias("component"))
        state = state.drop("moved")
