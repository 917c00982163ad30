"""Connected components of a link table by neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of `links` (a, b); comp is the smallest node of the component.

    Each round takes the least label among neighbours, hooks it to the old label's own label and
    follows that label's label, so that the number of rounds grows with the logarithm of a
    component's width. Rows per round: links, whatever the size of a component.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hook = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        root = hook.groupBy(F.col("comp").alias("node")).agg(F.min("new").alias("low"))
        fresh = hook.join(root.select(F.col("node").alias("comp"), "low"), "comp").select("node", F.col("comp").alias("was"), F.least("new", "low").alias("comp"))
        jump = fresh.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        done = staged(fresh.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), (F.least("comp", F.coalesce("far", "comp")) < F.col("was")).alias("moved")), "label")
        label = done.select("node", "comp")
        if done.where("moved").isEmpty():
            return label
