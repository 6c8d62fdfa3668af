"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import storage


def components(links: DataFrame) -> DataFrame:
    """``id``, ``label`` (the smallest id reachable) for each id in ``links(a, b)``.

    A round gives each node the smallest label among its neighbours and then that label's own
    label, so paths shorten by a factor each round. Rounds are written to the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = storage.materialize(both, "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"))
    labels = storage.materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("label").alias("far"))
        moved = lower.join(jump, "step", "left").select("id", "old", F.coalesce("far", "step").alias("label"))
        moved = storage.materialize(moved, "labels")
        labels = moved.select("id", "label")
        if not moved.where("label <> old").head(1):
            return labels
