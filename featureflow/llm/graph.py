"""Connected components over an edge table, without collecting any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest node of its component, for edges (a, b) of any orderable type.

    Labels sink to the smallest neighbour's and then jump to their label's own label, so the
    number of rounds follows the logarithm of the longest chain. Minima are aggregated before
    they are shuffled, and each round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
    both = stored(both, "edges")
    held = labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        sunk = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("low"))
        sunk = stored(sunk, "sunk")
        jump = sunk.select(F.col("node").alias("j_node"), F.col("low").alias("j_low"))
        moved = sunk.join(jump, F.col("low") == F.col("j_node")).select("node", F.col("label").alias("old"), F.col("j_low").alias("label"))
        moved = stored(moved, "labels")
        discard(held, sunk)
        held, labels = moved, moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            discard(both)
            return labels
