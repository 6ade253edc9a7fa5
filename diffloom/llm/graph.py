"""Connected components by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Rounds of plain propagation before labels of labels are looked up as well.
PLAIN_ROUNDS = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``edges`` (a, b): the smallest node of each component.

    A round takes the smallest label of a node and its neighbours, which settles stars and
    other shallow components; later rounds also take the label of that label, so chains need
    about the logarithm of their length.  Only the number of changed labels comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "labels")
    rounds = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(
            F.col("a").alias("node"), "label", F.lit(None).cast(both.schema["a"].dataType).alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        new = near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        if rounds >= PLAIN_ROUNDS:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
            new = new.join(jump, "label", "left").select("node", F.least("label", "jumped").alias("label"), "was")
        new = materialize(new, "labels")
        labels, rounds = new.select("node", "label"), rounds + 1
        if not new.where("label <> was").count():
            return labels
