"""Connected components of a table of links, by spreading smallest labels and jumping over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweave.llm.lineage import shared_checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node that links reach.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label;
    rounds end when nothing changes. Labels and links stay distributed.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other").distinct()
    both = shared_checkpoint(both)
    labels = both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = shared_checkpoint(labels)
    while True:
        theirs = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", F.lit(None).cast("bigint").alias("before"))
        spread = theirs.unionByName(labels.withColumn("before", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("before").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = shared_checkpoint(spread.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label")))
        settled = after.where("label <> before").isEmpty()
        labels = after.select("node", "label")
        if settled:
            return labels
