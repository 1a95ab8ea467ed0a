"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import remove, write_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; a component is named by its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label's own
    label, so long chains shorten fast.  Labels live in written tables, never on the driver;
    minima are combined before they are shuffled, so a node with very many links is no
    hot spot, and joins on labels are plain ones that Spark may split.
    """
    ends = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    ends = write_table(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = write_table(ends.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = ends.join(labels, ends["src"] == labels["node"]).groupBy(F.col("dst").alias("near")).agg(F.min("label").alias("low"))
        new = labels.join(near, F.col("node") == F.col("near"), "left").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = new.join(hop, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "far").alias("label"))
        step = write_table(new, "labels")
        changed = not step.where("old <> label").isEmpty()
        for path in labels.inputFiles()[:1]:
            remove(links.sparkSession, path.rsplit("/", 1)[0])
        labels = step.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
