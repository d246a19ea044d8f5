"""Connected components of a link table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """Smallest reachable node of every linked node, as a table (node, label).

    Each round takes the smallest label among a node's neighbours and then
    follows the label's own label, so distances halve; it ends when nothing
    changes. Every round is written to the shared folder. The joins are plain
    sort-merge joins of two written tables, which adaptive execution splits
    where one label is shared by many nodes. Null nodes are ignored.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = Stored(spark, ends.unionAll(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = Stored(spark, edges.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = edges.df.join(labels.df, edges.df.v == labels.df.node).groupBy("u").agg(F.min("label").alias("near"))
        hooked = Stored(spark, labels.df.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "hooked")
        onward = hooked.df.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = Stored(spark, hooked.df.join(onward, F.col("label") == F.col("at")).select("node", "before", F.col("next").alias("label")), "labels")
        labels.drop()
        hooked.drop()
        labels = jumped
        if labels.df.where("before <> label").isEmpty():
            edges.drop()
            labels.df = labels.df.select("node", "label")
            return labels
