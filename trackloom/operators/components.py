"""Connected components of a table of links, and the scratch tables of jobs that go on in rounds."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Tables in the folder that the driver and all executors share, which cut a job's lineage; gone when the block ends, but for those that ``keep`` wrote.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that
    is unset and all tasks run in this process, one of our own is made.
    """

    def __init__(self, spark: SparkSession):
        known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not known:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="trackloom-"))
            known = spark.sparkContext.getCheckpointDir()
        self.spark, self.folder = spark, f"{known.rstrip('/')}/trackloom-scratch-{uuid.uuid4().hex[:16]}"
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(self.folder)

    def drop(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table."""
        path = f"{self.folder}/{uuid.uuid4().hex[:16]}"
        self.paths.append((self._written(df, path), path))
        return self.paths[-1][0]

    def replace(self, df: DataFrame, *old: DataFrame) -> DataFrame:
        """``df`` as a written table in place of earlier ones of ``cut``, which go, as do the shuffles that made it: jobs that go on in rounds hold one round on disk."""
        new = self.cut(df)
        for held, path in [(held, path) for held, path in self.paths if any(held is o for o in old)]:
            self.drop(path)
        self.paths = [p for p in self.paths if not any(p[0] is o for o in old)]
        # Spark deletes shuffle files once the driver has collected what refers to them.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return new

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that stays, as a result is read from it."""
        return self._written(df, f"{self.folder}-kept")


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that is linked to another one; the root is the smallest node reachable.

    Nodes may be of any type that has an order, structs included. Each round
    takes the smallest root among a node's neighbours and then the root's own
    root, so distances halve. Null nodes and links to oneself are ignored. The
    result is one of the scratch's tables.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = scratch.cut(ends.unionAll(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = scratch.cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("root")))
    held = roots
    while True:
        near = edges.join(roots, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hooked = scratch.cut(roots.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("before"), F.least("root", "near").alias("root")))
        onward = hooked.select(F.col("node").alias("at"), F.col("root").alias("next"))
        held = scratch.replace(hooked.join(onward, F.col("root") == F.col("at")).select("node", "before", F.col("next").alias("root")), held, hooked)
        settled = held.where("before <> root").isEmpty()
        roots = held.select("node", "root")
        if settled:
            return roots
