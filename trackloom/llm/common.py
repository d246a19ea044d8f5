"""Shared plumbing: table access, the cluster's shared folder, label folds."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and all tasks run in this process (tests on one machine) a folder of our
    own is made and recorded there; on a cluster that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/trackloom-{label}-{uuid.uuid4().hex[:16]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made with ``new_path`` in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that go to a Python worker at once.
BATCH = "4m"


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``; has the session hand rows to Python by bytes and not only by number.

    A batch of 10,000 long texts is held by the JVM and by the worker, each
    with copies. Every operator that hands texts to Python calls this, so none
    depends on what ran before. A limit that the session already has is left.
    """
    conf, limit = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, BATCH)
    return docs


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in batches by bytes. Bytes that are not UTF-8 become the replacement character, one rule for all encoders."""
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Stored:
    """A DataFrame written to the shared folder, so that its lineage is cut."""

    def __init__(self, spark: SparkSession, df: DataFrame, label: str):
        self.spark, self.path = spark, new_path(spark, label)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are done: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int, max_bytes: int) -> tuple[list[tuple[str, int]], float | None]:
    """Texts and labels to learn from: whole texts of at most ``max_per_class`` documents of each class, and of each no more than ``max_bytes`` of text beyond its first document.

    Only rows outside the held-out fold count; an id that has both labels
    counts for neither. Documents are taken in the order of the hash of their
    id, so the sample is the same however the tables are laid out; of several
    texts of an id it is the smallest one. These bounds are what may be
    broadcast and brought to the driver. The share of label 1 is over all
    labelled rows outside the fold, counted as if half a row of each class came
    on top, None where there are none.
    """
    valid = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    known = valid.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    ones, rows = known.agg(F.sum("_y"), F.count(F.lit(1))).first()
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (0, 1)]
    met = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")
    texts = met.groupBy("doc_id", "_y").agg(F.min("_t").alias("_t"))  # 2 x max_per_class rows from here on
    before = Window.partitionBy("_y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = texts.withColumn("_at", F.coalesce(F.sum(F.octet_length("_t")).over(before), F.lit(0))).where(F.col("_at") < max_bytes)
    found = held.select("doc_id", "_y", F.make_valid_utf8("_t").alias("_t")).toArrow().to_pydict()
    order = sorted(range(len(found["doc_id"])), key=lambda i: (found["doc_id"][i], found["_y"][i]))
    return [(found["_t"][i], found["_y"][i]) for i in order], ((ones or 0) + 0.5) / (rows + 1) if rows else None
