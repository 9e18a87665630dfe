"""Scratch tables in the cluster's shared folder, and column helpers."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: the white space every contract here names, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set with setCheckpointDir.  Only a session in one process (tests, a laptop) gets a folder
    of our own where both are unset: executors elsewhere couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tokenloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Scratch:
    """Tables written under the shared folder: they cut lineage and outlive a lost executor.

    A result may read them until it is written itself, so they go with the session unless they are dropped before.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        store, path = self._store(self.root)
        store.mkdirs(path)
        store.deleteOnExit(path)
        Scratch.made.append(self)

    def _store(self, path: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of phases whose results are written; it tracks them by driver garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        store, path = self._store(self.path(name))
        store.delete(path, True)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The runs of non-space characters, in order."""
    for ch in SPACES[1:]:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def before_each(df: DataFrame, order: list[Column], values: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """df with the sums of ``values`` over all rows before each in ``order``, which must be total.

    Rows are sorted in range partitions; what crosses them is one row of totals for each partition.
    """
    placed = df.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id())
    placed = scratch.table(placed.select("*", *[v.cast("long").alias(f"range_{k}") for k, v in values.items()]), name)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range_part").agg(*[F.sum(f"range_{k}").alias(f"range_{k}") for k in values])
    offsets = sums.select(F.col("range_part"), *[F.coalesce(F.sum(f"range_{k}").over(ahead(Window.orderBy("range_part"))), F.lit(0)).alias(f"range_before_{k}") for k in values])
    inner = ahead(Window.partitionBy("range_part").orderBy(*order))
    both = placed.join(F.broadcast(offsets), "range_part")
    return both.select(*df.columns, *[(F.col(f"range_before_{k}") + F.coalesce(F.sum(f"range_{k}").over(inner), F.lit(0))).alias(k) for k in values])


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node that ``links`` (a, b) reach from it; nodes without links are left out.

    Each round takes the least label among neighbours and then the label's own label, until nothing changes.
    """
    edges = scratch.table(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), f"{name}-edges")
    labels = scratch.table(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        moved = scratch.table(moved, f"{name}-{step}")
        labels = moved.select("node", "label")
        if not moved.where("label < old").take(1):
            return labels
