"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Paths that this thread has settled and not forgotten, in order.
_mine = threading.local()


def _paths() -> list[str]:
    if not hasattr(_mine, "paths"):
        _mine.paths = []
    return _mine.paths


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, one of this machine in local
    mode, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="facetflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, spread: int | None = None) -> DataFrame:
    """``df``, written to the shared folder and read again: computed once, and not again when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/facetflow/{uuid.uuid4().hex}"
    (df.coalesce(spread) if spread else df).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    _paths().append(path)
    return found


def forget(df: DataFrame) -> None:
    """Deletes a settled table that no plan will read again, by the file system that holds it."""
    _forget(df.sparkSession, df.settled_at)


def _forget(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _paths():
        _paths().remove(path)


def settled_so_far() -> int:
    return len(_paths())


def forget_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes what this thread has settled since ``mark`` but for the tables to keep: for steps whose result is one."""
    kept = {getattr(df, "settled_at", None) for df in keep}
    for path in [p for p in _paths()[mark:] if p not in kept]:
        _forget(spark, path)


def with_keys(documents: DataFrame) -> DataFrame:
    """``documents`` in a settled table with ``__key``, a long of each row's own."""
    return settle(documents.withColumn("__key", F.monotonically_increasing_id()))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, which it does as the driver's
    garbage is collected."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """settle(), and how many rows meet the condition, counted as they are written."""
    seen = Observation()
    found = settle(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return found, seen.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long): label is the smallest node that can be reached.

    Rounds of taking the smallest label among the neighbours and then the label of one's label; their number grows
    with the logarithm of the longest chain. Nothing is gathered at the driver but how many labels have changed.
    """
    edges = settle(edges.select("a", "b"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("through"), F.col("next").alias("far"))
        step = step.join(jump, step.next == jump.through, "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next"))
        step, changed = counted(step, F.col("next") < F.col("label"))
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def bucket_components(buckets: DataFrame) -> DataFrame:
    """(doc, cluster) of the documents that share buckets (key, doc), directly or through others.

    Each document first takes the smallest one of its buckets; only where a bucket's documents have taken different ones
    does an edge remain, so a large group that shares many buckets is down to a few edges before components are found.
    """
    first = settle(buckets.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first"))
    met = settle(buckets.join(first, "key").select("key", "doc", "first"))
    near = settle(met.groupBy("doc").agg(F.min("first").alias("near")))
    taken = settle(met.join(near, "doc").select("key", "near").distinct())
    least = taken.groupBy("key").agg(F.min("near").alias("a"), F.max("near").alias("b")).where("a < b").select("key", "a")
    edges = taken.join(least, "key").where("a < near").select("a", F.col("near").alias("b")).distinct()
    labels = components(edges)
    return near.join(labels, near.near == labels.node, "left").select("doc", F.coalesce("label", "near").alias("cluster"))


