"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors get the helpers of this subpackage with each task and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["turnwise.llm"])

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    return f"file://{_own_folder[app]}"


#: The tables of the scratch() around the code that runs; each thread or task of the driver has its own.
_scratch: ContextVar[list[Staged] | None] = ContextVar("scratch", default=None)


class Staged:
    """A table written to the shared folder, so that a lost executor costs only its running tasks.

    It goes when it is dropped, when the scratch() around it ends, or else with the application.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self._folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._folder)
        df.write.parquet(self.path)
        self.schema = df.schema
        if (around := _scratch.get()) is not None:
            around.append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        self._files.delete(self._folder, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What is staged within goes at its end; results that still read it must be written before."""
    own: list[Staged] = []
    before = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(before)
        for table in own:
            table.drop()


@contextmanager
def kept() -> Iterator[None]:
    """What is staged within outlives the scratch() around it."""
    before = _scratch.set(None)
    try:
        yield
    finally:
        _scratch.reset(before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).read()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def thinned(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes as edges(a, b: long), with few more than one for each b once repeats are gone.

    Of the edges of a b only that to its least a stays; the others become edges from that to their
    own a. So where many b have the same few a, as members of one group found in many cells, most
    edges are repeats. The edges of a b come to one task: b is the side whose number of them is bounded.
    """
    least = edges.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    return least.select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges(a, b: long): undirected, repeats and loops allowed. Returns (node, component): each node
    that has an edge to another node, with the smallest node of its component. Rows stay
    distributed; each half of a round is written to the shared folder, as the next reads it twice,
    and the one before it is removed.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").withColumn("m", F.least("a", "m"))
        if large:
            new = e.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            own = least.select("a", F.col("m").alias("b"))
            new = e.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
        return new.where("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = Staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now.read())
    for _ in range(max_rounds):
        if not before[0]:
            break
        for large in (True, False):
            after = Staged(star(now.read(), large), "edges")
            now.drop()
            now = after
        seen = state(now.read())
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = now.read()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
