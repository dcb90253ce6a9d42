"""Helpers shared by the operators: shipping code to workers, durable intermediate tables,
distributed connected components and clash-free working columns."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where nothing is set a temporary folder serves, in local mode only; on a cluster that would be
    a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared folder, with its lineage cut.

    Losing an executor loses no part of it, and Spark's cleaner removes the files once nothing
    refers to them.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder under ``name``, and read again; it goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def give_back() -> None:
    """What Arrow, numpy and Python have freed goes to the system; else idle workers hold their largest batch's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a generator over a task's batches, after whose end memory is given back."""

    @functools.wraps(run)
    def of(batches):
        yield from run(batches)
        give_back()

    return of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Links of a node beyond which it is a hub, in parts of all links; there are at most 2 * HUBS of them.
HUBS, HUB = 20_000, 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long) as (node, root).

    ``root`` is the smallest node of the component; nodes without an edge are not returned.
    Alternating large-star and small-star rounds contract every component to a star in
    O(log n) rounds. A round aggregates minima with map-side combine and joins them back. The links
    of hubs, of which there can only be 2 * HUBS, meet their minima by a broadcast, so no task gets
    a hub's links; only counters reach the driver. Nulls and loops are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = durable(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, n = None, e.count()

    def with_least(df: DataFrame, low: DataFrame) -> DataFrame:
        """``df`` with its u's ``m`` of ``low`` (u, m, c), c being how many rows of ``df`` u has."""
        most = max(HUB, n // HUBS)
        if n <= most:
            return df.join(low.drop("c"), "u")
        hubs = F.broadcast(low.where(F.col("c") > most).drop("c"))
        rest = df.join(hubs.select(F.col("u").alias("__u")), F.col("u") == F.col("__u"), "left_anti").join(low.where(F.col("c") <= most).drop("c"), "u")
        return rest.unionByName(df.join(hubs, "u"))

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = with_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = with_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
