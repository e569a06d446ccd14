"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table of that name below `root`; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's shared checkpoint folder and go on from there.

    The folder is the one the session names in spark.checkpoint.dir. A session
    that names none gets a temporary one if it runs on one machine (local, as
    tests do); on a cluster that is an error, as its executors share no such folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint(eager=True)


def norm_lang(lang: Column) -> Column:
    """`EN`, `en-GB`, `en_us` -> `en`; null and blank -> `und`."""
    base = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)", 1))
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("und")).otherwise(base)


def ranged_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the same `keys`, in `order`.

    The rows are range-partitioned by keys and order, so a key with any share of
    the rows spreads over many tasks. Each task sums its own run; what precedes
    a run within its key is the total of that key in earlier partitions, a table
    of one row per (partition, key) at most. `order` must be unique within `keys`.
    The ranged rows are checkpointed first: their partition numbers must not
    change when a lost task runs again.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_pid").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return run.join(offsets, [*keys, "_pid"]).withColumn(out, F.col("_run") + F.col("_offset")).drop("_pid", "_run", "_offset")
