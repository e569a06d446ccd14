"""Sinks: texts by book, the index, and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_texts(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Pages as Parquet by a hash of the book, sorted within files; one folder per book would make as many files as books."""
    part = F.pmod(F.xxhash64("book_id"), F.lit(buckets))
    pages.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("page_id"), F.lit(16))).sortWithinPartitions("book_id", "seq").write.mode("overwrite").partitionBy("part").parquet(path)


def write_index(books: DataFrame, errors: DataFrame, path: str) -> None:
    """Books without texts in index order, errors, and an envelope with the time and counts."""
    index_order(books).write.mode("overwrite").parquet(f"{path}/books")
    errors.write.mode("overwrite").parquet(f"{path}/errors")
    counts = books.agg(F.count(F.lit(1)).alias("book_count"))
    counts.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{path}/envelope")


def index_order(books: DataFrame) -> DataFrame:
    """By first author or nothing, title, then file name and id, in code point order."""
    return books.orderBy(F.coalesce(F.get("author", F.lit(0)), F.lit("")), "title", "filename", "id")


def last_wins(files: DataFrame, order: str = "file_ord") -> tuple[DataFrame, DataFrame]:
    """(one row per id, the one of the last file; ids that several files share)."""
    rank = Window.partitionBy("id").orderBy(F.desc(order))
    one = files.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    return one, files.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """`key, value` state after `changes`; a key's change replaces its value. One change per key."""
    return state.join(changes.select("key"), "key", "left_anti").unionByName(changes.select("key", "value"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """Keyed state at `path`, empty if there is none yet."""
    try:
        return spark.read.schema("key string, value string").parquet(path)
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], "key string, value string")
