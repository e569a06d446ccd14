"""The library's tables: readers that settle re-deliveries, and adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def latest(df: DataFrame, *keys: str, by: str = "loaded_at") -> DataFrame:
    """One row per key, the latest delivery. Shuffles whole rows: select what is needed before."""
    rank = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def books(spark: SparkSession, root: str) -> DataFrame:
    """Books without their definitions map, once per id."""
    return latest(read(spark, root, "books").drop("definitions"), "id")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """What a view shows of a book: id, title, author, year, format; once per id."""
    return latest(read(spark, root, "books").select("id", "title", "author", "year", "format", "loaded_at"), "id").drop("loaded_at")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages as delivered: a page may come again. Operators drop repeats after their filters, so text is not shuffled for it."""
    return read(spark, root, "pages").select("page_id", "book_id", "seq", "locator", "locator_type", "text")


def definitions(spark: SparkSession, root: str) -> DataFrame:
    """Definitions, exact repeats once."""
    return read(spark, root, "definitions").dropDuplicates(["def_id"])


def toc(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "toc").dropDuplicates(["book_id", "ord"])


def definitions_of(books_with_map: DataFrame) -> DataFrame:
    """The normalised table of a books table's `definitions` map: book_id, term, ord (within the term), locator, locator_type, excerpt."""
    terms = books_with_map.select(F.col("id").alias("book_id"), F.explode("definitions").alias("term", "list"))
    return terms.select("book_id", "term", F.posexplode("list").alias("ord", "d")).select("book_id", "term", "ord", "d.locator", "d.locator_type", "d.excerpt")


def map_of(definitions_: DataFrame) -> DataFrame:
    """The inverse: `id, definitions`, lists in `ord` order. Equal orders fall to the excerpt."""
    item = F.struct("ord", "excerpt", "locator", "locator_type")
    lists = definitions_.groupBy("book_id", "term").agg(F.sort_array(F.collect_list(item)).alias("list"))
    clean = F.transform("list", lambda d: F.struct(d["locator"].alias("locator"), d["locator_type"].alias("locator_type"), d["excerpt"].alias("excerpt")))
    return lists.groupBy(F.col("book_id").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", clean.alias("list"))))).alias("definitions"))


def lexicon(spark: SparkSession, paths: list[str], default: tuple[str, ...] = ("text", "technology")) -> list[str]:
    """Search terms from the first readable JSON file `{"terms": [{"term": ...}]}`: parts between `/`, longer than two characters, lower-cased. A lexicon is configuration and small."""
    from lectern.functions.text import term_parts

    for path in paths:
        try:
            rows = spark.read.json(path, multiLine=True).select(F.explode("terms").alias("t")).select(F.posexplode(term_parts(F.col("t.term"))).alias("i", "part"))
            return [r.part for r in rows.collect()]
        except Exception:  # noqa: BLE001, S112 - an absent or malformed file means the next
            continue
    return list(default)


def names_list(spark: SparkSession, path: str, field: str = "frameworks") -> DataFrame:
    """`name` from a JSON list; empty if the file cannot be read."""
    try:
        return spark.read.json(path, multiLine=True).select(F.explode(field).alias("name")).orderBy("name")
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], "name string")


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants given by the caller."""
    return spark.createDataFrame(rows, schema)
