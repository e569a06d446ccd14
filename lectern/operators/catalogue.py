"""The catalogue: filters, orders, counts and projections of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import word_count

SECTIONED = ("epub", "mobi", "azw3")


def author_display(author: Column, separator: str = ", ", none: str = "Unknown") -> Column:
    """Names joined; `none` for a null or empty list."""
    return F.when(F.size(F.coalesce(author, F.array().cast("array<string>"))) == 0, F.lit(none)).otherwise(F.array_join(author, separator))


def year_display(year: Column) -> Column:
    return F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n.d."))


def unit(format_: Column) -> Column:
    return F.when(F.lower(format_).isin(*SECTIONED), "sections").otherwise("pages")


def counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def first_author(author: Column) -> Column:
    return F.coalesce(F.get(author, F.lit(0)), F.lit(""))


def matching(books: DataFrame, text: str = "", format_: str = "all") -> DataFrame:
    """Books whose title or authors contain the text, case ignored, and that have the format; an empty text and `all` pass every book."""
    q = text.lower()
    hit = F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower(F.concat_ws(" ", "author")), F.lit(q))
    return books.where((F.lit(q == "") | hit) & (F.lit(format_ == "all") | (F.col("format") == format_)))


def ordered(books: DataFrame, by: str = "title", collation: str | None = None) -> DataFrame:
    """Add `position`, from 1: by title, year (latest first, unknown last) or author; ties in index order (first author, title, id).

    `collation` names one for title and author; by default order is by code point.
    The position is a rank over all books: sort and limit where only the first are
    needed.
    """
    fold = lambda c: F.collate(c, collation) if collation else c
    keys = {"title": [fold(F.col("title"))], "year": [F.coalesce("year", F.lit(0)).desc()], "author": [fold(first_author(F.col("author")))]}[by]
    return books.withColumn("position", F.row_number().over(Window.orderBy(*keys, first_author(F.col("author")), "title", "id")))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_terms(definitions: DataFrame, n: int = 15) -> DataFrame:
    """The `n` most frequent terms; equal counts in order of the term's first row (least def_id)."""
    return definitions.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("def_id").alias("first")).orderBy(F.desc("n"), "first").limit(n).select("term", "n")


def statistics(pages: DataFrame) -> DataFrame:
    """`book_id, word_count, page_count, blank_pages, scanned`: over each book's pages with text; `scanned` if over four fifths are blank. Pages that come again count once; only numbers are shuffled."""
    sizes = pages.select("page_id", "book_id", word_count(F.col("text")).alias("words"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank")).dropDuplicates(["page_id"])
    return sizes.groupBy("book_id").agg(
        F.sum("words").alias("word_count"), F.sum((~F.col("blank")).cast("long")).alias("page_count"), F.sum(F.col("blank").cast("long")).alias("blank_pages"), (F.sum(F.col("blank").cast("long")) > 0.8 * F.count(F.lit(1))).alias("scanned")
    )


def summary(books: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: books, failed files, authors, formats."""
    n = books.agg(F.count(F.lit(1)).alias("n_books"), F.count_distinct("format").alias("n_formats"), F.sum(F.size(F.coalesce("author", F.array().cast("array<string>"))).cast("long")).alias("n_author_entries"))
    return n.withColumn("n_failed", F.lit(0).cast("long")) if errors is None else n.crossJoin(errors.agg(F.count(F.lit(1)).alias("n_failed")))


def covers(books: DataFrame, files: DataFrame) -> DataFrame:
    """Add `cover`: the book's `{id}.jpg`, else `{id}.png` among `files.name`, else null."""
    listed = files.select(F.regexp_extract("name", r"^(.*)\.(jpg|png)$", 1).alias("id"), "name").where("id <> ''")
    best = listed.groupBy("id").agg(F.min("name").alias("cover"))  # .jpg sorts before .png
    return books.join(best, "id", "left")


def step(at: Column, n: Column, by: int) -> Column:
    """A cursor moved by `by` within [0, n)."""
    return F.greatest(F.lit(0), F.least(n - 1, at + by))
