"""Full-text search in pages, with snippets, and navigation within a book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import find, offset_in_snippet, opens_main_text, snippet
from lectern.operators.catalogue import first_author


def hits(pages: DataFrame, query: str, exact: bool = True) -> DataFrame:
    """Pages with `at`, the 0-based position of the phrase, or of the first word where all words occur somewhere (as substrings, case ignored). A blank query has none."""
    text = F.lower("text")
    if not query.strip():
        return pages.withColumn("at", F.lit(0)).where(F.lit(False))
    words = [query] if exact else _words(query)
    has_all = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w.lower())) for w in words])
    return pages.where(has_all).withColumn("at", find(F.col("text"), words[0]))


def _words(query: str) -> list[str]:
    """Split at blanks as given: a leading blank yields an empty first word, which is found at 0."""
    import re

    return re.split(r"\s+", query.lower())


def search(books: DataFrame, pages: DataFrame, query: str, exact: bool = True, limit: int = 100) -> DataFrame:
    """The first `limit` hits in index order of books and page order, with snippets.

    Columns: position, book_id, title, author, locator, locator_type, excerpt,
    match_index, capped (whether the limit cut hits off). Repeats of a page are
    one hit; they are dropped among the hits. Only the leading hits reach the
    driver's sort.
    """
    found = hits(pages, query, exact).select("page_id", "book_id", "seq", "locator", "locator_type", "at", snippet(F.col("text"), F.col("at"), len(query)).alias("excerpt"))
    named = found.dropDuplicates(["page_id"]).join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id")
    order = [first_author(F.col("author")), F.col("title"), F.col("book_id"), F.col("seq"), F.col("page_id")]
    top = named.orderBy(*order).limit(limit + 1)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("capped", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return ranked.where(F.col("position") <= limit).select(
        "position", "book_id", "title", F.concat_ws(", ", "author").alias("author"), "locator", "locator_type", "excerpt", offset_in_snippet(F.col("at")).alias("match_index"), "capped"
    )


def main_text(pages: DataFrame) -> DataFrame:
    """Pages from the first one of their book that opens the main text; all pages of a book without one."""
    first = pages.where(opens_main_text(F.col("text"))).groupBy("book_id").agg(F.min("seq").alias("_first"))
    return pages.join(first, "book_id", "left").where(F.col("seq") >= F.coalesce("_first", F.lit(0))).drop("_first")


def in_book(pages: DataFrame, query: str, shown: int = 20, around: int = 100) -> DataFrame:
    """For every book the first `shown` pages of its main text that hold the query, with `n_found`, the number of all such pages.

    Blank queries find nothing. Hits are counted by an aggregate beside the rank,
    so a book with most of the hits is not gathered for its count.
    """
    found = hits(main_text(pages), query).select("page_id", "book_id", "seq", "locator", "at", snippet(F.col("text"), F.col("at"), len(query), around).alias("excerpt")).dropDuplicates(["page_id"])
    rank = Window.partitionBy("book_id").orderBy("seq", "page_id")
    first = found.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= shown)
    counts = found.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_found"))
    return first.join(counts, "book_id").select("book_id", "seq", "locator", "excerpt", offset_in_snippet(F.col("at"), around).alias("match_index"), "n_found")


def open_contents(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Contents entries whose section is a page's locator, with `first_seq`, the first such page. Entries without a section are left out."""
    first = pages.groupBy("book_id", F.col("locator").alias("section")).agg(F.min("seq").alias("first_seq"))
    return toc.where("section is not null and section <> 0").join(first, ["book_id", "section"])


def goto(toc: DataFrame, pages: DataFrame, prefix: int = 40, over: int = 20) -> DataFrame:
    """`book_id, ord, seq`: the first page of the book that contains the heading without its leading number, or its first `prefix` characters if it is longer than `over`; case ignored."""
    heading = F.lower(F.trim(F.regexp_replace("title", r"^\d+\s+", "")))
    wanted = toc.select("book_id", "ord", heading.alias("h")).where("h <> ''")
    text = F.lower("text")
    there = F.contains(text, F.col("h")) | ((F.length("h") > over) & F.contains(text, F.substring("h", 1, prefix)))
    return wanted.join(pages.select("book_id", "seq", "text"), "book_id").where(there).groupBy("book_id", "ord").agg(F.min("seq").alias("seq"))
