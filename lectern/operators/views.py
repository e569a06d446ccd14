"""Views over definitions: glossary, threads, frameworks, term comparison, flash cards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import term_head


def first_by(df: DataFrame, key: Column, *order: str, within: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in the given order, over all rows or within groups. The key spreads the rows; a frequent key's rows are pre-reduced by rank."""
    rank = Window.partitionBy(*within, key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def with_books(definitions: DataFrame, books: DataFrame) -> DataFrame:
    b = books.select(F.col("id").alias("book_id"), "title", F.concat_ws(", ", "author").alias("author"))
    return definitions.join(b, "book_id")


def glossary_passages(glossary: DataFrame, definitions: DataFrame, books: DataFrame) -> DataFrame:
    """For every glossary term, the definitions of any term whose excerpt contains the head of the term, case ignored; the first of those that share 100 characters, in def_id order.

    The glossary is matched by one pass per definition: its heads are few and are
    joined as a small table, which Spark broadcasts if it is small and else
    loops over in blocks.
    """
    heads = glossary.select(F.col("id").alias("glossary_id"), term_head(F.col("term")).alias("head")).where("head <> ''")
    found = definitions.join(heads, F.contains(F.lower(F.col("excerpt")), F.col("head")))
    return with_books(first_by(found, F.substring("excerpt", 1, 100), "def_id", within=["glossary_id"]), books).select("glossary_id", "def_id", "book_id", "title", "author", F.col("term").alias("matched_term"), "locator", "locator_type")


def thread_passages(thread_terms: DataFrame, definitions: DataFrame, books: DataFrame) -> DataFrame:
    """Definitions of a thread's terms by book: the first of those of a book that share 80 characters, in order of the thread's terms and def_id; `n` counts within the book from 1."""
    found = definitions.join(thread_terms.select("thread_id", "term", F.col("ord").alias("term_ord")), "term")
    once = first_by(found, F.substring("excerpt", 1, 80), "term_ord", "def_id", within=["thread_id", "book_id"])
    n = F.row_number().over(Window.partitionBy("thread_id", "book_id").orderBy("term_ord", "def_id"))
    return with_books(once.withColumn("n", n), books).select("thread_id", "book_id", "title", "author", "n", "term", "def_id", "locator")


def thread_counts(threads: DataFrame, thread_terms: DataFrame, definitions: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """`thread_id, n_passages, n_books` with zeros: the curated passages of threads that have some, else the definitions of their terms, before any dropping of repeats."""
    by_term = definitions.groupBy("term", "book_id").agg(F.count(F.lit(1)).alias("n"))
    found = thread_terms.join(by_term, "term").groupBy("thread_id").agg(F.sum("n").alias("n_passages"), F.count_distinct("book_id").alias("n_books"))
    out = threads.select(F.col("id").alias("thread_id")).join(found, "thread_id", "left")
    if curated is not None:
        own = curated.groupBy("thread_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("book_id").alias("_b"))
        out = out.join(own, "thread_id", "left").select("thread_id", F.coalesce("_n", "n_passages").alias("n_passages"), F.coalesce("_b", "n_books").alias("n_books"))
    return out.fillna(0, ["n_passages", "n_books"])


def curated_passages(curated: DataFrame, books: DataFrame, tag: str = "technology") -> DataFrame:
    """Curated excerpts with their books; a book that is missing shows its id as title, no author and no year."""
    b = books.select(F.col("id").alias("book_id"), "title", F.concat_ws(", ", "author").alias("author"), "year")
    return curated.join(b, "book_id", "left").select("thread_id", "ord", "book_id", F.coalesce("title", "book_id").alias("title"), F.coalesce("author", F.lit("")).alias("author"), "year", "excerpt", F.lit(tag).alias("matched_term"))


def framework_words(name: str, longer_than: int = 3) -> list[str]:
    return [w for w in name.lower().split() if len(w) > longer_than]


def framework_match(frameworks: Sequence[str], books: DataFrame, definitions: DataFrame, terms: Sequence[str]) -> DataFrame:
    """`framework, book_id`: books with any longer word of the framework in title, authors or the excerpts of `terms`, case ignored.

    Each definition is tested where it lies and only the hits are shuffled, so no
    book's excerpts are gathered; frameworks are a list of names.
    """
    words = {f: framework_words(f) for f in frameworks if framework_words(f)}
    if not words:
        return books.select(F.lit("").alias("framework"), F.col("id").alias("book_id")).where(F.lit(False))

    def of(text: Column) -> Column:
        hit = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ws]), F.lit(f)) for f, ws in words.items()]
        return F.explode(F.array_compact(F.array(*hit)))

    from_books = books.select(F.col("id").alias("book_id"), of(F.lower(F.concat_ws(" ", "title", F.array_join("author", " ")))).alias("framework"))
    from_excerpts = definitions.where(F.col("term").isin(*terms)).select("book_id", of(F.lower("excerpt")).alias("framework"))
    known = books.select(F.col("id").alias("book_id"))
    return from_books.unionByName(from_excerpts.join(known, "book_id", "left_semi")).select("framework", "book_id").distinct()


def framework_passages(matched: DataFrame, books: DataFrame, definitions: DataFrame, terms: Sequence[str], n: int = 3) -> DataFrame:
    """The first `n` definitions of `terms`, in their order, of each matched book."""
    rank_of = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    ranked = definitions.where(F.col("term").isin(*terms)).withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy(rank_of, "ord", "def_id"))).where(F.col("n") <= n)
    return with_books(matched.join(ranked, "book_id"), books).select("framework", "book_id", "title", "author", "n", "term", "def_id")


def compared_terms(definitions: DataFrame, books: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Definitions of the terms with their books, and `position` within the term by author, title and def_id."""
    return with_books(definitions.where(F.col("term").isin(*terms)), books).withColumn("position", F.row_number().over(Window.partitionBy("term").orderBy("author", "title", "def_id"))).select("term", "position", "author", "title", "def_id", "locator")


def deck(books: DataFrame, cards: DataFrame) -> DataFrame:
    """Books that have a flash card."""
    return books.join(cards.select(F.col("book_id").alias("id")).distinct(), "id", "left_semi")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add `position`: a permutation that depends on seed and key only, not on partitions."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key)))
