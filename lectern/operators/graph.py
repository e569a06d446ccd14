"""The citation graph: books, cited scholars, and who cites whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scholar_id(name: Column) -> Column:
    return F.concat(F.lit("scholar-"), F.regexp_replace(F.lower(name), "[^a-z0-9]", "-"))


def radius(count: Column, kind: Column) -> Column:
    return F.when(kind == "book", F.greatest(F.lit(24), 24 + 3 * count)).otherwise(F.greatest(F.lit(16), 12 + 4 * count))


def colour_class(kind: Column, cited: Column) -> Column:
    return F.when((kind == "book") & cited, "scholarIn").when(kind == "book", "book").otherwise("scholarOut")


def scholars(citations: DataFrame, books: DataFrame) -> DataFrame:
    """`scholar, name, n`: citations of each scholar by known books, the name as the least spelling."""
    known = citations.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi").distinct()
    return known.groupBy(F.lower("scholar").alias("scholar")).agg(F.min("scholar").alias("name"), F.count(F.lit(1)).alias("n"))


def nodes(citations: DataFrame, books: DataFrame, scholar_book: DataFrame) -> DataFrame:
    """Citing books, then cited scholars who have no book among them.

    Columns: id, label, type, cited (a book one of whose authors is cited, or any
    scholar), n (citations; of a book the most among its authors), radius, colour.
    """
    counts = scholars(citations, books)
    citing = books.join(citations.select(F.col("book_id").alias("id")).distinct(), "id", "left_semi")
    named = citing.select("id", F.explode("author").alias("a")).select("id", F.lower("a").alias("scholar")).join(counts.select("scholar", "n"), "scholar").groupBy("id").agg(F.max("n").alias("n"))
    book_nodes = citing.join(named, "id", "left").select("id", F.col("title").alias("label"), F.lit("book").alias("type"), F.col("n").isNotNull().alias("cited"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    with_book = scholar_book.join(citing.select(F.col("id").alias("book_id")), "book_id", "left_semi").select(F.col("scholar_lower").alias("scholar"))
    lone = counts.join(with_book, "scholar", "left_anti").select(scholar_id(F.col("name")).alias("id"), F.col("name").alias("label"), F.lit("scholar").alias("type"), F.lit(True).alias("cited"), "n")
    both = book_nodes.unionByName(lone)
    return both.withColumn("radius", radius(F.col("n"), F.col("type"))).withColumn("colour", colour_class(F.col("type"), F.col("cited")))


def edges(citations: DataFrame, books: DataFrame, scholar_book: DataFrame) -> DataFrame:
    """`source, target, type`: a book cites the book of a scholar (cites_author, never itself) or a scholar without one (cites)."""
    citing = books.select(F.col("id").alias("book_id")).join(citations.select("book_id").distinct(), "book_id", "left_semi")
    known = citations.join(citing, "book_id", "left_semi").distinct().withColumn("scholar_lower", F.lower("scholar"))
    own = scholar_book.join(citing, "book_id", "left_semi").select("scholar_lower", F.col("book_id").alias("target_book"))
    joined = known.join(own, "scholar_lower", "left")
    names = known.groupBy("scholar_lower").agg(F.min("scholar").alias("name"))
    to_book = joined.where("target_book is not null and target_book <> book_id").select(F.col("book_id").alias("source"), F.col("target_book").alias("target"), F.lit("cites_author").alias("type"))
    to_scholar = joined.where("target_book is null").join(names, "scholar_lower").select(F.col("book_id").alias("source"), scholar_id(F.col("name")).alias("target"), F.lit("cites").alias("type"))
    return to_book.unionByName(to_scholar)


def neighbours(edges_: DataFrame) -> DataFrame:
    """`id, other`: both ends of every edge, once."""
    return edges_.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges_.select("target", "source")).distinct()


def search_nodes(nodes_: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The first nodes, by label and id, whose label contains the query, case ignored; a blank query finds none."""
    q = query.strip().lower()
    return nodes_.where(F.lit(q != "") & F.contains(F.lower("label"), F.lit(q))).orderBy("label", "id").limit(limit)


def cluster_boxes(members: DataFrame, positions: DataFrame, margin: float = 60.0, least: int = 2) -> DataFrame:
    """Bounding boxes of clusters with at least `least` placed members: cluster, n, x0, y0, x1, y1."""
    placed = members.join(positions, "id")
    box = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"))
    return box.where(F.col("n") >= least)


def opacity(nodes_: DataFrame, members: DataFrame, kind: str = "all", cluster: str | None = None) -> DataFrame:
    """Add opacities of circle and text by filter of node type and cluster."""
    inside = members.where(F.col("cluster") == F.lit(cluster)).select("id").distinct().withColumn("_in", F.lit(True))
    df = nodes_.join(inside, "id", "left")
    off = (F.lit(kind != "all") & (F.col("type") != kind)).alias("off")
    out = F.lit(cluster is not None) & F.col("_in").isNull()
    return df.withColumn("circle", F.when(off, 0.1).when(out, 0.15).otherwise(1.0)).withColumn("text_opacity", F.when(off, 0.05).when(out, 0.08).otherwise(1.0)).drop("_in")
