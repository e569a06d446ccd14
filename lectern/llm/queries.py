"""The queries of this package by name: callables of (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import encoding, lookalikes, mixing, names, neardup, quality, residue, scans, splitting, tokenizer
from lectern.llm._util import read


def _texts(spark: SparkSession, root: str, *tables: str) -> DataFrame:
    """`rec, rec_key, text` of the tables named, one after the other."""
    columns = {"documents": ("doc_id", "text"), "pages": ("page_id", "text"), "definitions": ("def_id", "excerpt"), "books": ("id", "title")}
    parts = [
        read(spark, root, t).select(F.lit(t).alias("rec"), F.col(columns[t][0]).cast("string").alias("rec_key"), F.col(columns[t][1]).alias("text")) for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding.find(_texts(spark, root, "documents", "pages", "books"), read(spark, root, "documents")).select("rec", "rec_key")


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    return encoding.find(_texts(spark, root, "documents", "pages", "books"), read(spark, root, "documents"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return names.same_entity(read(spark, root, "books"))


def p2_clusters(spark: SparkSession, root: str) -> DataFrame:
    return names.clusters(read(spark, root, "books"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root, "documents", "pages", "definitions")
    return lookalikes.find(texts, lookalikes.rewriter([texts]), encoding.dictionaries(read(spark, root, "documents"))).select("rec", "rec_key")


def p3_rewritten(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root, "documents", "pages", "definitions")
    return lookalikes.rewrite(texts, lookalikes.rewriter([texts]))


def _excerpts(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "definitions").select(F.col("def_id").alias("id"), F.array("excerpt").alias("texts"))


def _books(spark: SparkSession, root: str) -> DataFrame:
    excerpts = F.flatten(F.transform(F.map_values("definitions"), lambda ds: F.transform(ds, lambda d: d["excerpt"])))
    return read(spark, root, "books").select("id", excerpts.alias("texts"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    kinds = {"excerpt": _excerpts(spark, root), "book": _books(spark, root)}
    return reduce(DataFrame.unionByName, [neardup.similar_pairs(r).select(F.lit(k).alias("kind"), "id_a", "id_b") for k, r in kinds.items()])


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    kinds = {"excerpt": _excerpts(spark, root), "book": _books(spark, root)}
    return reduce(DataFrame.unionByName, [neardup.groups(*neardup.similar_sets(r)).select(F.lit(k).alias("kind"), "id", "group", "n_links") for k, r in kinds.items()])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.not_prose(read(spark, root, "documents"), read(spark, root, "quality_labels"))


def p5_statistics(spark: SparkSession, root: str) -> DataFrame:
    return quality.statistics(read(spark, root, "documents")).drop("text_hash", "residue")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.oversized(read(spark, root, "documents"), read(spark, root, "pages"), read(spark, root, "books"))


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.text_pieces(_texts(spark, root, "documents", "pages"))


def p6_book_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.book_pieces(read(spark, root, "books"), read(spark, root, "pages"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root, "documents", "pages", "definitions")
    return scans.find(texts, scans.vocabulary(texts)).select("rec", "rec_key")


def p7_repaired(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root, "documents", "pages", "definitions")
    return scans.find(texts, scans.vocabulary(texts), repaired=True)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.token_ids(read(spark, root, "documents").select("doc_id", "text"))


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents"), read(spark, root, "mixture"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents"), read(spark, root, "mixture"))[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(read(spark, root, "documents")).select("doc_id")


def p10_kept(spark: SparkSession, root: str) -> DataFrame:
    return residue.without_residue(read(spark, root, "documents").select("doc_id", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_clusters, p3_found, p3_rewritten, p4_found, p4_groups, p5_found, p5_statistics, p6_found, p6_pieces, p6_book_pieces, p7_found, p7_repaired, p8_ids, p9_selection, p9_shares, p10_found, p10_kept)}

#: Equivalent SQL where SQL can express the operator over whole tables.
ORACLE: dict[str, str] = {
    "p6_found": """
        SELECT 'documents' AS rec, CAST(doc_id AS VARCHAR) AS rec_key FROM documents WHERE length(text) > 4000
        UNION SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages WHERE length(text) > 4000
        UNION SELECT 'books', book_id FROM (SELECT DISTINCT page_id, book_id, coalesce(length(text), 0) AS n FROM pages)
        WHERE book_id IN (SELECT id FROM books) GROUP BY book_id HAVING sum(n) > 25000
    """,
}
