"""Problem 6: cutting oversized items at natural boundaries.

Balanced targets: the least number of pieces that can hold the item, equal
lengths between them, every cut moved to the strongest boundary near its target;
if a piece breaks the limit, one piece more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm._util import cut, ranged_prefix

#: Boundaries from the strongest to the weakest; a cut falls behind the match.
BOUNDARIES = tuple(map(re.compile, (r"\n[ \t]*\n\s*", r"[.!?…][\"”’»)\]]*\n", r"[.!?…][\"”’»)\]]*\s+", r"\n", r"[;:][ \t]+", r",[ \t]+", r"\s+")))
#: The widest a cut moves from its target, as a share of the distance between targets.
REACH = 0.25


def _cut_near(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], the nearest to the target among equals; the target itself if there is none."""
    for boundary in BOUNDARIES:
        best = None
        for m in boundary.finditer(text, max(0, low - 4), min(len(text), high + 4)):
            at = m.end()
            if low <= at <= high and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best
    return target


def spans(text: str | None, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a text: one for a text within the limit, none for an empty or null one.

    Pieces are at most `limit` code points, follow in order and cover the text;
    each but the first begins exactly `overlap` code points before the end of
    the one before it. Texts without boundaries are cut at the targets.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if not text:
        return []
    size = len(text)
    if size <= limit:
        return [(0, size)]
    n = -(-(size - overlap) // (limit - overlap))
    while True:
        step = (size - overlap) / n  # new text of each piece; the first has the overlap besides
        reach = int(step * REACH)
        cuts = [0]
        for k in range(1, n):
            target = overlap + round(k * step)
            low = max(cuts[-1] + overlap + 1 if k > 1 else overlap + 1, target - reach)
            cuts.append(_cut_near(text, target, low, min(size - 1, target + reach)))
        cuts.append(size)
        pieces = [(max(0, cuts[k] - overlap) if k else 0, cuts[k + 1]) for k in range(n)]
        if all(b - a <= limit for a, b in pieces):
            return pieces
        n += 1


def text_pieces(texts: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Cut the texts of `rec, rec_key, text` that exceed the limit; a row per piece.

    Texts within the limit and null ones are left out. Several rows of one key are
    re-deliveries of one record, of which any stands for all; only oversized texts
    are shuffled for that. Columns: rec, rec_key, piece (from 0), pieces, start
    (from 0), length, text.
    """
    schema = "rec string, rec_key string, piece int, pieces int, start int, length int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = spans(text, limit, overlap)
                rows = [[rec, key, i, len(found), a, b - a, text[a:b]] for i, (a, b) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                        names=["rec", "rec_key", "piece", "pieces", "start", "length", "text"],
                    )

    large = texts.select("rec", "rec_key", "text").where(F.length("text") > limit).dropDuplicates(["rec", "rec_key"])
    return large.mapInArrow(run, schema)


def page_sizes(pages: DataFrame) -> DataFrame:
    """`book_id, seq, page_id, chars` of every page once; a null text has 0 characters. Only these numbers are shuffled."""
    return pages.select("page_id", "book_id", "seq", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).where(F.col("book_id").isNotNull()).dropDuplicates(["page_id"])


def large_books(books: DataFrame, sizes: DataFrame, limit: int = 25000) -> DataFrame:
    """`book_id, total, least_pieces` of the books of `books` whose pages exceed the limit together."""
    totals = sizes.groupBy("book_id").agg(F.sum("chars").alias("total")).where(F.col("total") > limit)
    return totals.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi").withColumn("least_pieces", F.ceil(F.col("total") / limit).cast("int"))


def book_pieces(books: DataFrame, pages: DataFrame, limit: int = 25000) -> DataFrame:
    """Cut the books beyond the limit into runs of whole pages (by `seq`, `page_id`) with one page of overlap.

    A row per run: book_id, piece (from 0), pieces, first_seq, last_seq, n_pages
    and chars, all with the page of overlap, which is the last one of the run
    before; `overlap` tells if there is one. A run does without where the page of
    overlap takes over half the limit, or stands before a single page, and the two
    break the limit together; a single page beyond the limit is a run of its own,
    `oversize` true.

    A page belongs to the target its middle falls to, so all runs of all books
    come from one prefix sum over ranges of (book, page): no book is gathered in a
    task. Books with a run beyond the limit are cut again into more pieces; the
    rounds end, as the middles of two pages in such a run lie far apart.
    """
    sizes = page_sizes(pages)
    large = cut(large_books(books, sizes, limit))
    mine = sizes.join(large.select("book_id"), "book_id", "left_semi").withColumn("one", F.lit(1).cast("long"))
    placed = ranged_prefix(mine, ["book_id"], ["seq", "page_id"], "chars", "before").drop("one")
    ranked = cut(ranged_prefix(placed.withColumn("one", F.lit(1).cast("long")), ["book_id"], ["seq", "page_id"], "one", "at").drop("one"))
    plan, done = large.select("book_id", "total", F.col("least_pieces").cast("long").alias("n")), None
    while True:
        middle = F.col("before") + F.col("chars") / 2
        own = (
            ranked.join(plan, "book_id")
            .withColumn("run", F.least(F.floor(middle * F.col("n") / F.col("total")), F.col("n") - 1))
            .groupBy("book_id", "n", "run")
            .agg(F.min("at").alias("first"), F.min_by("seq", "at").alias("first_seq"), F.max_by("seq", "at").alias("last_seq"), F.count(F.lit(1)).alias("own"), F.sum("chars").alias("own_chars"))
        )
        previous = ranked.select("book_id", (F.col("at") + 1).alias("first"), F.col("chars").alias("lap_chars"), F.col("seq").alias("lap_seq"))
        runs = cut(own.join(previous, ["book_id", "first"], "left"))
        lap = F.coalesce("lap_chars", F.lit(0))
        lap = F.when(lap <= limit / 2, lap).otherwise(0)  # a larger one is done without rather than cut for
        judged = runs.withColumn("most", F.when((F.col("own") > 1) & (F.col("own_chars") + lap > limit), F.col("own_chars") + lap))
        again = cut(judged.groupBy("book_id", "n").agg(F.max("most").alias("most")).where(F.col("most").isNotNull()))
        good = runs.join(again.select("book_id"), "book_id", "left_anti")
        done = good if done is None else done.unionByName(good)
        if again.isEmpty():
            break
        plan = again.join(large.select("book_id", "total"), "book_id").select("book_id", "total", F.greatest(F.col("n") + 1, F.ceil(F.col("n") * F.least(F.col("most") / limit, F.lit(1.25)))).cast("long").alias("n"))
    number = Window.partitionBy("book_id").orderBy("first")
    laps = F.col("lap_chars").isNotNull() & (F.col("own_chars") + F.col("lap_chars") <= limit)
    return done.select(
        "book_id",
        (F.row_number().over(number) - 1).alias("piece"),
        F.count(F.lit(1)).over(Window.partitionBy("book_id")).cast("int").alias("pieces"),
        F.when(laps, F.col("lap_seq")).otherwise(F.col("first_seq")).alias("first_seq"),
        "last_seq",
        (F.col("own") + laps.cast("int")).cast("int").alias("n_pages"),
        (F.col("own_chars") + F.when(laps, F.col("lap_chars")).otherwise(0)).alias("chars"),
        laps.alias("overlap"),
        (F.col("own_chars") > limit).alias("oversize"),
    )


def oversized(documents: DataFrame, pages: DataFrame, books: DataFrame, text_limit: int = 4000, book_limit: int = 25000, overlap: int = 200) -> DataFrame:
    """`rec, rec_key` of what is cut, once each: texts of more than one piece, and books beyond the limit, of which a single page may be a piece by itself."""
    texts = documents.select(F.lit("documents").alias("rec"), F.col("doc_id").cast("string").alias("rec_key"), "text").unionByName(
        pages.select(F.lit("pages").alias("rec"), F.col("page_id").cast("string").alias("rec_key"), "text")
    )
    cut_texts = text_pieces(texts, text_limit, overlap).where("piece = 1").select("rec", "rec_key")
    cut_books = book_pieces(books, pages, book_limit).where("piece = 0").select(F.lit("books").alias("rec"), F.col("book_id").alias("rec_key"))
    return cut_texts.unionByName(cut_books)
