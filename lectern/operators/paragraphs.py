"""Paragraphs of pages. The state carried from line to line is told by regular expressions and small rules, so it runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import is_footnote, is_heading, split_paragraphs


def paragraphs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """`key, n, text, kind, indent`: the paragraphs of every page in order; body paragraphs behind a heading, and a page's first, are not indented. Repeats of a page count once."""
    kind = pages.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, paragraphs array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([split_paragraphs(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "paragraphs"])

    rows = pages.select(key, "text").dropDuplicates([key]).mapInArrow(run, schema)
    flat = rows.select(key, "paragraphs", F.posexplode("paragraphs").alias("n", "text"))
    before = F.when(F.col("n") > 0, F.get("paragraphs", F.col("n") - 1))
    what = F.when(is_heading(F.col("text")), "heading").when(is_footnote(F.col("text")), "footnote").otherwise("body")
    return flat.select(key, "n", "text", what.alias("kind"), (before.isNotNull() & ~is_heading(before)).alias("indent"))


def previous_heading(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Add `after_heading`: whether the row before, in order within the key, is a heading."""
    return df.withColumn("after_heading", F.coalesce(F.lag(is_heading(F.col(line))).over(Window.partitionBy(key).orderBy(order)), F.lit(False)))
