"""The stateless definition flagger over a stream of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lectern.operators.definitions import matches


def page_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def flagged(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Matches with sentences from a stream of pages; narrow, so any output mode but complete will do."""
    return matches(pages, terms)


def run(pages: DataFrame, terms: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append the matches to Parquet until what is there has been read."""
    return flagged(pages, terms).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
