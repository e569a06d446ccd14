"""Prompt contexts for a text completion, and answers from it.

The completion is a callable given by the caller; nothing here opens a
connection. Answers are kept by key, and only keys without one are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import json_part

ARGUMENTS = 'Read this sample of "{title}" by {author} ({year}) and name three to five arguments it makes, as a JSON array of objects with "summary" and "elaboration".\n\n{context}'
SYNTHESIS = 'Compare how these passages define their terms. Answer with a JSON object of "text_synthesis", "technology_synthesis" and "comparative".\n\n{context}'

GLOSSARY_ENTRY = 'Write an entry for the term "{term}" from these passages. Answer with a JSON object of "definition", "usage_notes" and "related_terms".\n\n{context}'
FRAMEWORK_SUMMARY = 'Say how the framework "{framework}" is used in these passages and by whom. Books: {books}. Answer with a JSON object of "summary", "key_concepts" and "key_scholars".\n\n{context}'


def book_sample(pages: DataFrame, n_pages: int = 20, size: int = 15000) -> DataFrame:
    """`book_id, context`: the first pages of a book, joined by blank lines and cut. Pages beyond the first are dropped before they are shuffled together."""
    once = pages.where("text is not null").select("book_id", "seq", "page_id", F.substring("text", 1, size).alias("text"))
    rank = Window.partitionBy("book_id").orderBy("seq", "page_id")
    first = once.dropDuplicates(["page_id"]).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= n_pages)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "\n\n")
    return first.groupBy("book_id").agg(F.substring(joined, 1, size).alias("context"))


def passage_line(author: Column, title: Column, locator: Column, excerpt: Column) -> Column:
    return F.concat(author, F.lit(', "'), title, F.lit('" (p.'), F.coalesce(locator.cast("string"), F.lit("")), F.lit('): "'), excerpt, F.lit('"'))


def term_context(compared: DataFrame, definitions: DataFrame, n: int = 15) -> DataFrame:
    """`term, context`: the first `n` passages of each term as lines."""
    lines = compared.where(F.col("position") <= n).join(definitions.select("def_id", "excerpt"), "def_id").select("term", "position", passage_line(F.col("author"), F.col("title"), F.col("locator"), F.col("excerpt")).alias("line"))
    return lines.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda p: p["line"]), "\n").alias("context"))


def _quoted(passages: DataFrame, key: str, n: int) -> DataFrame:
    """`key, context`: the first `n` passages of each key, by `position`, as blocks parted by blank lines."""
    line = F.concat(F.lit('From "'), F.col("title"), F.lit('" by '), F.col("author"), F.lit(': "'), F.col("excerpt"), F.lit('"'))
    lines = passages.where(F.col("position") <= n).select(key, "position", line.alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda p: p["line"]), "\n\n").alias("context"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with `{name}` replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(parts)])


def glossary_prompts(passages: DataFrame, n: int = 10) -> DataFrame:
    """`key, prompt` for a glossary entry of each term, from its first `n` passages (`term, position, title, author, excerpt`); the key is `glossary-` and the term. Answers that hold no JSON object stand as the definition."""
    return _quoted(passages, "term", n).select(F.concat(F.lit("glossary-"), "term").alias("key"), _filled(GLOSSARY_ENTRY, {"term": F.col("term"), "context": F.col("context")}).alias("prompt"))


def framework_prompts(passages: DataFrame, n: int = 10) -> DataFrame:
    """`key, prompt` for a summary of each framework, from its first `n` passages (`framework, position, title, author, excerpt`) and the titles of all its books, by title; the key is `framework-` and the framework."""
    titles = passages.groupBy("framework").agg(F.array_join(F.sort_array(F.collect_set("title")), ", ").alias("books"))
    filled = _filled(FRAMEWORK_SUMMARY, {"framework": F.col("framework"), "context": F.col("context"), "books": F.col("books")})
    return _quoted(passages, "framework", n).join(titles, "framework").select(F.concat(F.lit("framework-"), "framework").alias("key"), filled.alias("prompt"))


def unanswered(prompts: DataFrame, cache: DataFrame, schema: str, array: bool = True) -> DataFrame:
    """`key, prompt` rows whose key has no cached answer that parses."""
    good = cache.where(json_part(F.col("value"), schema, array).isNotNull()).select("key")
    return prompts.join(good, "key", "left_anti")


def complete(prompts: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """`key, value`: answers to `key, prompt`; a call that fails gives a null."""

    def one(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "value": [one(p) for p in batch["prompt"]]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, value string")


def answers(completed: DataFrame, schema: str, array: bool = True) -> DataFrame:
    """`key, answer`: the bracketed JSON in each completion, null where there is none."""
    return completed.select("key", json_part(F.col("value"), schema, array).alias("answer"))
