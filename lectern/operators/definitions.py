"""Definitional passages of a lexicon in pages.

Eight templates a term. The lexicon lives on the driver, so templates are
compiled once per worker; a page is tested only for the terms and templates that
a few scans of it for all terms at once leave. The templates run in Arrow batches: as generated Column expressions, eight per term,
plans grow with the lexicon and every page pays for every term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The templates (fixed values); `@` stands for the escaped term.
TEMPLATES = (
    r"\b@\s+(is|are|was|were|refers?\s+to|can\s+be\s+defined\s+as|means?|denotes?|signif\w*)",
    r"\bdefin\w+\s+(?:of\s+)?(?:the\s+)?(?:term\s+)?[\"']?@[\"']?",
    r"\bby\s+[\"']?@[\"']?\s*[,]?\s*(?:I\s+mean|we\s+mean|is\s+meant)",
    r"\b@\s+(?:here|in\s+this)\s+(?:refers?|means?|denotes?)",
    r"\bwhat\s+(?:is|do\w*\s+we\s+mean\s+by)\s+(?:a\s+)?[\"']?@[\"']?",
    r"\b@\s+as\s+(?:a\s+)?(?:concept|term|category|framework|practice)",
    r"\bconcept\s+of\s+(?:the\s+)?@\b",
    r"\bunderstand(?:ing)?\s+(?:of\s+)?@\s+as\b",
)
LONGEST, SHORTEST, KEY = 1000, 30, 100
_FLAGGED = "book_id string, seq int, locator int, locator_type string, term string, template int, start int, excerpt string"


@lru_cache(maxsize=4096)
def patterns(term: str) -> tuple[re.Pattern[str], ...]:
    return tuple(re.compile(t.replace("@", re.escape(term)), re.IGNORECASE) for t in TEMPLATES)


def sentence(text: str, start: int, stop: int) -> str:
    """The sentence around a match: see `functions.text.sentence_at`."""
    low = max(0, start - 500)
    first = text.rfind(".", low, start) + 1 or text.rfind("\n", low, start) + 1
    for mark in ".", "\n":
        last = text.find(mark, stop)
        if 0 <= last <= stop + 500:
            return text[first : last + 1].strip()
    return text[first : stop + 300].strip()


#: What follows the term in the templates that begin with it, by template.
_BEHIND = {i: re.compile(r"(?<=\S)(?=" + TEMPLATES[i].split("@")[1].lower() + ")") for i in (0, 3, 5)}
#: Signs that case folding in patterns treats unlike lower-casing: a text with one is matched in full.
_FOLDED = re.compile("[ſıİK]")


@lru_cache(maxsize=16)
def _any_term(terms: tuple[str, ...]) -> dict[int, re.Pattern[str]]:
    """The other templates with any of the terms in the term's place."""
    some = "(?:" + "|".join(map(re.escape, terms)) + ")"
    return {i: re.compile(t.lower().replace("@", some)) for i, t in enumerate(TEMPLATES) if i not in _BEHIND}


def _promising(lower: str, terms: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """(term, template) of all that can match a lower-cased text.

    A template that goes on behind the term is tried only for terms that end where
    such a going-on is; the others only if they match with any term at all.
    """
    ends = {i: {m.start() for m in p.finditer(lower)} for i, p in _BEHIND.items()}
    ends = {i: at for i, at in ends.items() if at}
    others = [i for i, p in _any_term(terms).items() if p.search(lower)]
    if not ends and not others:
        return
    for term in terms:
        at = lower.find(term)
        if at < 0:
            continue
        stops = set()
        while at >= 0:
            stops.add(at + len(term))
            at = lower.find(term, at + 1)
        for i in sorted([*others, *(i for i, there in ends.items() if not stops.isdisjoint(there))]):
            yield term, i


def matches(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Every match of every template with its sentence (over 30 characters, cut to 1,000), a row each. Null texts have none."""
    known = tuple(dict.fromkeys(t.lower() for t in terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for book, seq, locator, kind, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lower = text.lower()
                plain = len(lower) == len(text) and not _FOLDED.search(text)
                for term, i in _promising(lower, known) if plain else ((t, i) for t in known if t in lower for i in range(len(TEMPLATES))):
                    for m in patterns(term)[i].finditer(text):
                        excerpt = sentence(text, m.start(), m.end())
                        if len(excerpt) > SHORTEST:
                            rows.append((book, seq, locator, kind, term, i, m.start(), excerpt[:LONGEST]))
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FLAGGED.split(", ")])

    return pages.select("book_id", "seq", "locator", "locator_type", "text").where("text is not null").mapInArrow(run, _FLAGGED)


def flag(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """`book_id, term, ord, locator, locator_type, excerpt`: the matches of each book and term, without those whose first 100 characters, case ignored, came before; in page, template and text order. Re-delivered pages change nothing."""
    key = F.trim(F.lower(F.substring("excerpt", 1, KEY)))
    order = ("seq", "template", "start")
    first = Window.partitionBy("book_id", "term", key).orderBy(*order)
    once = matches(pages, terms).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return once.select("book_id", "term", (F.row_number().over(Window.partitionBy("book_id", "term").orderBy(*order)) - 1).alias("ord"), "locator", "locator_type", "excerpt")
