"""Problem 5: per-document text quality statistics and outliers among them.

The statistics are made in one pass over the texts, next to the test for residue
(problem 10). Common words are each language's most frequent ones, counted over
all documents. Every statistic is ranked exactly within the language: distinct
values are counted first, sorted over ranges of (language, statistic, value), and
a value's rank is its prefix sum in its range plus the offset of the range. Ranks
give the share of distinct texts at or beyond a value on either side. A document's
outlier score adds the surprise (-ln) of these tail shares, weighted by what the
labelled documents say of each kind of junk, and the score decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm._util import cut, norm_lang, ranged_prefix
from lectern.llm.residue import kind_of

#: The statistics that are ranked.
STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "digit_ratio", "distinct_share", "words_per_line", "continued_lines")
#: A language's common words are so many of its most frequent.
COMMON_WORDS = 60
#: Languages of fewer documents are pooled.
LEAST_DOCUMENTS = 100
#: Weights are fitted on so many labelled documents at most, the first by hash, and not on fewer than the least.
MOST_LABELS, LEAST_LABELS = 20_000, 60
#: A value that this share of a language's texts has is joined apart: there are no more than its inverse of them for a statistic.
HEAVY = 1 / 500
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SYMBOLS = re.compile(r"[^\w\s̀-ͯ]|_")
_ENDS = re.compile(r"[.!?…:;][\"”’»)\]]*\s*$").search


def _bare(token: str) -> str:
    return _EDGES.sub("", token.lower())


class _Known(dict):
    """Tokens and their lower-case words, as far as they are remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        word = self[token] = _bare(token)
        return word


def language(lang: Column) -> Column:
    """The language's code of two or three letters, else `und`: there are no more than so many."""
    code = norm_lang(lang)
    return F.when(F.length(code).between(2, 3), code).otherwise("und")


def pooled(documents: DataFrame, lang: str = "lang", least: int = LEAST_DOCUMENTS) -> list[str]:
    """The languages with documents of their own; the others are `und`."""
    return sorted(r[0] for r in documents.groupBy(language(F.col(lang)).alias("l")).count().where(F.col("count") >= least).select("l").collect())


def _own(lang: str, own: list[str]) -> Column:
    code = language(F.col(lang))
    return F.when(code.isin(own), code).otherwise("und") if own else F.lit("und")


def common_words(documents: DataFrame, own: list[str], text: str = "text", lang: str = "lang", most: int = COMMON_WORDS) -> dict[str, frozenset[str]]:
    """The most frequent words of each language over all its documents; of `und`, those of all.

    Every task adds up its own words first. The ranks are taken in two steps, by
    hash of the word and then among the first of each, so that no language is one
    task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = {}

        def out() -> pa.RecordBatch:
            rows = [(code, word, n) for code, tokens in held.items() for word, n in _added(tokens).items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["l", "word", "n"])

        for batch in batches:
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(code, Counter()).update(t.split())
            if sum(map(len, held.values())) > 400_000:
                yield out()
        yield out()

    def _added(tokens: Counter[str]) -> Counter[str]:
        words: Counter[str] = Counter()
        for token, n in tokens.items():
            words[_bare(token)] += n
        return words

    counts = documents.where(F.col(text).isNotNull()).select(_own(lang, own).alias("l"), F.col(text).alias("t")).mapInArrow(run, "l string, word string, n long").where("word <> ''").groupBy("l", "word").agg(F.sum("n").alias("n"))
    by = [F.desc("n"), F.asc("word")]
    part = counts.withColumn("_r", F.row_number().over(Window.partitionBy("l", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(*by))).where(F.col("_r") <= most)
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy("l").orderBy(*by))).where(F.col("_r") <= most)
    found: dict[str, set[str]] = {}
    for r in first.select("l", "word").collect():
        found.setdefault(r.l, set()).add(r.word)
    found["und"] = set().union(*found.values()) if found else set()
    return {k: frozenset(v) for k, v in found.items()}


def measure(text: str | None, common: frozenset[str], known: dict[str, str]) -> tuple[float, ...]:
    """The statistics of one text in the order of `STATISTICS`; see `statistics`."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    solid = sum(map(len, words))
    low = [known[w] for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        float(n),
        solid / n,
        (len(text) - len(_SYMBOLS.sub("", text))) / solid,
        sum(1 for x in lines if _ENDS(x)) / len(lines),
        sum(map(common.__contains__, low)) / n,
        sum(map(text.count, "0123456789")) / solid,
        len(set(low)) / n,
        n / len(lines),
        sum(1 for x in lines if x.lstrip()[0].islower()) / len(lines),
    )


def statistics(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`doc_id, lang_norm, residue, text_hash` and the statistics of every document, a row per row of `documents`.

    n_words: runs of non-blanks; mean_word_length: their mean length; symbol_ratio:
    share of non-blank characters that are no letters, marks or digits;
    punctuated_lines: share of non-blank lines whose last character but quotes and
    brackets ends a sentence; common_share: share of words that are common in the
    language (of any language where it is unknown or has few documents);
    digit_ratio: share of non-blank characters that are digits; distinct_share:
    share of distinct words; words_per_line; continued_lines: share of non-blank
    lines that begin with a small letter. Null, empty and blank texts have 0 words
    and 0 throughout. `residue` as problem 10 classifies the text. Other columns
    are left out.
    """
    own = pooled(documents, lang)
    common = common_words(documents, own, text, lang)
    names = ["doc_id", "lang_norm", "text_hash", "residue", *STATISTICS]
    base = documents.select("doc_id", _own(lang, own).alias("lang_norm"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            rows = [measure(t, common.get(code, common["und"]), known) for t, code in zip(texts, batch.column(1).to_pylist(), strict=True)]
            kinds = pa.array([kind_of(t) for t in texts], pa.string())
            columns = np.array(rows).reshape(len(texts), len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), kinds, *map(pa.array, columns)], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(run, f"doc_id {kind}, lang_norm string, text_hash long, residue string, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumn("n_words", F.col("n_words").cast("int"))


def _long(stats: DataFrame, *keep: str) -> DataFrame:
    return stats.where("n_words > 0").select(*keep, "lang_norm", F.explode(F.create_map(*[x for s in STATISTICS for x in (F.lit(s), F.col(s).cast("double"))])).alias("stat", "value"))


def ranks(stats: DataFrame) -> DataFrame:
    """`lang_norm, stat, value, left, right, share`: the shares of the language's distinct texts with at most and at least the value, and with it, for every value there is.

    Texts without words are left out; copies of a text count once, so a frequent
    text is no less of an outlier. Equal values are counted before they are
    sorted, so a value that many texts share is one row. `und`, which pools small
    languages, is ranked among the texts of all.
    """
    once = stats.dropDuplicates(["lang_norm", "text_hash"])
    own = _long(once).groupBy("lang_norm", "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = own.where("lang_norm <> 'und'").unionByName(own.groupBy("stat", "value").agg(F.sum("n").alias("n")).withColumn("lang_norm", F.lit("und")))
    ranked = ranged_prefix(counts, ["lang_norm", "stat"], ["value"], "n", "before")
    totals = ranked.groupBy("lang_norm", "stat").agg(F.sum("n").alias("total"))
    tails = ranked.join(F.broadcast(totals), ["lang_norm", "stat"])  # a row per language and statistic
    return tails.select("lang_norm", "stat", "value", ((F.col("before") + F.col("n")) / F.col("total")).alias("left"), ((F.col("total") - F.col("before")) / F.col("total")).alias("right"), (F.col("n") / F.col("total")).alias("share"))


def surprises(stats: DataFrame) -> DataFrame:
    """`doc_id` and for every statistic `low_...` and `high_...`: -ln of the shares of texts at or below, and at or above, the document's value.

    Values that many texts have are few and are joined as a small table; the rest
    is joined by value.
    """
    tails = cut(ranks(stats))
    long = _long(stats, "doc_id")
    key = ["lang_norm", "stat", "value"]
    heavy = F.broadcast(tails.where(F.col("share") >= HEAVY).select(*key, F.col("left").alias("l"), F.col("right").alias("r")))
    marked = long.join(heavy, key, "left")
    light = marked.where("l is null").drop("l", "r").join(tails.where(F.col("share") < HEAVY).select(*key, F.col("left").alias("l"), F.col("right").alias("r")).hint("merge"), key)
    both = marked.where("l is not null").select("doc_id", "stat", "l", "r").unionByName(light.select("doc_id", "stat", "l", "r"))
    sums = [F.sum(F.when(F.col("stat") == s, -F.log(c))).alias(f"{name}_{s}") for s in STATISTICS for name, c in (("low", F.col("l")), ("high", F.col("r")))]
    return both.groupBy("doc_id").agg(*sums)


def fit(features: np.ndarray, target: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression with squared penalty, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    least = np.full(x.shape[1], penalty)
    least[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(least), x.T @ (p - target) + least * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weights(surprises_: DataFrame, labels: DataFrame, penalty: float = 1.0) -> list[list[float]]:
    """Weights of the surprises for each kind that is labelled, against prose.

    Fitted on at most `MOST_LABELS` labelled documents. Without `LEAST_LABELS` of
    them, or without prose or another kind, there is one set of weights that adds
    up what is unusual of junk: few common words, many signs and digits, lines
    without ends; its threshold is then a mean tail share of one in a hundred.
    """
    columns = [f"{side}_{s}" for s in STATISTICS for side in ("low", "high")]
    sample = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id")).limit(MOST_LABELS)
    rows = surprises_.join(F.broadcast(sample), "doc_id").select("label", *columns).collect()
    kinds = np.array([r[0] for r in rows], dtype=object)
    others = sorted(set(kinds) - {"prose"})
    if len(rows) < LEAST_LABELS or "prose" not in kinds or not others:
        signs = {"low_common_share", "high_symbol_ratio", "high_digit_ratio", "low_punctuated_lines"}
        return [[float(c in signs) for c in columns] + [-len(signs) * float(np.log(100))]]
    x = np.array([r[1:] for r in rows], dtype=float)
    return [fit(x[some], (kinds[some] == k).astype(float), penalty).tolist() for k in others for some in [(kinds == k) | (kinds == "prose")]]


def scores(surprises_: DataFrame, weights_: list[list[float]]) -> DataFrame:
    """`doc_id, score`: the largest weighted sum of surprises over the kinds; log odds of being that kind and not prose."""
    columns = [F.col(f"{side}_{s}") for s in STATISTICS for side in ("low", "high")]
    sums = []
    for w in weights_:
        total = F.lit(w[-1])
        for c, x in zip(columns, w[:-1], strict=True):
            total = total + c * F.lit(x)
        sums.append(total)
    return surprises_.select("doc_id", (F.greatest(*sums) if len(sums) > 1 else sums[0]).alias("score"))


def not_prose(documents: DataFrame, labels: DataFrame, least_score: float = 0.0) -> DataFrame:
    """`doc_id` of the documents that are lists, tables or junk: an outlier score above `least_score`.

    The score decides alone: at 0 a document is as likely one of them as prose. It
    comes from tail shares among distinct texts, so a text does not escape by
    being frequent, nor a language by being small. Null, empty and blank texts and
    residue (problem 10) are none; repeated rows of a document count once.
    """
    stats = cut(statistics(documents).where("residue is null and n_words > 0").dropDuplicates(["doc_id"]))
    found = cut(surprises(stats))
    return scores(found, weights(found, labels)).where(F.col("score") > least_score).select("doc_id")
