"""Problem 8: the corpus as token ids of a public byte-level BPE vocabulary.

Text is split by the vocabulary's public pattern into pre-tokens; the merges of a
pre-token run on a rank queue: one bucket of list positions per merge rank, and
over the buckets a three-level bitmap whose find-first-set names the lowest rank
that waits. Merging links the neighbours of a position anew; entries whose pair
has changed are stale and skipped when they come up. The work per merge does not
depend on the length of the pre-token, so a pre-token of a million characters
costs in proportion to its length, not to its square.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies of the public tokenizers lie; a parameter of every operator.
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text before the merges (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker remembers per cache before it starts afresh; bounds its memory, not the result.
CACHE = 150_000
_WORD_BITS = 6


class RankQueue:
    """A queue of list positions by small integer rank.

    A rank's bucket holds its positions. `levels[0]` has a bit for every rank,
    `levels[k+1]` a bit for every non-zero word of `levels[k]`; the last is one word.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        size = ranks
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * max(1, size))
            if size <= 1:
                return

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        at = rank
        for level in self.levels:
            word = at >> 6
            old = level[word]
            level[word] = old | 1 << (at & 63)
            if old:
                return
            at = word

    def take(self) -> tuple[int, list[int]] | None:
        """Remove the bucket of the lowest rank; its positions from left to right. None if nothing waits."""
        if not self.buckets:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) + (word & -word).bit_length() - 1
        rank = at
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def _differs(code: int) -> bool:
    """Whether `re` and the pattern's \\p classes see this code point differently."""
    c = chr(code)
    kind = unicodedata.category(c)
    word = c.isalnum() or c == "_"
    space = c.isspace() != (kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85")
    return space or kind in ("Nl", "No") or (word and c != "_") != (kind[0] == "L" or kind == "Nd")


@lru_cache(maxsize=1)
def _splitters():
    """(findall of the exact pattern, findall of its quick form, finder of characters only the exact one gets right)."""
    import regex

    codes = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and _differs(i)]
    spans, start = [], None
    for here, after in zip(codes, [*codes[1:], -1], strict=True):
        start = here if start is None else start
        if after != here + 1:
            spans.append(f"\\U{start:08x}-\\U{here:08x}")
            start = None
    quick = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    return regex.compile(PATTERN).findall, re.compile(quick).findall, re.compile("[" + "".join(spans) + "]").search


class _Cache:
    """Ids by piece of text, filled as pieces come up; forgets all beyond `CACHE` entries, keeps no long ones."""

    def __init__(self, compute):
        self.compute, self.known = compute, {}

    def one(self, text: str) -> tuple[int, ...]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.compute(text)
            if len(text) <= 48:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def all(self, texts: list[str]) -> list[tuple[int, ...]]:
        out = list(map(self.known.get, texts))  # a plain dict's get: the quickest way over known pieces
        return out if all(out) else [x or self.one(y) for x, y in zip(out, texts, strict=True)]


#: Chunks that no pre-token crosses, in a text where blanks and line feeds stand alone.
_CHUNKS = re.compile(r" ?[^ \n]+|\n+").findall
#: Whitespace that may join its neighbours to a longer pre-token.
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


class ByteBpe:
    """Encodes text with a rank file. Special tokens are never produced."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.pieces = _Cache(lambda text: self.merge(text.encode()))
        self.chunks = _Cache(self._chunk)
        self.exact, self.quick, self.odd = _splitters()

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        n = len(data)
        piece = [data[i : i + 1] for i in range(n)]
        piece.append(b"")
        after, before = list(range(1, n + 2)), list(range(-1, n))
        rank_of, queue = ranks.get, self.queue
        pair = [rank_of(data[i : i + 2], -1) for i in range(n - 1)] + [-1, -1]
        waiting: dict[int, list[int]] = {}
        for i, rank in enumerate(pair):
            if rank >= 0:
                waiting.setdefault(rank, []).append(i)
        for rank, positions in waiting.items():
            queue.open(rank, positions)
        push = queue.push
        while (lowest := queue.take()) is not None:
            rank, positions = lowest
            for at, i in enumerate(positions):
                if pair[i] != rank:  # stale: the pair at i has changed or gone
                    continue
                j = after[i]
                k = after[i] = after[j]
                h = before[i]
                before[k] = i
                merged = piece[i] = piece[i] + piece[j]
                piece[j] = b""
                pair[j] = -1
                best = rank
                new = pair[i] = rank_of(merged + piece[k], -1) if k < n else -1
                if new >= 0:
                    push(new, i)
                    best = new if new < best else best
                if h >= 0:
                    new = pair[h] = rank_of(piece[h] + merged, -1)
                    if new >= 0:
                        push(new, h)
                        best = new if new < best else best
                if best < rank and at + 1 < len(positions):  # a lower rank has come up: the rest waits
                    queue.open(rank, positions[at + 1 :])
                    break
        return tuple(ranks[p] for p in piece if p)

    def _split(self, text: str) -> list[str]:
        return self.exact(text) if self.odd(text) else self.quick(text)

    def _chunk(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.pieces.all(self._split(text))))

    def lists(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of a text, in tuples; none for an empty or null one.

        Where every blank and run of line feeds stands between other characters,
        pre-tokens end before them, whatever follows: the text is cut there, and
        the chunks, mostly words, are remembered. (Of line feeds before another
        character the last is a pre-token of its own; a run that ends the text is
        one.) Other texts are split as a whole.
        """
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE(text):
            return self.pieces.all(self._split(text))
        body = text.rstrip("\n")
        found = _CHUNKS(body)
        if "\n\n" in body:
            found = [y for x in found for y in ((x[:-1], "\n") if x[0] == "\n" and len(x) > 1 else (x,))]
        out = self.chunks.all(found)
        if len(body) < len(text):
            out.append(self.pieces.one(text[len(body) :]))
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        return list(chain.from_iterable(self.lists(text)))


@lru_cache(maxsize=4)
def load(vocabulary: str, tokenizers: str) -> ByteBpe:
    """The encoder of a rank file, once per worker."""
    return ByteBpe(os.path.join(tokenizers, f"{vocabulary}.tiktoken"))


def token_ids(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """Add `out`, the list of token ids of column `text`, to the other columns of `df`.

    Null and empty texts give the empty list; a column already called `out` is
    replaced; texts of any length are encoded whole. Narrow: no shuffle.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*keep).withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, tokenizers)
        for batch in batches:
            parts = [bpe.lists(t) for t in batch.column(len(keep)).to_pylist()]
            ends = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([sum(map(len, x)) for x in parts], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(parts)), dtype=np.int32, count=int(ends[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], lists], names=[*keep, out])

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """Add `out`, the number of tokens of column `text` (0 for null and empty), dropping the text itself."""
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, tokenizers)
        for batch in batches:
            sizes = pa.array([sum(map(len, bpe.lists(t))) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], sizes], names=[*keep, out])

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)
