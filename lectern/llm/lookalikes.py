"""Problem 3: text that looks the same but differs in its characters.

Strings and code points that look alike are joined by union-find into classes:
compatibility forms of width and joined letters, canonical equivalents, blanks
of any kind, characters without a glyph, letters of other alphabets with the
shape of a Latin one. Relations are transitive, so a wide Cyrillic look-alike
would land where its Latin shape is. A class is written by its most frequent
member in the corpus; members that only stand for others by their nature
(detached accents, empty glyphs) never represent it. Texts are rewritten from
left to right by the longest match of an automaton over all other members.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.encoding import Mender

#: Characters without a glyph of their own (fixed values).
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁪⁫⁬⁭⁮⁯﻿"
#: Blanks other than the plain one, line ends and tabs aside (fixed values).
BLANKS = "               　"
#: Letters of other alphabets with the shape of a Latin letter (fixed values): Cyrillic, Greek, Armenian, Cherokee.
SHAPES = dict(
    zip(
        "аеорсухіјѕһԁԛԝгпАВЕКМНОРСТУХІЈЅԌԚԜ" + "οανικρτυχγωηΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "օսհոցՕՍՏ" + "ᎪᎬᎻᎫᏦᎷᏢᎡᎢᎳᏃ",
        "aeopcyxijshdqwrnABEKMHOPCTYXIJSGQW" + "oavikptuxywnABEZHIKMNOPTYX" + "ouhngOUS" + "AEHJKMPRTWZ",
        strict=True,
    )
)
_MARK = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
_WIDE = "！-～￠-￦"
_LIGATURE = "ﬀ-ﬆ"
_FOREIGN = "Ͱ-ϿЀ-ԯ\u0530-\u058f\u13a0-\u13ff"
_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ" + _LIGATURE + "Ａ-Ｚａ-ｚ"
_MIXED = f"(?<=[{_LATIN}])[{_FOREIGN}]|[{_FOREIGN}](?=[{_LATIN}])"
#: What a text must match (Java and Python) to hold anything but representatives.
TRIGGER = f"(?![\\x00-\\x7f])(?:[{_MARK}{_WIDE}{_LIGATURE}{BLANKS}{INVISIBLE}]|{_MIXED})"
_RUN = re.compile(f"[{_LATIN}{_FOREIGN}{_MARK}{INVISIBLE}]+")
_HAS_LATIN, _HAS_FOREIGN = re.compile(f"[{_LATIN}]").search, re.compile(f"[{_FOREIGN}]").search


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = self.parent.setdefault(x, x)
        while root != self.parent[root]:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def groups(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in self.parent:
            out[self.find(x)].append(x)
        return [sorted(g) for g in out.values()]


def inventory(texts: DataFrame) -> DataFrame:
    """`part, n`: how often every code point, and every letter with detached marks, occurs in all texts.

    Every task sums its own texts, so a task sends on one row per distinct part;
    there are as many parts at most as Unicode has characters, and sequences of
    a character with up to three marks.
    """
    marked = re.compile(f"[^{_MARK}\\s][{_MARK}]{{1,3}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.zeros(0x110000, dtype=np.int64)
        strings: Counter[str] = Counter()
        for batch in batches:
            text = "\n".join(t for t in batch.column(0).to_pylist() if t)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            few = np.bincount(codes[codes < 0x10000], minlength=0x10000)
            points[:0x10000] += few
            far = codes[codes >= 0x10000]
            if len(far):
                np.add.at(points, far, 1)
            if few[0x300:0x370].any():
                strings.update(marked.findall(text))
        found = np.nonzero(points)[0]
        parts = [chr(i) for i in found if not 0xD800 <= i < 0xE000]
        counts = [int(points[i]) for i in found if not 0xD800 <= i < 0xE000]
        yield pa.RecordBatch.from_arrays([pa.array(parts + list(strings), pa.string()), pa.array(counts + list(strings.values()), pa.int64())], names=["part", "n"])

    return texts.select("text").where("text is not null").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def rewriting(counts: dict[str, int]) -> tuple[dict[str, str], dict[str, str]]:
    """(replacement of each member that is not its class's representative, the same for members that only count inside a Latin word).

    The most frequent member represents its class, whatever its form; letters that a
    ligature joins are as frequent as the rarest of them. Among equals
    it is one in normal form, then the first in code point order. Letters of other
    alphabets count as members inside Latin words only and never represent; what
    has no glyph is dropped.
    """
    classes = Classes()
    foreign = set()
    for part in counts:
        if len(part) > 1:
            whole = unicodedata.normalize("NFC", part)
            if whole != part:
                classes.join(part, whole)
            continue
        if part in INVISIBLE:
            classes.join(part, "")
        elif part in BLANKS:
            classes.join(part, " ")
        elif unicodedata.decomposition(part).startswith(("<wide>", "<narrow>", "<font>")) or "ﬀ" <= part <= "ﬆ":
            classes.join(part, unicodedata.normalize("NFKC", part))
        elif part in SHAPES:
            foreign.add(part)
            classes.join(part, SHAPES[part])
    always, inside = {}, {}
    for group in classes.groups():
        own = [x for x in group if x not in foreign and x not in INVISIBLE]
        often = lambda x: counts[x] if x in counts else min((counts.get(c, 0) for c in x), default=0) if unicodedata.normalize("NFD", x) == x else 0
        stable = lambda x: len(x) == 1 and unicodedata.normalize("NFKC", x) == x
        best = "" if "" in group else max(own, key=lambda x: (often(x), stable(x), [-ord(c) for c in x]))
        for x in group:
            if x != best:
                (inside if x in foreign else always)[x] = best
    return always, inside


def trigger(always: dict[str, str]) -> str:
    """A pattern (Java's and Python's) that every text matches which rewriting may change."""
    more = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({x[0] for x in always if len(x) == 1 and x != ""}))
    return f"{TRIGGER}|[{more}]" if more else TRIGGER


class Rewriter:
    """Rewrites texts to representatives; `changes` tells whether a text holds other members."""

    def __init__(self, always: dict[str, str], inside: dict[str, str]):
        import ahocorasick

        self.inside = str.maketrans(inside)
        self.automaton = ahocorasick.Automaton()
        for member, best in always.items():
            self.automaton.add_word(member, (len(member), best))
        if always:
            self.automaton.make_automaton()
        self.empty = not always
        self.single = set(always)
        self.trigger = re.compile(TRIGGER).search
        #: Marks that are left over are composed unless the corpus prefers them detached.
        self.compose = not any(re.search(f"[{_MARK}]", best) for best in always.values())

    def rewrite(self, text: str | None) -> str | None:
        """The text in representatives. Null and empty texts stay. Wholly foreign words keep their letters."""
        if not text or not (self.trigger(text) or not self.single.isdisjoint(text)):
            return text
        if not self.empty:
            out, at = [], 0
            for end, (size, best) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - size], best)
                at = end + 1
            text = "".join(out) + text[at:]
        text = unicodedata.normalize("NFC", text) if self.compose and re.search(f"[{_MARK}]", text) else text
        return _RUN.sub(lambda m: m[0].translate(self.inside) if _HAS_LATIN(m[0]) and _HAS_FOREIGN(m[0]) else m[0], text)


def rewriter(texts: Iterator[DataFrame] | list[DataFrame]) -> tuple[dict[str, str], dict[str, str]]:
    """The replacements for a corpus, from the inventory of all its texts.

    What comes to the driver is bounded by the characters there are, not by the
    texts.
    """
    whole = reduce(DataFrame.unionByName, [t.select("text") for t in texts])
    needed = F.col("part").rlike(f"^.[{_MARK}]") | (F.length("part") == 1)
    return rewriting({r.part: r.n for r in inventory(whole).where(needed).collect()})


def _may(always: dict[str, str]) -> Column:
    """Whether rewriting may change `text`. Where all other members lie beyond ASCII, so does what changes."""
    if any(x.isascii() for x in always):
        return F.coalesce(F.col("text").rlike(trigger(always)), F.lit(False))
    return F.coalesce((F.octet_length("text") != F.length("text")) & F.col("text").rlike(f"(?![\\x00-\\x7f])(?:{trigger(always)})"), F.lit(False))


def find(texts: DataFrame, replacements: tuple[dict[str, str], dict[str, str]], words: dict[str, list[str]]) -> DataFrame:
    """The rows of `rec, rec_key, text` that hold members of a class other than its representative, once per key, with `rewritten`.

    These are the rows that rewriting changes, so the corpus decides which form
    is the look-alike. Null and empty texts and texts that were wrongly decoded
    (problem 1, told by its dictionaries `words`) are none. Only rows that match
    the trigger of the replacements reach Python.
    """
    schema = "rec string, rec_key string, text string, rewritten string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender, writer = Mender(words), Rewriter(*replacements)
        for batch in batches:
            rows = []
            for rec, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                new = writer.rewrite(text)
                if new != text and not mender.mend(text)[0]:
                    rows.append((rec, key, text, new))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["rec", "rec_key", "text", "rewritten"])

    return texts.select("rec", "rec_key", "text").where(_may(replacements[0])).mapInArrow(run, schema).dropDuplicates(["rec", "rec_key"])


def rewrite(texts: DataFrame, replacements: tuple[dict[str, str], dict[str, str]]) -> DataFrame:
    """Every row of `rec, rec_key, text` once per key, its text in representatives; null texts stay null. Rows without look-alikes never leave the JVM for it."""
    once = texts.select("rec", "rec_key", "text")
    may = _may(replacements[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Rewriter(*replacements)
        for batch in batches:
            new = pa.array([writer.rewrite(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), new], names=["rec", "rec_key", "text"])

    changed = once.where(may).mapInArrow(run, "rec string, rec_key string, text string")
    return once.where(~may).unionByName(changed).dropDuplicates(["rec", "rec_key"])
