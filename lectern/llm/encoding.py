"""Problem 1: text that was decoded with the wrong character encoding.

A damaged text is the image of a good one under a chain of encodings: written in
one, read in another, once or several times. Candidate texts are made by undoing
such chains on the words that hold non-ASCII characters. Candidates and the text
itself are compressed with a zstandard dictionary of each language; the shortest
description, the cost of the chain included, wins. Otherwise the text stays.

The dictionaries are the most frequent well-formed non-ASCII words of the
documents, counted over all of them by language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm._util import norm_lang

#: Non-ASCII letters of each language, lower case (fixed values).
ALPHABETS = {"en": "éèêëïîôöüäàâçñãœ", "fr": "àâæçéèêëîïôœùûüÿ", "de": "äöüß", "es": "áéíñóúü", "pt": "áàâãçéêíóôõú"}
#: Words of one accented letter, by language (fixed values).
SINGLES = {"en": "", "fr": "àÀ", "de": "", "es": "", "pt": "àéÀÉ"}
#: Encodings that UTF-8 text gets read in, and pairs (read in, written in) of one byte a character (fixed values).
MISREAD_UTF8 = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
SWAPPED = (("latin_1", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"))
#: What a chain costs, in bytes of compressed text.
UTF8_COST, SWAP_COST = 2, 1
#: Words of a language's dictionary at most, so what is sent to the workers is bounded: five languages of a few ten thousand bytes.
DICTIONARY_WORDS = 3000

_OPEN, _CLOSE = "“‘«„(\"'—–¿¡", "”’»“‘,.;:!?)\"'…—–"
#: What UTF-8 sequences may decode to: letters and signs that two characters may stand for by chance only seldom, two letters of other alphabets, and whatever takes three bytes or more.
_PLAUSIBLE = re.compile("(?:[\x80-\x9f -ÿŒœŠšŽžŸ̀-ͯͰ-ӿ -⁯€™…　ﬀ-ﬆ️﻿＀-～]|[\u0590-\u07ff]{2,}|[\u0900-\u1fff\u2c00-\ud7ff\uf900-\uffef\U0001d400-\U0003ffff])+")


def _assigned(text: str) -> bool:
    return all(unicodedata.category(c) != "Cn" for c in text)


_CONTROL = re.compile("[\x80-\x9f]")


@lru_cache
def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """(byte of each character, character of each byte from 0x80).

    Undefined bytes stand for the control of that number, and controls from 0x80
    for their byte in any encoding, as readers mix them.
    """
    chars = []
    for b in range(0x80, 0x100):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {chr(b): b for b in range(0x80, 0xA0)} | {c: 0x80 + i for i, c in enumerate(chars)}, chars


def _class(chars: Iterable[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars))) + "]"


@lru_cache
def _sequences(codec: str) -> re.Pattern[str]:
    """Runs of characters whose bytes in `codec` have the shape of UTF-8."""
    codes = _table(codec)[0]
    part = lambda a, b: _class(c for c, code in codes.items() if a <= code <= b)
    tail = part(0x80, 0xBF)
    return re.compile(f"(?:{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}{tail}|{part(0xF0, 0xF4)}{tail}{tail}{tail})+")


def undo_utf8(word: str, codec: str) -> str:
    """Read the UTF-8 sequences in a word that was read in `codec` as what they are; the rest stays."""

    def read(m: re.Match[str]) -> str:
        codes = _table(codec)[0]
        try:
            good = bytes(codes[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]
        return good if _PLAUSIBLE.fullmatch(good) and _assigned(good) else m[0]

    return _sequences(codec).sub(read, word)


def undo_swap(word: str, read_in: str, written_in: str) -> str:
    """The word as written, if every non-ASCII character of it exists in `read_in`; else the word itself."""
    codes, chars = _table(read_in)[0], _table(written_in)[1]
    try:
        good = "".join(c if c < "\x80" else chars[codes[c] - 0x80] for c in word)
    except KeyError:
        return word
    return word if _CONTROL.search(good) else good


def suspicion() -> str:
    """A pattern (Java's and Python's) of the signs of a wrong decoding: characters that the languages at hand hardly use, lead and tail of UTF-8 sequences side by side, capitals and lone letters where none belong."""
    pairs = []
    for codec in MISREAD_UTF8:
        of = _table(codec)[1]
        leads = [of[b - 0x80] for b in (*range(0xC2, 0xC6), *range(0xCC, 0xD2), 0xE2, 0xE3, 0xEF)]
        pairs.append(_class(leads) + _class(of[:0x40]))
        pairs.append(f"{_class(of[0x56:0x60])}{_class(of[:0x40])}{_class(of[0x56:0x60])}{_class(of[:0x40])}")
        pairs.append(f"{_class(of[0x60:0x75])}{_class(of[:0x40])}{{2}}")
    letters = "".join(ALPHABETS.values())
    upper = "".join(c for c in letters.upper() if ord(c) > 127) + "ÒÌÞÅÈÙÛ"
    usual = letters + letters.upper() + "“”‘’„‚«»‹›—–…¿¡·•°§ ­·¬ -‏ -  -⁤　̀-ͯͰ-ӿﬀ-ﬆ﻿＀-～"
    odd = "[^\\x00-\\x7f" + "".join(c if c in "-" else f"\\u{ord(c):04x}" for c in usual) + "]"
    cased = (
        f"(?<=[a-z]){_class(upper)}|(?:^|(?<=\\s)){_class('ìíîñóòôöõùûüæäÆ')}(?=\\s|[A-Z]|$)"
        f"|(?<=[,.!?]){_class('íîñóòôöõùûüæäÆ')}(?=\\s|$)|(?<=\\w){_class('·¬„‚‹›‘')}(?=\\w)"
    )
    return "(?![\\x00-\\x7f])(?:" + "|".join(["[\\u0080-\\u009f\\ufffd]", odd, *pairs, cased]) + ")"


def well_formed(lang: str) -> str:
    """A pattern (Java's) of words that belong in a language's dictionary."""
    low = "a-z" + ALPHABETS[lang]
    up = "A-Z" + "".join(c for c in ALPHABETS[lang].upper() if len(c) == 1 and ord(c) > 127)
    word = f"(?:[{up}]?[{low}]+|[{up}]+|[a-z]+[’'])"
    lone = f"(?![{re.escape(_OPEN)}]*[^a-zA-Z{SINGLES[lang]}—–«»“”„‘’¿¡][{re.escape(_CLOSE)}]*$)"
    quote = re.escape(_OPEN), re.escape(_CLOSE)
    return f"^(?:{lone}[{quote[0]}]*{word}(?:[’'-]{word})*[{quote[1]}]*|[{quote[0]}{quote[1]}]+)$"


def dictionary_words(documents: DataFrame, per_language: int = DICTIONARY_WORDS) -> DataFrame:
    """`lang, word, n`: the most frequent well-formed words with non-ASCII characters of each known language, over all documents."""
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: F.octet_length(w) != F.length(w))
    counts = documents.select(norm_lang(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(*ALPHABETS)).select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    good = F.lit(False)
    for lang in ALPHABETS:
        good = F.when(F.col("lang") == lang, F.col("word").rlike(well_formed(lang))).otherwise(good)
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.where(good).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_language).drop("r")


def dictionaries(documents: DataFrame, per_language: int = DICTIONARY_WORDS) -> dict[str, list[str]]:
    """The dictionary words by language, the rarest first. Bounded by `per_language` times the languages."""
    out: dict[str, list[str]] = {lang: [] for lang in ALPHABETS}
    for lang, word, n in sorted(dictionary_words(documents, per_language).collect(), key=lambda r: (r.n, r.word)):
        out[lang].append(word)
    return out


class Mender:
    """Finds and undoes wrong decodings, one text at a time."""

    def __init__(self, words: dict[str, list[str]]):
        import zstandard

        self.known = {_bare(w) for ws in words.values() for w in ws}
        self.compressors = []
        for ws in [*words.values(), [w for ws in words.values() for w in ws]]:
            data = (" " + " ".join(ws) + " ").encode("utf-16-le")
            if ws:
                params = zstandard.ZstdCompressionParameters.from_level(9, source_size=1024, dict_size=len(data), write_checksum=False, write_content_size=False, write_dict_id=False)
                self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
        if not self.compressors:
            self.compressors.append(zstandard.ZstdCompressor(level=9))
        self.suspicious = re.compile(suspicion()).search
        self.seen: dict[str, bool] = {}

    def length(self, words: list[str]) -> int:
        """Bytes of the shortest description of the words over the languages, with a byte for each word no dictionary has."""
        data = (" " + " ".join(words) + " ").encode("utf-16-le", "surrogatepass")
        return min(len(c.compress(data)) for c in self.compressors) + sum(not self._knows(w) for w in words)

    def _knows(self, word: str) -> bool:
        bare = _bare(word)
        return bare.isascii() or bare in self.known

    def _candidates(self, words: list[str], depth: int = 3) -> Iterator[tuple[int, str, list[str]]]:
        """(cost, chain, words) of every chain that changes some word."""
        for read_in, written_in in SWAPPED:
            new = [undo_swap(w, read_in, written_in) for w in words]
            if new != words:
                yield SWAP_COST, f"{written_in}>{read_in}", new
        todo = [("", 0, words)]
        while todo:
            chain, cost, old = todo.pop()
            for codec in MISREAD_UTF8:
                new = [undo_utf8(w, codec) for w in old]
                if new != old:
                    name = f"utf-8>{codec}" + (f">{chain}" if chain else "")
                    yield cost + UTF8_COST, name, new
                    if cost + UTF8_COST < depth * UTF8_COST:
                        todo.append((name, cost + UTF8_COST, new))

    def mend(self, text: str | None) -> tuple[bool, str | None, str]:
        """(whether any part was wrongly decoded, the text with what could be restored, the chains undone).

        U+FFFD and control characters from 0x80 prove damage that may be beyond
        repair. Null texts are not damaged.
        """
        if text is None or text.isascii() or not self.suspicious(text):
            return False, text, ""
        undone, out = [], text
        while True:  # every round shortens the description
            words = list(dict.fromkeys(w for w in re.split(r"[ \t\n\r]+", out) if not w.isascii()))
            best = None
            for cost, chain, new in self._candidates(words):
                pairs = [(a, b) for a, b in zip(words, new, strict=True) if a != b and self._better(a, b, chain)]
                if not pairs:
                    continue
                gain = self.length([a for a, _ in pairs]) - self.length([b for _, b in pairs]) - cost
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, chain, dict(pairs)
            if best is None:
                break
            undone.append(best[1])
            out = "".join(best[2].get(w, w) for w in re.split(r"([ \t\n\r]+)", out))
        damaged = bool(undone) or "�" in text or _CONTROL.search(text) is not None
        return damaged, out, " ".join(undone)

    def _better(self, old: str, new: str, chain: str) -> bool:
        """Whether a word may change: not a known one, nor into one with more controls."""
        if chain.startswith("utf-8"):
            return len(_CONTROL.findall(new)) <= len(_CONTROL.findall(old))
        return not self._knows(old)


def _bare(word: str) -> str:
    return word.strip(_OPEN + _CLOSE) or word


def mend(texts: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """The damaged rows of `rec, rec_key, text`, once per key: with `restored` (as far as possible), `chain` and `lossy`.

    `lossy` tells that characters were lost. Only rows with suspicious characters
    reach Python; a record that comes again with the same key is one.
    """
    schema = "rec string, rec_key string, text string, restored string, chain string, lossy boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = Mender(words)
        for batch in batches:
            rows = []
            for rec, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                damaged, restored, chain = mender.mend(text)
                if damaged:
                    rows.append((rec, key, text, restored, chain, "�" in restored))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rec", "rec_key", "text", "restored", "chain", "lossy"])

    return texts.select("rec", "rec_key", "text").where(suspect(F.col("text"))).mapInArrow(run, schema).dropDuplicates(["rec", "rec_key"])


def suspect(text: Column) -> Column:
    """Whether a text may be damaged: a cheap test for the signs that undoing a chain takes away."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(suspicion())


def find(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """`mend` with dictionaries from the documents."""
    return mend(texts, dictionaries(documents))


