"""Problem 7: noise in text from scanned pages.

Words are looked up in tries of the vocabulary, forwards and backwards,
intersected with a Levenshtein automaton: letters left out, added, changed or
swapped, and scanning's own misreadings, merges and splits such as `rn` for `m`
or `1` for `l`, which cost less. The walk yields every vocabulary word within the
bound. Whether a word is misread is told by candidates that scanning's
misreadings alone explain and that are far more frequent; in a text with marks of
scanning, any edit is repaired. Candidates are ranked by cost, by the words beside
them and the words of the text, and by frequency. Then page furniture is dropped,
words broken across lines are joined if the vocabulary backs it, and lines flow
into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (as read, as printed) pairs of the misreadings (fixed values).
MISREADINGS = (
    ("c", "e"), ("f", "t"), ("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("q", "g"), ("m", "in"), ("b", "h"), ("h", "li"), ("vv", "w"), ("1", "i"), ("0", "O"), ("I", "l"),
)
#: A part of a word at a hyphen is a word of its own if it makes up this share of all words; the halves of broken words are rarer.
PART_SHARE = 1 / 200_000
#: Cost of an edit that is none of scanning's misreadings, which cost 1.
OTHER_EDIT = 3
#: A word of more uses is taken for one, whatever is near it.
OWN = 5
#: How many times as frequent a word must be to replace another, by whether scanning's misreadings explain it, and whether the text has it.
RARER, RARER_OTHER, RARER_THERE = 20, 3000, 300
_WORD = re.compile(r"[^\W_]+(?:[’'][^\W\d_]+)*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_BROKEN = re.compile(r"([^\W\d_]+)([-¬\xad])[ \t]*\n[ \t]*([^\W\d_]+)")
_CUT = re.compile(r"[^\W\d_][-¬\xad][ \t]*\n")
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE = rf"(?:\d{{1,4}}|{_ROMAN}|{_ROMAN.replace('ivxlc', 'IVXLC').replace('c{', 'C{').replace('xc|xl|l?x', 'XC|XL|L?X').replace('ix|iv|v?i', 'IX|IV|V?I')})"
_NUMBER = re.compile(rf"(?:[Pp](?:age|\.)? ?{_PAGE}|[-–—] ?{_PAGE} ?[-–—]|\[{_PAGE}\]|\({_PAGE}\)|{_PAGE})")
_GAP = re.compile(r"\s\s| \| ")
_HEADER = re.compile(rf"(?P<m>{_PAGE})\s{{2,}}(?=\S)(?P<a>[^\n]{{3,90}})|(?P<b>[^\n]{{3,90}}?\S)\s{{2,}}(?P<n>{_PAGE})|(?P<c>[^|\n]{{3,90}}?) \| (?P<o>{_PAGE})|(?P<p>{_PAGE}) \| (?P<d>[^|\n]{{3,90}})")


def word_counts(texts: DataFrame) -> DataFrame:
    """`word, n` over the column `text`, lower-cased, edges stripped. Every task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for token, n in raw.items():
                for word in _WORD.findall(token.lower()):
                    words[word] += n
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    raw.update(text.split())
            if len(raw) > 400_000:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, most: int | None = None) -> dict[str, int]:
    """All words of two or more uses with their counts, or the `most` most frequent of them.

    All of them are sent to the driver and the workers, however rare: any may be what a misreading stands for.
    """
    counts = word_counts(texts).where(F.col("n") >= 2)
    if most is not None:
        counts = counts.orderBy(F.desc("n"), "word").limit(most)
    return {r.word: r.n for r in counts.collect()}


class Lexicon:
    """The vocabulary as tries, and the automaton's walk through them."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.most = max(words.values(), default=0)
        self.root, self.back = {}, {}
        for word in words:
            if word.isalpha():
                for root, letters in ((self.root, word), (self.back, word[::-1])):
                    node = root
                    for c in letters:
                        node = node.setdefault(c, {})
                    node[""] = word
        self.edits = [(a, b) for a, b in MISREADINGS if b.islower() and (a.islower() or a.isdigit())]
        self.seen: dict[str, list[tuple[int, str]]] = {}
        self.seen_other: dict[str, list[tuple[int, str]]] = {}

    def candidates(self, word: str, bound: int) -> list[tuple[int, str]]:
        """(edits, word) of every vocabulary word that `word` may be a misreading of with at most `bound` of scanning's edits."""
        found: dict[str, int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, edits = stack.pop()
            if at == len(word):
                if "" in node and found.get(node[""], bound + 1) > edits:
                    found[node[""]] = edits
                continue
            if word[at] in node:
                stack.append((node[word[at]], at + 1, edits))
            if edits < bound:
                for read, printed in self.edits:
                    if word.startswith(read, at):
                        to = node
                        for c in printed:
                            to = to.get(c)
                            if to is None:
                                break
                        else:
                            stack.append((to, at + len(read), edits + 1))
        return sorted((e, w) for w, e in found.items() if e)

    def within(self, word: str, bound: int) -> dict[str, int]:
        """Every vocabulary word within `bound` (1 or 2) edits: a letter left out, added or changed, or two neighbours swapped; with the least number of edits.

        Of the edits, no more than half lie in the first half of the word, or no
        more than half in the second. So the forward trie is walked with as many in
        the first half, and the backward one, from the end, likewise: neither walk
        spreads near its root, where a trie is broad. A swap across the middle
        belongs to the second half of either.
        """
        found: dict[str, int] = {}
        half = len(word) // 2
        self._walk(self.root, word, half - 1, bound, found)
        self._walk(self.back, word[::-1], len(word) - half - 1, bound, found)
        return found

    @staticmethod
    def _walk(root: dict, word: str, half: int, bound: int, found: dict[str, int]) -> None:
        stack, been, end = [(root, 0, 0)], set(), len(word)
        while stack:
            node, at, edits = stack.pop()
            if (state := (id(node), at, edits)) in been:
                continue
            been.add(state)
            if at == end and "" in node and found.get(node[""], bound + 1) > edits:
                found[node[""]] = edits
            if at < end and word[at] in node:
                stack.append((node[word[at]], at + 1, edits))
            if edits < (bound // 2 if at < half else bound):
                if at < end:
                    stack.append((node, at + 1, edits + 1))
                    if at + 1 < end and word[at + 1] in node and word[at] in node[word[at + 1]]:
                        stack.append((node[word[at + 1]][word[at]], at + 2, edits + 1))
                for c, child in node.items():
                    if c:
                        stack.append((child, at, edits + 1))
                        if at < end:
                            stack.append((child, at + 1, edits + 1))

    def _may(self, word: str) -> int:
        """Bound of scanning's edits for a word; 0 if it is not the like of a word."""
        digits = sum(c.isdigit() for c in word)
        if len(word) < 3 or digits > 3 or digits * 2 > len(word):
            return 0
        return 1 if len(word) < 6 else 2 if len(word) < 12 else 3

    def misread(self, word: str) -> list[tuple[int, str]]:
        """Candidates by scanning's misreadings for a lower-case word.

        A candidate is more than `RARER` times as frequent and no misreading itself:
        the vocabulary of scanned texts holds their frequent misreadings. A short
        word of letters has neighbours by chance, so its own use counts as one.
        """
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            bound, known = self._may(word), []
            own = self.words.get(word, 0)
            if bound and own * RARER < self.most:
                digits = any(map(str.isdigit, word))
                if len(word) < 6 and not digits:
                    own = max(own, 1)
                known = [(e, w) for e, w in self.candidates(word, bound) if self.words[w] > RARER * own and (len(w) > 2 or digits) and not self.misread(w)]
            self.seen[word] = known
        return known

    def edited(self, word: str, there: set[str]) -> list[tuple[int, str]]:
        """(cost, word) of the candidates by any edits for a lower-case word, scanning's first. `there` are the words of the text."""
        best = {w: e for e, w in self.misread(word)}
        if len(word) > 4 and self.words.get(word, 0) <= OWN and self._may(word):
            other = self.seen_other.get(word)
            if other is None:
                if len(self.seen_other) > 200_000:
                    self.seen_other.clear()
                other = self.seen_other[word] = [(OTHER_EDIT * e, w) for w, e in self.within(word, 1 if len(word) < 9 else 2).items() if e]
            own = max(1, self.words.get(word, 0))
            for cost, w in other:
                if w not in best and self.words[w] > (RARER_THERE if w in there else RARER_OTHER) * own * (cost // OTHER_EDIT):
                    best[w] = cost
        return sorted((e, w) for w, e in best.items())


def furniture(lines: list[str]) -> list[int]:
    """Indices of lines that are page numbers or running headers with one, inside running text.

    Numbers are decimal or Roman. A title is told by its capitals, by a bar, by
    a small Roman number, or by standing inside a sentence: titles of documents
    and excerpts do not recur.
    """
    out = []
    full = [x.strip() for x in lines]
    for i, line in enumerate(full):
        if not line or len(line) > 110:
            continue
        number = _NUMBER.fullmatch(line)
        header = None if number or not _GAP.search(line) else _HEADER.fullmatch(line)
        if not (number or header):
            continue
        before = next((full[j] for j in range(i - 1, max(-1, i - 4), -1) if full[j]), "")
        after = next((full[j] for j in range(i + 1, min(len(full), i + 4)) if full[j]), "")
        if not (_prose(before) or _prose(after)):
            continue
        if number:
            # a letter alone may be a mark of a list, a Roman capital a section's number
            if any(c.isdigit() for c in line) or (line.islower() and len(line) > 1) or _inside(before, after):
                out.append(i)
            continue
        title = next(x for x in (header["a"], header["b"], header["c"], header["d"]) if x)
        page = next(x for x in (header["m"], header["n"], header["o"], header["p"]) if x)
        letters = [c for c in title if c.isalpha()]
        if len(letters) < 0.5 * len(title.replace(" ", "")) or title.endswith((".", ",", ";")) or "  " in title.strip() or ".." in title:
            continue
        if page.isdigit() and (header["c"] or header["d"] or sum(c.isupper() for c in letters) > 0.8 * len(letters)):
            out.append(i)
        elif letters[0].isupper() and (page.islower() and not (_HEADER.fullmatch(before) or _HEADER.fullmatch(after)) or _inside(before, after)):
            out.append(i)
    return out


def _inside(before: str, after: str) -> bool:
    """Whether a sentence goes on from the line before to the line after, both prose and no entries of a list of contents."""
    if not (_prose(before) and _prose(after)) or _HEADER.fullmatch(before) or _HEADER.fullmatch(after):
        return False
    last = before.split()[-1]
    return after[0].islower() or last.islower() and (last[-1].isalpha() or last[-1] in ",-¬\xad–—")


def _prose(line: str) -> bool:
    words = line.split()
    return len(words) >= 4 and sum(w.strip("“”\"'‘’(),.;:!?—-¬").isalpha() for w in words) >= 0.6 * len(words) and "|" not in line


class Repairer:
    """Tells and repairs the marks of scanning, one text at a time."""

    def __init__(self, words: dict[str, int]):
        self.lexicon = Lexicon(words)
        self.words = words
        self.least = PART_SHARE * sum(words.values())
        self.fine: set[str] = set()

    def broken(self, left: str, mark: str, right: str) -> bool:
        """Whether a word stands broken here, not a compound at its hyphen."""
        if mark != "-":
            return True
        a, b = left.lower(), right.lower()
        if a + b in self.words:
            return True
        return right[0].islower() and not (self._own(a) and self._own(b))

    def _own(self, part: str) -> bool:
        return self.words.get(part, 0) >= max(2.0, self.least)

    def doubtful(self, text: str, there: set[str] | None = None) -> list[str]:
        """Distinct words of a text with misreading candidates, lower-cased; with the words of the text, also those with candidates by other edits, names aside."""
        if there is not None:
            words = {x for token in set(text.split()) for x in re.split(r"[-–—/’']", _EDGE.sub("", token)) if x}
            odd = {x.lower() for x in words if (x.islower() or any(c.isdigit() for c in x)) and x.lower().isalnum()}
            return [*{x for x in odd if self.lexicon.edited(x, there)}, *self.doubtful(text)]
        tokens = set(text.split()) - self.fine
        out = []
        for token in tokens:
            bare = _EDGE.sub("", token)
            hit = False
            for part in re.split(r"[-–—/’']", bare):
                low = part.lower()
                if low and (part.islower() or part[1:].islower() or any(c.isdigit() for c in part)) and self.lexicon.misread(low):
                    out.append(low)
                    hit = True
            if not hit:
                if len(self.fine) > 400_000:
                    self.fine.clear()
                self.fine.add(token)
        return out

    def marks(self, text: str | None) -> str:
        """The kinds of marks in a text: `break`, `furniture`, `misread`."""
        if not text:
            return ""
        kinds = []
        if "\n" in text:
            if _CUT.search(text) and any(self.broken(*m.groups()) for m in _BROKEN.finditer(text)):
                kinds.append("break")
            if furniture(text.split("\n")):
                kinds.append("furniture")
            whole = _BROKEN.sub(r"\1\3", text)
        else:
            whole = text
        doubtful = self.doubtful(whole)
        if len(doubtful) > 1 or doubtful and (len(doubtful[0]) > 4 or not doubtful[0].isalpha()):  # a short rare word alone may be one
            kinds.append("misread")
        return " ".join(kinds)

    def repair(self, text: str | None) -> str | None:
        """The text as paragraphs: furniture dropped, words joined, misreadings replaced by the best candidate, lines flowed. Null stays null."""
        if not text:
            return text
        lines = text.split("\n")
        for i in reversed(furniture(lines)):
            del lines[i]
        text = "\n".join(lines)
        text = _BROKEN.sub(lambda m: m[1] + m[3] if self.broken(*m.groups()) else f"{m[1]}{m[2]}{m[3]}", text)
        there = {w.lower() for w in _WORD.findall(text)}
        doubtful = self.doubtful(text, there)
        if doubtful:
            tokens = [m[0].lower() for m in re.finditer(r"[^\W_]+", text)]
            beside = set(zip(tokens, tokens[1:], strict=False))
            at = iter(range(len(tokens)))

            def best(m: re.Match[str]) -> str:
                i = next(at)
                if tokens[i] not in doubtful:
                    return m[0]
                before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
                word = min(self.lexicon.edited(tokens[i], there), key=lambda ew: (ew[0], ((before, ew[1]) not in beside) + ((ew[1], after) not in beside), ew[1] not in there, -self.words[ew[1]]))[1]
                return word.upper() if m[0].isupper() and len(m[0]) > 1 else word.capitalize() if m[0][0].isupper() else word

            text = re.sub(r"[^\W_]+", best, text)
        return "\n\n".join(" ".join(x.strip() for x in block.split("\n") if x.strip()) if _flows(block) else block for block in re.split(r"\n[ \t]*\n+", text))


def _flows(block: str) -> bool:
    """Whether the lines of a block are wrapped prose, not a list or a table."""
    lines = [x for x in block.split("\n") if x.strip()]
    return len(lines) < 2 or sum(map(_prose, lines)) > 0.6 * len(lines) and not any("|" in x or "\t" in x or "  " in x.strip() for x in lines)


def find(texts: DataFrame, words: dict[str, int], repaired: bool = False) -> DataFrame:
    """The rows of `rec, rec_key, text` with marks of scanning, once per key: `marks`, and `repaired` if asked for.

    Null and empty texts have none. Only the marked rows leave the workers.
    """
    names = ["rec", "rec_key", "marks"] + ["text", "repaired"] * repaired

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(words)
        for batch in batches:
            rows = []
            for rec, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if marks := repairer.marks(text):
                    rows.append((rec, key, marks, text, repairer.repair(text)) if repaired else (rec, key, marks))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return texts.select("rec", "rec_key", "text").where("text is not null").mapInArrow(run, ", ".join(f"{n} string" for n in names)).dropDuplicates(["rec", "rec_key"])
