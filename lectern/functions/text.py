"""Text functions as Column expressions. Positions and lengths count code points."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind at either end (fixed pattern).
_ENDS = r"(?U)^\s+|\s+$"
#: What opens a heading (fixed values).
HEADING_WORDS = "Acknowledgments?|Contents|Table of Contents|Introduction|Conclusion|Preface|Prologue|Epilogue|Afterword|Foreword|Bibliography|References|Notes|Appendix|Glossary|Index|Abstract|Summary|Dedication|Epigraph|Chapter|Part|Section"
#: Marks of front matter (fixed values).
FRONT_MATTER = (
    "isbn", "copyright", "all rights reserved", "library of congress", "cataloging.in.publication", "printed in", "typeset", r"press\.", r"\d{3}-\d{1,5}-\d{1,7}-\d{1,7}-\d{1}",
    r"^\s*\d{1,2}\s+\d{1,2}\s+\d{1,2}\s+\d{1,2}", "published by", "first (edition|printing|published)", "cover design", "jacket", "manufactured",
)
#: Where the main text of a book begins (fixed pattern).
INTRODUCTION = r"(?im)^(Introduction|Chapter\s+1|Part\s+(One|1|I)\b|1\s+[A-Z])"


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, _ENDS, "")


def quote(literal: str) -> str:
    """A Java pattern that matches the literal."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def words(c: Column) -> Column:
    """Maximal runs of non-blanks; none for a blank text, null for a null one."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words; 0 for null and blank texts."""
    return F.coalesce(F.size(words(F.coalesce(c, F.lit("")))), F.lit(0))


def slug(c: Column, size: int = 80) -> Column:
    """Lower-case words joined by single hyphens, at most `size` characters."""
    s = strip(F.lower(c))
    s = F.regexp_replace(s, r"(?U)ǂ|[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(s, "^-|-$", ""), 1, size)


def truncate(c: Column, size: int, ellipsis: str = "...") -> Column:
    """The text, or its first `size` characters and the ellipsis if it is longer."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(ellipsis))).otherwise(c)


def find(c: Column, needle: str, ignore_case: bool = True) -> Column:
    """0-based position of the first occurrence, -1 if there is none; an empty needle is at 0."""
    return (F.instr(F.lower(c), needle.lower()) if ignore_case else F.instr(c, needle)) - 1


def snippet(c: Column, at: Column, size: int, around: int = 80) -> Column:
    """The text from `around` characters before position `at` (0-based) to `around` after `at + size`."""
    start = F.greatest(at - around, F.lit(0))
    return c.substr(start + 1, at + size + around - start)


def offset_in_snippet(at: Column, around: int = 80) -> Column:
    """Where position `at` lies in its snippet."""
    return at - F.greatest(at - around, F.lit(0))


def highlight(c: Column, terms: str | Sequence[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of the terms, case ignored, between marks; text unchanged if there are no terms."""
    some = [t for t in ([terms] if isinstance(terms, str) else terms) if t]
    if not some:
        return c
    return F.regexp_replace(c, "(?iu)(" + "|".join(map(quote, some)) + ")", f"{before}$1{after}")


def term_head(c: Column) -> Column:
    """A glossary term up to its first `/`, lower-cased."""
    return F.regexp_replace(F.lower(c), r"(?s)\s*/.*", "")


def term_parts(c: Column, least: int = 3) -> Column:
    """The parts of a glossary term between `/`, lower-cased, of at least `least` characters."""
    return F.filter(F.transform(F.split(c, "/"), lambda x: F.lower(strip(x))), lambda x: F.length(x) >= least)


def is_heading(c: Column) -> Column:
    """Whether a line is a heading: short, no closing `.`, `,` or `;`, and numbered, opened by a heading word, or in capitals."""
    t = strip(c)
    n = F.size(F.split(t, r"(?U)\s+"))
    fits = (t != "") & (F.length(t) <= 100) & ~t.rlike(r"[.,;]$") & (n <= 12)
    numbered = t.rlike(r"^\d+\s+[A-Z]") & (F.length(t) < 80)
    named = t.rlike(rf"(?i)^({HEADING_WORDS})\b") & (n <= 8)
    capitals = (t == F.upper(t)) & t.rlike("[A-Z]") & (F.length(t) > 2) & (F.length(t) < 60) & (n <= 6)
    return F.coalesce(fits & (numbered | named | capitals), F.lit(False))


def is_footnote(c: Column) -> Column:
    """Whether a line opens with a footnote's number."""
    return F.coalesce(c.rlike(r"^\d{1,3}\.\s"), F.lit(False))


def is_front_matter(c: Column) -> Column:
    """Whether a page is front matter: null, fewer than three lines, or mostly short and imprint lines."""
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    meta = F.filter(F.transform(lines, strip), lambda x: (F.length(x) < 5) | x.rlike("(?i)" + "|".join(FRONT_MATTER)))
    return F.coalesce((F.size(lines) < 3) | (F.size(meta) / F.size(lines) > 0.5), F.lit(True))


def opens_main_text(c: Column) -> Column:
    """Whether one of the first 200 characters' lines opens an introduction or first chapter."""
    return F.coalesce(F.substring(strip(c), 1, 200).rlike(INTRODUCTION), F.lit(False))


#: Markup: comments, declarations, scripts and styles with what they hold, and tags, whose attributes may hold `>` in quotes.
_MARKUP = r"""(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>|<[a-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-z/!?][^>]*>"""


def _character(number: Column) -> Column:
    """The character of a code point; those from 128 to 159 stand for what windows-1252 has there, and what is none for U+FFFD."""
    known = {i: bytes([i]).decode("cp1252", "replace") for i in range(128, 160)}
    odd = reduce(lambda other, i: F.when(number == i, F.lit(known[i])).otherwise(other), [i for i in known if known[i] != "\ufffd"], F.lit(None).cast("string"))
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.coalesce(odd, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))


def unescape(c: Column) -> Column:
    """The text with the references of HTML resolved: all named ones of the standard, and decimal and hexadecimal ones. What is no reference stays as it is.

    Each piece behind an `&` is looked at once, so what a reference yields is not read again.
    """
    names = F.create_map(*[F.lit(x) for name, char in html5.items() if name.endswith(";") for x in (name[:-1], char)])
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)  # those that need no semicolon

    def piece(x: Column) -> Column:
        code = F.regexp_extract(x, r"^#([0-9]{1,8});?", 1)
        hexed = F.regexp_extract(x, r"^#[xX]([0-9a-fA-F]{1,7});?", 1)
        name = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        short = F.regexp_extract(x, "^(" + "|".join(bare) + ")", 1)
        long = F.when(name != "", names[name])
        return (
            F.when(code != "", F.concat(_character(code.cast("long")), F.regexp_replace(x, r"^#[0-9]{1,8};?", "")))
            .when(hexed != "", F.concat(_character(F.conv(hexed, 16, 10).cast("long")), F.regexp_replace(x, r"^#[xX][0-9a-fA-F]{1,7};?", "")))
            .when(long.isNotNull(), F.concat(long, x.substr(F.length(name) + 2, F.length(x))))
            .when(short != "", F.concat(names[short], x.substr(F.length(short) + 1, F.length(x))))
            .otherwise(F.concat(F.lit("&"), x))
        )

    parts = F.split(c, "&", -1)
    resolved = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))
    return F.when(F.contains(c, F.lit("&")), resolved).otherwise(c)


def html_to_text(c: Column) -> Column:
    """The visible text nodes of HTML, stripped, without blank ones, joined by line feeds; references resolved."""
    gap = "\x00"
    nodes = F.split(F.regexp_replace(c, _MARKUP, gap), gap)
    return F.array_join(F.filter(F.transform(F.filter(nodes, lambda x: F.trim(x) != ""), lambda x: strip(unescape(x))), lambda x: x != ""), "\n")


def json_part(c: Column, schema: str, array: bool = True) -> Column:
    """The widest bracketed part of a text, parsed; null if there is none or it does not parse."""
    pattern = r"(?s)\[.*\]" if array else r"(?s)\{.*\}"
    found = F.regexp_extract(c, pattern, 0)
    return F.when(found != "", F.from_json(found, schema))


def coinage(c: Column) -> tuple[Column, Column]:
    """(term, description with its dash) of `term — description`; the whole text and null if there is no dash after the first character."""
    at = F.instr(c, " — ")
    return F.when(at > 1, c.substr(F.lit(1), at - 1)).otherwise(c), F.when(at > 1, c.substr(at, F.length(c)))


def occurrences(c: Column, pattern: str) -> Column:
    """All matches of a Java pattern as array of (start, stop), 0-based, left to right, from the gaps between them.

    The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.split(c, pattern, -1)
    step = lambda state, x: F.struct(
        (state["at"] + x["gap"] + x["size"]).alias("at"), F.concat(state["out"], F.array(F.struct((state["at"] + x["gap"]).alias("start"), (state["at"] + x["gap"] + x["size"]).alias("stop")))).alias("out")
    )
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    return F.aggregate(pairs, start, step, lambda state: state["out"])


def sentence_at(c: Column, start: Column, stop: Column, reach: int = 500, rest: int = 300) -> Column:
    """The sentence around [start, stop): from behind the last `.` (else line feed) within `reach` before it, else from the text's start, to the next `.` (else line feed) within `reach`, else `rest` further."""
    low = F.greatest(start - reach, F.lit(0))
    before = c.substr(low + 1, start - low)

    def behind(mark: str) -> Column:
        back = F.instr(F.reverse(before), mark)
        return F.when(back > 0, low + F.length(before) - back + 1).otherwise(0)

    first = F.when(behind(".") > 0, behind(".")).otherwise(behind("\n"))

    def ahead(mark: str) -> Column:
        return F.call_function("locate", F.lit(mark), c, stop + 1) - 1

    near = lambda at: (at >= 0) & (at - stop <= reach)
    last = F.when(near(ahead(".")), ahead(".") + 1).when(near(ahead("\n")), ahead("\n") + 1).otherwise(F.least(F.length(c), stop + rest))
    return strip(c.substr(first + 1, last - first))


def split_paragraphs(text: str | None, sentences: int = 4) -> list[str]:
    """Paragraphs of a page. Blank lines part them if there are any, else lines are joined by their look; see README. Headings stand alone. Null has none."""
    if not text:
        return []
    out: list[str] = []
    if re.search(r"\n\s*\n", text):
        for block in re.split(r"\n\s*\n", text):
            held: list[str] = []
            for line in filter(None, map(str.strip, block.split("\n"))):
                if heading_line(line):
                    out += [" ".join(held)] * bool(held) + [line]
                    held = []
                else:
                    held.append(line)
            out += [" ".join(held)] * bool(held)
    else:
        current = ""
        for line in map(str.strip, text.split("\n")):
            if not line or heading_line(line):
                out += [current] * bool(current) + [line] * bool(line)
                current = ""
            elif not current or _opens(current, line):
                out += [current] * bool(current)
                current = line
            else:
                current += " " + line
        out += [current] * bool(current)
    if len(out) <= 1 and len(text) > 500:
        found = re.findall(r"[^.!?]+[.!?]+\s*", re.sub(r"\n+", " ", text)) or [text]
        out = ["".join(found[i : i + sentences]).strip() for i in range(0, len(found), sentences)]
    return out


def _opens(current: str, line: str) -> bool:
    """Whether a line opens a paragraph after `current`."""
    ended, short = current[-1] in ".!?:;\")”", len(line) < 40
    if line[0].islower() and line[0].isascii() or line[0] in ",;" or (not ended and not short):
        return False
    return ended and (line[0].isascii() and line[0].isupper() or line[0] in "“\"(") and len(current) >= 40


def heading_line(line: str) -> bool:
    """`is_heading` for one Python string."""
    t = line.strip()
    n = len(t.split())
    if not t or len(t) > 100 or t[-1] in ".,;" or n > 12:
        return False
    if re.match(r"\d+\s+[A-Z]", t) and len(t) < 80:
        return True
    if n <= 8 and re.match(rf"(?:{HEADING_WORDS})\b", t, re.IGNORECASE):
        return True
    return t == t.upper() and bool(re.search("[A-Z]", t)) and 2 < len(t) < 60 and n <= 6
