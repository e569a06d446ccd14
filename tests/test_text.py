import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import definitions


def test_slug(column):
    assert column(text.slug, ["What's the Use?: On the Uses of Use", "  ǂA_b  C--d ", "", None, "É" * 90]) == ["whats-the-use-on-the-uses-of-use", "a-b-c-d", "", None, "é" * 80]


def test_word_count(column):
    assert column(text.word_count, ["a b c\n", " ", "", None]) == [3, 0, 0, 0]


def test_headings(column):
    lines = ["5 From #Ferguson", "Introduction", "DATA AND POWER", "A sentence.", "", None, "x" * 101, "introduction to a b c d e f g", "AB", "ÄÖ", "Table of Contents"]
    expected = [True, True, True, False, False, False, False, False, False, False, True]
    assert column(text.is_heading, lines) == expected
    assert [text.heading_line(x) for x in lines if x is not None] == [e for x, e in zip(lines, expected, strict=True) if x is not None]


def test_front_matter(column):
    page = "Copyright 2001\nAll rights reserved\nPrinted in X\nA line that is long enough"
    assert column(text.is_front_matter, [page, None, "a\nb", "One two three\nFour five six\nSeven eight nine"]) == [True, True, True, False]


def test_html(column):
    html = "<!DOCTYPE html><style>p{}</style><p>Fish &amp; <b>chips</b></p><!-- <i>no</i> --><script>'</p>'</script><p> a &lt;b&gt; <br>"
    assert column(text.html_to_text, [html, "", None, "no tags"]) == ["Fish &\nchips\na <b>", "", None, "no tags"]


def test_highlight_takes_the_query_literally(column):
    assert column(lambda c: text.highlight(c, "a.b"), ["xA.By acb", None]) == ["x<mark>A.B</mark>y acb", None]
    assert column(lambda c: text.highlight(c, ["100%", r"q\E"]), [r"100% of q\E"]) == [r"<mark>100%</mark> of <mark>q\E</mark>"]
    assert column(lambda c: text.highlight(c, []), ["x"]) == ["x"]


def test_snippet_is_clamped(column):
    cut = lambda c: F.concat_ws("|", text.snippet(c, text.find(c, "mid"), 3, 2), text.offset_in_snippet(text.find(c, "mid"), 2))
    assert column(cut, ["mid end", "a mid", "xxxx mid yyyy"]) == ["mid e|0", "a mid|2", "x mid y|2"]


def test_coinage(column):
    assert column(lambda c: text.coinage(c)[0], ["Capta — data as taken", "No dash", " — x"]) == ["Capta", "No dash", " — x"]
    assert column(lambda c: text.coinage(c)[1], ["Capta — data as taken", "No dash", " — x"]) == [" — data as taken", None, None]


def test_term_parts_and_head(column):
    assert column(text.term_parts, ["Visibility / Invisibility", "ab", "Text"]) == [["visibility", "invisibility"], [], ["text"]]
    assert column(text.term_head, ["Visibility / Invisibility", "Text"]) == ["visibility", "text"]


def test_json_part(column):
    assert column(lambda c: text.json_part(c, "array<int>"), ["x [1, 2] y", "none", "[1] and [2", None]) == [[1, 2], None, [1], None]
    assert column(lambda c: text.json_part(c, "a int", array=False)["a"], ['so {"a": 3}.', "{broken"]) == [3, None]


TEXTS = [
    "A. Text is data. B",
    "x" * 600 + " text is " + "y" * 700,
    "Line one\ntext means a thing without end",
    "text is. Text was what text denotes here, and text are.",
    "é😀 text is “this”. And more",
    "",
    "text isolates the case. " * 3,
]


def test_occurrences_and_sentences_match_a_plain_reading(column):
    pattern = definitions.TEMPLATES[0].replace("@", "text")
    native = column(lambda c: text.occurrences(c, "(?iuU)" + pattern), TEXTS)
    plain = [[(m.start(), m.end()) for m in re.finditer(pattern, t, re.IGNORECASE)] for t in TEXTS]
    assert [[tuple(x) for x in row] for row in native] == plain
    sentences = column(lambda c: F.transform(text.occurrences(c, "(?iuU)" + pattern), lambda m: text.sentence_at(c, m["start"], m["stop"])), TEXTS)
    assert sentences == [[definitions.sentence(t, a, b) for a, b in row] for t, row in zip(TEXTS, plain, strict=True)]


def test_sentence_boundaries():
    assert definitions.sentence("A. Text is data. B", 3, 10) == "Text is data."
    far = "x" * 600 + " text is " + "y" * 700
    assert definitions.sentence(far, 601, 608) == far[:908]
    near, over = ("text is" + "z" * n + "." for n in (500, 501))
    assert definitions.sentence(near, 0, 7) == near
    assert definitions.sentence(over, 0, 7) == over[:307]


def test_paragraph_modes():
    assert text.split_paragraphs("One\ntwo\n\nINTRODUCTION\nthree") == ["One two", "INTRODUCTION", "three"]
    first = "This line is long enough to be the end of a paragraph."
    assert text.split_paragraphs(first + "\nAnother begins here with a capital letter and goes on.") == [first, "Another begins here with a capital letter and goes on."]
    assert text.split_paragraphs("a line that goes on without a stop\nand then on") == ["a line that goes on without a stop and then on"]
    assert text.split_paragraphs("One two. " * 70)[0] == ("One two. " * 4).strip()
    assert text.split_paragraphs(None) == text.split_paragraphs("") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.A \n", max_size=80))
def test_paragraphs_keep_every_word_of_short_texts(t):
    assert " ".join(text.split_paragraphs(t)).split() == t.split()


@pytest.mark.parametrize("i,hit", list(enumerate(["text is", "defining the term “x”", "by text, we mean", "text in this refers", "what do we mean by a text", "text as a category", "concept of the text", "understanding of text as"])))
def test_every_template(i, hit):
    hit = hit.replace("“x”", '"text"')
    m = definitions.patterns("text")[i].search(f"so {hit} and")
    assert m and m.start() == 3


def test_all_references_are_resolved(column):
    import html

    values = ["caf&eacute;", "&#8217;&#x2019;&#X41;", "a &amp;lt; b", "&copy 2020 &copycat;", "AT&T & co &", "&#128; &#150;", "&#0; &#xD800;", "&NotEqualTilde;&nbsp;x", "&unknown; &;", "plain", "&notit; &amp", "100% &mdash;"]
    assert column(text.unescape, values) == [html.unescape(v) for v in values]
    assert column(text.html_to_text, ["<p title='a > b' data-x=\"</p>\">one &eacute;</p><br/>two &lt;p&gt;", None]) == ["one \u00e9\ntwo <p>", None]
