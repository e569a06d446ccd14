import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalogue, definitions, graph, paragraphs, prompts, search, views
from lectern.sources import containers, sinks, tables

PAGES = "page_id long, book_id string, seq int, locator int, locator_type string, text string"
BOOKS = "id string, title string, author array<string>, year int, format string"
DEFS = "def_id string, book_id string, term string, ord int, locator int, excerpt string"


@pytest.fixture
def library(spark):
    books = spark.createDataFrame([("a", "Zed", ["Ann Lee"], 2001, "pdf"), ("b", "Apple", [], None, "epub"), ("c", "élan", ["Bo Ray", "Cy Day"], 1999, "pdf")], BOOKS)
    pages = spark.createDataFrame(
        [(1, "a", 0, 1, "page", "Front."), (2, "a", 1, 2, "page", "Introduction\nrace and database, 100% sure"), (2, "a", 1, 2, "page", "Introduction\nrace and database, 100% sure"), (3, "a", 2, 3, "page", None), (4, "b", 0, 1, "section", "data race"), (5, "c", 0, 1, "page", "")], PAGES
    )
    return books, pages


def test_search_is_literal_and_counts_repeats_once(library):
    books, pages = library
    hit = search.search(books, pages, "100%").collect()
    assert [(r.book_id, r.position, r.excerpt[r.match_index : r.match_index + 4]) for r in hit] == [("a", 1, "100%")]
    words = search.search(books, pages, "data race", exact=False).collect()
    assert [(r.book_id, r.match_index) for r in words] == [("b", 0), ("a", 22)]
    assert search.search(books, pages, "  ").count() == 0
    assert search.search(books, pages, "a", limit=1).collect()[0].capped


def test_main_text_and_in_book(library):
    _, pages = library
    assert {r.seq for r in search.main_text(pages).where("book_id = 'a'").collect()} == {1, 2}
    got = search.in_book(pages, "RACE").collect()
    assert {(r.book_id, r.seq, r.n_found) for r in got} == {("a", 1, 1), ("b", 0, 1)}


def test_contents(spark, library):
    _, pages = library
    toc = spark.createDataFrame([("a", 0, "2 Race and Database", 2, 0), ("a", 1, "Nowhere", 9, 0), ("a", 2, "None", None, 1)], "book_id string, ord int, title string, section int, level int")
    assert [(r.ord, r.first_seq) for r in search.open_contents(toc, pages).collect()] == [(0, 1)]
    assert [(r.ord, r.seq) for r in search.goto(toc, pages).collect()] == [(0, 1)]


def test_catalogue(library):
    books, pages = library
    by = lambda k, c=None: [r.id for r in catalogue.ordered(books, k, c).orderBy("position").collect()]
    assert by("title") == ["b", "a", "c"] and by("title", "UNICODE") == ["b", "c", "a"]
    assert by("year") == ["a", "c", "b"] and by("author") == ["b", "a", "c"]
    assert [r.id for r in catalogue.matching(books, "lee").collect()] == ["a"] and catalogue.matching(books, "%").count() == 0
    assert [r.id for r in catalogue.matching(books, "", "epub").collect()] == ["b"]
    stats = {r.book_id: r for r in catalogue.statistics(pages).collect()}
    assert (stats["a"].word_count, stats["a"].page_count, stats["a"].blank_pages) == (7, 2, 1) and stats["c"].scanned
    files = books.sparkSession.createDataFrame([("a.png",), ("a.jpg",), ("b.png",)], "name string")
    assert {r.id: r.cover for r in catalogue.covers(books, files).collect()} == {"a": "a.jpg", "b": "b.png", "c": None}


def test_flagging_against_a_plain_loop(spark):
    texts = ["Here text is a thing that people make and read. More.", "HERE text is a thing that people make and read. Other.", "By text we mean what a reader holds in hand today. The concept of the text: none at all but this.", None, "Text is x."]
    pages = spark.createDataFrame([(i, "b", i, i + 1, "page", t) for i, t in enumerate(texts)], PAGES)
    got = [(r.ord, r.locator, r.excerpt) for r in definitions.flag(pages, ["Text"]).orderBy("ord").collect()]
    seen, expected = set(), []
    for n, t in enumerate(texts):
        for template in definitions.TEMPLATES:
            for m in re.finditer(template.replace("@", "text"), t or "", re.IGNORECASE):
                e = definitions.sentence(t, m.start(), m.end())
                if len(e) > 30 and e[:100].lower().strip() not in seen:
                    seen.add(e[:100].lower().strip())
                    expected.append((len(expected), n + 1, e[:1000]))
    assert got == expected and len(got) == 3


def test_views(spark, library):
    books, _ = library
    defs = spark.createDataFrame([("d1", "a", "text", 0, 1, "Same start " * 12), ("d2", "a", "text", 1, 2, "Same start " * 12 + "x"), ("d3", "b", "code", 0, None, "A Text about critical matters"), ("d4", "c", "text", 0, 1, "other")], DEFS).withColumn("locator_type", F.lit("page"))
    glossary = spark.createDataFrame([("t", "Text / Script", "")], "id string, term string, definition string")
    assert {r.def_id for r in views.glossary_passages(glossary, defs, books).collect()} == {"d3"}
    threads, terms = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", 0, "text"), ("x", 1, "code")], "thread_id string, ord int, term string")
    assert {(r.book_id, r.n, r.def_id) for r in views.thread_passages(terms, defs, books).collect()} == {("a", 1, "d1"), ("b", 1, "d3"), ("c", 1, "d4")}
    assert {(r.thread_id, r.n_passages, r.n_books) for r in views.thread_counts(threads, terms, defs).collect()} == {("x", 4, 3), ("y", 0, 0)}
    curated = spark.createDataFrame([("y", 0, "lost", "q"), ("y", 1, "a", "q")], "thread_id string, ord int, book_id string, excerpt string")
    assert {(r.title, r.author) for r in views.curated_passages(curated, books).collect()} == {("lost", ""), ("Zed", "Ann Lee")}
    assert {(r.thread_id, r.n_passages) for r in views.thread_counts(threads, terms, defs, curated).collect()} == {("x", 4), ("y", 2)}
    m = views.framework_match(["critical data studies", "a of"], books, defs, ["code"])
    assert [(r.framework, r.book_id) for r in m.collect()] == [("critical data studies", "b")]
    assert views.framework_match(["of"], books, defs, ["code"]).count() == 0
    assert views.shuffled(books, "id", 1).orderBy("position").select("id").collect() == views.shuffled(books.repartition(7), "id", 1).orderBy("position").select("id").collect()


def test_graph(spark):
    books = spark.createDataFrame([("a", "A", ["Ann Lee"]), ("b", "B", ["Bo Ray"]), ("z", "Z", [])], "id string, title string, author array<string>")
    cites = spark.createDataFrame([("a", "Ann Lee"), ("a", "Xu Li"), ("b", "ann lee"), ("b", "Xu Li"), ("missing", "Xu Li")], "book_id string, scholar string")
    own = spark.createDataFrame([("ann lee", "a"), ("xu li", "missing")], "scholar_lower string, book_id string")
    nodes = {r.id: r for r in graph.nodes(cites, books, own).collect()}
    assert set(nodes) == {"a", "b", "scholar-xu-li"} and nodes["scholar-xu-li"].radius == 20 and nodes["a"].n == 2 and nodes["a"].colour == "scholarIn"
    edges = {(r.source, r.target, r.type) for r in graph.edges(cites, books, own).collect()}
    assert edges == {("b", "a", "cites_author"), ("a", "scholar-xu-li", "cites"), ("b", "scholar-xu-li", "cites")}
    ends = {e for s, t, _ in edges for e in (s, t)}
    assert ends <= set(nodes)
    assert graph.neighbours(graph.edges(cites, books, own)).where("id = 'a'").count() == 2
    members = spark.createDataFrame([("k", "a"), ("k", "b"), ("one", "z")], "cluster string, id string")
    at = spark.createDataFrame([("a", 0.0, 1.0), ("b", 10.0, 5.0), ("z", 1.0, 1.0)], "id string, x double, y double")
    assert [tuple(r) for r in graph.cluster_boxes(members, at).collect()] == [("k", 2, -60.0, -59.0, 70.0, 65.0)]
    assert graph.search_nodes(graph.nodes(cites, books, own), " ").count() == 0


def test_prompts(spark, library):
    _, pages = library
    sample = {r.book_id: r.context for r in prompts.book_sample(pages, n_pages=2, size=12).collect()}
    assert sample["a"] == "Front.\n\nIntr" and sample["b"] == "data race"
    todo = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "boom")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "[1]"), ("k2", "broken")], "key string, value string")
    assert {r.key for r in prompts.unanswered(todo, cache, "array<int>").collect()} == {"k2", "k3"}

    def ask(prompt):
        if prompt == "boom":
            raise RuntimeError
        return f"so: [{prompt[1:]}]"

    got = {r.key: r.answer for r in prompts.answers(prompts.complete(todo, ask), "array<int>").collect()}
    assert got == {"k1": [1], "k2": [2], "k3": None}


def test_paragraph_rows(spark):
    pages = spark.createDataFrame([(1, "INTRODUCTION\nBody here.\n\n1. A note"), (1, "INTRODUCTION\nBody here.\n\n1. A note"), (2, None)], "page_id long, text string")
    rows = paragraphs.paragraphs(pages).orderBy("page_id", "n").collect()
    assert [(r.kind, r.indent) for r in rows] == [("heading", False), ("body", False), ("footnote", True)]


def epub() -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A B</dc:creator><dc:date>2001, 1999</dc:date></metadata><manifest><item id="1" href="c1.xhtml"/><item id="2" href="c2.xhtml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("OEBPS/c1.xhtml", "<p>" + "x" * 50 + "</p>")
        z.writestr("OEBPS/c2.xhtml", "<p>" + "y" * 51 + "</p>")
        z.writestr("OEBPS/t.ncx", '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c2.xhtml#a"/><navPoint><navLabel><text>Two</text></navLabel><content src="x.xhtml"/></navPoint></navPoint></navMap></ncx>')
    return data.getvalue()


def archive(members: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return data.getvalue()


def test_containers(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.zip").write_bytes(archive({"b/p10.txt": "eleven char", "b/p2.txt": "second page", "b/p3.txt": "ten charac", "notes.txt": "no number here"}))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.doc").write_bytes(b"")
    (tmp_path / "e.zip").write_bytes(b"broken")
    found = containers.extract(containers.list_files(spark, str(tmp_path))).cache()
    s = containers.sections(found)
    assert [(r.file, r.locator, r.text[:1]) for r in s.orderBy("file", "seq").collect()] == [("a.epub", 1, "y"), ("b.zip", 2, "s"), ("b.zip", 10, "e")]
    assert [(r.title, r.section, r.level) for r in containers.contents(found, s).orderBy("ord").collect()] == [("One", 1, 0), ("Two", None, 1)]
    book = found.where("kind = 'book' and file = 'a.epub'").first()
    assert (book.title, book.author, book.year) == ("T", ["A B"], 1999)
    assert {r.file for r in containers.errors(found).collect()} == {"c.pdf", "e.zip"}
    blank = containers.with_ocr(lambda d: ["", " ", "", "", "", "kept"], lambda d, i: f"ocr {i}" if i < 3 else 1 / 0)
    got = containers.extract(containers.list_files(spark, str(tmp_path)), {".pdf": blank}).where("file = 'c.pdf' and kind = 'part'")
    assert [r.locator for r in got.orderBy("ord").collect()] == [1, 2, 3, 6]


def test_sinks_and_tables(spark, tmp_path, library):
    books, pages = library
    b = books.withColumn("filename", F.col("id"))
    sinks.write_index(b, spark.createDataFrame([("f", "e")], "file string, error string"), str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i/envelope")).first().book_count == 3
    sinks.write_texts(pages, str(tmp_path / "t"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == pages.count()
    assert [r.id for r in sinks.index_order(b).collect()] == ["b", "a", "c"]
    one, shared = sinks.last_wins(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, file_ord int, v string"))
    assert {r.v for r in one.collect()} == {"y", "z"} and shared.first().id == "a"
    state = sinks.state(spark, str(tmp_path / "none"))
    state = sinks.upsert(sinks.upsert(state, spark.createDataFrame([("k", "1")], "key string, value string")), spark.createDataFrame([("k", "2")], "key string, value string"))
    assert [tuple(r) for r in state.collect()] == [("k", "2")]
    defs = spark.createDataFrame([("a", "t", 1, 2, "page", "second"), ("a", "t", 0, 1, "page", "first")], "book_id string, term string, ord int, locator int, locator_type string, excerpt string")
    assert {tuple(r) for r in tables.definitions_of(tables.map_of(defs)).collect()} == {tuple(r) for r in defs.collect()}
    (tmp_path / "g.json").write_text('{"terms": [{"id": "a", "term": "Text / Code"}, {"id": "b", "term": "ab"}]}')
    assert tables.lexicon(spark, [str(tmp_path / "no.json"), str(tmp_path / "g.json")]) == ["text", "code"]
    assert tables.lexicon(spark, []) == ["text", "technology"]
    assert tables.names_list(spark, str(tmp_path / "no.json")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from lectern import streaming

    pages = spark.createDataFrame([(i, "b", i, i, "page", f"Here text is thing number {i} of a long row of things.") for i in range(6)], PAGES)
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming.run(streaming.page_stream(spark, str(tmp_path / "in"), pages.schema), ["text"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in definitions.matches(pages, ["text"]).collect()} and len(got) == 6


def test_empty_tables(spark, library):
    books, pages = (df.limit(0) for df in library)
    assert search.search(books, pages, "x").count() == 0 and search.in_book(pages, "x").count() == 0
    assert definitions.flag(pages, ["text"]).count() == 0 and catalogue.statistics(pages).count() == 0
    assert paragraphs.paragraphs(pages).count() == 0 and prompts.book_sample(pages).count() == 0


def test_glossary_and_framework_prompts(spark):
    from lectern.operators import prompts

    rows = [("trace", i, f"T{i}", "A. Author", f"excerpt {i}") for i in range(1, 13)]
    df = spark.createDataFrame(rows, "term string, position int, title string, author string, excerpt string")
    one = prompts.glossary_prompts(df).collect()
    assert [r.key for r in one] == ["glossary-trace"] and 'From "T10" by A. Author: "excerpt 10"' in one[0].prompt and "excerpt 11" not in one[0].prompt
    two = prompts.framework_prompts(df.withColumnRenamed("term", "framework")).collect()
    assert two[0].key == "framework-trace" and "T1, T10, T11" in two[0].prompt and two[0].prompt.index("excerpt 1") < two[0].prompt.index("excerpt 2")
    assert prompts.glossary_prompts(df.limit(0)).count() == 0


def test_contents_take_the_first_section_of_the_name(spark):
    from lectern.sources import containers

    extracted = spark.createDataFrame([("f", "toc", 0, "b/ch1.xhtml#x", "One", 0), ("f", "toc", 1, "none.xhtml", "Two", 0), ("f", "toc", 2, "ch2.xhtml", "Three", 1)], "file string, kind string, ord int, part string, title string, level int")
    sections = spark.createDataFrame([("f", 1, "a/ch1.xhtml"), ("f", 2, "b/ch1.xhtml"), ("f", 3, "OEBPS/ch2.xhtml")], "file string, locator int, part string")
    assert [(r.ord, r.section) for r in containers.contents(extracted, sections).orderBy("ord").collect()] == [(0, 1), (1, None), (2, 3)]


def test_promising_templates_lose_no_match():
    import random

    from lectern.operators import definitions as d

    terms = ("text", "textile", "trace", "ai", "artificial intelligence", "margin")
    bits = ["Text", "textile", "TRACE", "ai", "Artificial Intelligence", "margin", "is", "are", "defined", "the", "term", "of", "by", "I mean", "here", "in this", "means", "refers  to", "as", "a", "concept", "what", "do we mean by", "understanding", ",", ".", "\n", "'", "isn't"]
    rng = random.Random(8)
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(25))
        full = [(t, i, m.span()) for t in terms if t in text.lower() for i, p in enumerate(d.patterns(t)) for m in p.finditer(text)]
        assert [(t, i, m.span()) for t, i in d._promising(text.lower(), terms) for m in d.patterns(t)[i].finditer(text)] == full
