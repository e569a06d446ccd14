"""Queries by name, each with the SQL that gives the same rows where SQL can say it.

Where the library has no table for an operator's input, one is derived from the
tables there are: citations are the terms a book defines and its own authors,
clusters are publishers, curated quotes first definitions, cards the books with
an index in their contents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import metadata, text
from lectern.operators import catalogue, definitions, graph, paragraphs, prompts, search, views
from lectern.sources import tables

FRAMEWORKS = ("feminist technoscience", "critical data studies", "media archaeology", "design justice", "cultural analytics")
THREADS = (("traces", 0, "trace"), ("traces", 1, "residue"), ("traces", 2, "imprint"), ("edges", 0, "margin"), ("edges", 1, "threshold"), ("void", 0, "no such term"))
TERMS = ("trace", "margin")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_BOOKS = "(SELECT DISTINCT ON (id) id, filename, title, author, year, publisher, format, word_count, page_count FROM books ORDER BY id, loaded_at DESC)"
_PAGES = "(SELECT DISTINCT ON (page_id) page_id, book_id, seq, locator, locator_type, text FROM pages ORDER BY page_id)"
_DEFS = "(SELECT DISTINCT ON (def_id) * FROM definitions ORDER BY def_id)"
_TOC = "(SELECT DISTINCT ON (book_id, ord) * FROM toc ORDER BY book_id, ord)"
_SPACE = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FIRST = "coalesce(author[1], '')"
_THREADS = "(VALUES " + ", ".join(f"('{t}', {o}, '{w}')" for t, o, w in THREADS) + ") AS t(thread_id, term_ord, term)"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _thread_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    terms = tables.constants(spark, list(THREADS), "thread_id string, ord int, term string")
    return terms.select(F.col("thread_id").alias("id")).distinct(), terms


def _curated(spark: SparkSession, root: str) -> DataFrame:
    lost = F.when(F.col("def_id").endswith("7"), F.concat(F.lit("lost-"), "book_id")).otherwise(F.col("book_id"))
    return tables.definitions(spark, root).where("ord = 0").select(F.col("term").alias("thread_id"), F.col("def_id").alias("ord"), lost.alias("book_id"), "excerpt")


def _citations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    books = tables.catalogue(spark, root)
    own = books.select(F.col("id").alias("book_id"), F.explode("author").alias("scholar"))
    terms = tables.read(spark, root, "definitions").select("book_id", F.col("term").alias("scholar")).distinct()
    scholar_book = own.groupBy(F.lower("scholar").alias("scholar_lower")).agg(F.min("book_id").alias("book_id"))
    return terms.unionByName(own).distinct(), books, scholar_book


@query(f"SELECT format, count(*) AS n FROM {_BOOKS} GROUP BY format")
def format_counts(spark, root):
    return catalogue.count_by(tables.catalogue(spark, root), "format")


@query("SELECT DISTINCT format FROM books")
def distinct_formats(spark, root):
    return tables.read(spark, root, "books").select("format").distinct()


@query(f"SELECT term, count(*) AS n FROM {_DEFS} GROUP BY term ORDER BY n DESC, min(def_id) LIMIT 15")
def top_terms(spark, root):
    return catalogue.top_terms(tables.definitions(spark, root))


@query(f"SELECT book_id, count(*) AS n FROM {_DEFS} GROUP BY book_id")
def definitions_per_book(spark, root):
    return catalogue.count_by(tables.definitions(spark, root).select("book_id"), "book_id")


@query(rf"""
    SELECT book_id, sum(words) AS word_count, sum(1 - blank) AS page_count, sum(blank) AS blank_pages, sum(blank) > 0.8 * count(*) AS scanned FROM (
      SELECT book_id, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '{_SPACE}+'), lambda w: w <> '')) END AS words,
        CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END AS blank FROM {_PAGES}) GROUP BY book_id
""")
def book_statistics(spark, root):
    return catalogue.statistics(tables.pages(spark, root))


@query(f"SELECT count(*) AS n_books, count(DISTINCT format) AS n_formats, sum(len(author)) AS n_author_entries, 0 AS n_failed FROM {_BOOKS}")
def library_summary(spark, root):
    return catalogue.summary(tables.catalogue(spark, root))


def _ordered(by: str, keys: str):
    sql = f"SELECT id, title, year, row_number() OVER (ORDER BY {keys}, {_FIRST}, title, id) AS position FROM {_BOOKS}"

    def run(spark, root):
        return catalogue.ordered(tables.catalogue(spark, root), by).select("id", "title", "year", "position")

    run.__name__ = f"library_by_{by}"
    return query(sql)(run)


for _by, _keys in (("title", "title"), ("year", "coalesce(year, 0) DESC"), ("author", _FIRST)):
    _ordered(_by, _keys)


@query(rf"""
    SELECT id, CASE WHEN len(author) = 0 THEN 'Unknown' ELSE array_to_string(author, ', ') END AS author, coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n.d.') AS year,
      CASE WHEN lower(format) IN ('epub', 'mobi', 'azw3') THEN 'sections' ELSE 'pages' END AS unit, CASE WHEN length(title) > 22 THEN left(title, 22) || '...' ELSE title END AS label
    FROM {_BOOKS} WHERE (contains(lower(title), 'isabella') OR contains(lower(array_to_string(author, ' ')), 'isabella')) AND format = 'epub'
""")
def library_filtered(spark, root):
    found = catalogue.matching(tables.catalogue(spark, root), "Isabella", "epub")
    return found.select(
        "id", catalogue.author_display(F.col("author")).alias("author"), catalogue.year_display(F.col("year")).alias("year"), catalogue.unit(F.col("format")).alias("unit"), text.truncate(F.col("title"), 22).alias("label")
    )


def _search_sql(condition: str, first: str, size: int) -> str:
    return f"""
        WITH h AS (SELECT p.*, b.title, b.author, strpos(lower(text), '{first}') - 1 AS pos FROM {_PAGES} p JOIN {_BOOKS} b ON b.id = p.book_id WHERE {condition}),
        r AS (SELECT *, row_number() OVER (ORDER BY {_FIRST}, title, book_id, seq, page_id) AS position, count(*) OVER () > 100 AS capped FROM h)
        SELECT position, book_id, title, array_to_string(author, ', ') AS author, locator, locator_type,
          substring(text, greatest(pos - 80, 0) + 1, pos + {size} + 80 - greatest(pos - 80, 0)) AS excerpt, pos - greatest(pos - 80, 0) AS match_index, capped FROM r WHERE position <= 100
    """


@query(_search_sql("contains(lower(text), 'market cannot be')", "market cannot be", 16))
def search_exact(spark, root):
    return search.search(tables.catalogue(spark, root), tables.pages(spark, root), "market cannot be")


@query(_search_sql("contains(lower(text), 'archive') AND contains(lower(text), 'memory')", "archive", 14))
def search_keywords(spark, root):
    return search.search(tables.catalogue(spark, root), tables.pages(spark, root), "archive memory", exact=False)


_MAIN = rf"""
    p AS (SELECT *, regexp_matches(left(regexp_replace(coalesce(text, ''), '^{_SPACE}+', ''), 200), '(?im)^(Introduction|Chapter\s+1|Part\s+(One|1|I)\b|1\s+[A-Z])') AS opens FROM {_PAGES}),
    f AS (SELECT book_id, min(seq) AS first FROM p WHERE opens GROUP BY book_id),
    m AS (SELECT p.* FROM p LEFT JOIN f USING (book_id) WHERE seq >= coalesce(first, 0))
"""


@query(rf"""
    WITH {_MAIN}, h AS (SELECT *, strpos(lower(text), 'archive') - 1 AS pos FROM m WHERE contains(lower(text), 'archive')),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq, page_id) AS n, count(*) OVER (PARTITION BY book_id) AS n_found FROM h)
    SELECT book_id, seq, locator, substring(text, greatest(pos - 100, 0) + 1, pos + 7 + 100 - greatest(pos - 100, 0)) AS excerpt, pos - greatest(pos - 100, 0) AS match_index, n_found FROM r WHERE n <= 20
""")
def book_search(spark, root):
    return search.in_book(tables.pages(spark, root), "archive")


@query(f"WITH {_MAIN} SELECT book_id, count(*) AS n, min(seq) AS first_seq FROM m GROUP BY book_id")
def main_text_pages(spark, root):
    return search.main_text(tables.pages(spark, root)).select("page_id", "book_id", "seq").dropDuplicates(["page_id"]).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query(f"""
    WITH f AS (SELECT book_id, locator AS section, min(seq) AS first_seq FROM pages GROUP BY ALL)
    SELECT t.book_id, t.ord, t.title, t.section, t.level, f.first_seq FROM {_TOC} t JOIN f ON f.book_id = t.book_id AND f.section = t.section WHERE t.section <> 0
""")
def open_contents(spark, root):
    return search.open_contents(tables.toc(spark, root), tables.pages(spark, root)).select("book_id", "ord", "title", "section", "level", "first_seq")


@query(rf"""
    WITH w AS (SELECT book_id, ord, lower(trim(regexp_replace(title, '^\d+\s+', ''))) AS h FROM {_TOC})
    SELECT w.book_id, w.ord, min(p.seq) AS seq FROM w JOIN pages p ON p.book_id = w.book_id
    WHERE h <> '' AND (contains(lower(text), h) OR (length(h) > 20 AND contains(lower(text), left(h, 40)))) GROUP BY ALL
""")
def goto_heading(spark, root):
    return search.goto(tables.toc(spark, root), tables.pages(spark, root))


@query(rf"""
    WITH h AS (SELECT id AS glossary_id, regexp_replace(lower(term), '\s*/.*', '') AS head FROM glossary),
    m AS (SELECT h.glossary_id, d.*, row_number() OVER (PARTITION BY glossary_id, left(excerpt, 100) ORDER BY def_id) AS r FROM {_DEFS} d JOIN h ON contains(lower(d.excerpt), head) WHERE head <> '')
    SELECT glossary_id, def_id, book_id, b.title, array_to_string(b.author, ', ') AS author, term AS matched_term, locator, locator_type FROM m JOIN {_BOOKS} b ON b.id = m.book_id WHERE r = 1
""")
def glossary_passages(spark, root):
    return views.glossary_passages(tables.read(spark, root, "glossary"), tables.definitions(spark, root), tables.catalogue(spark, root))


@query(f"""
    WITH m AS (SELECT t.thread_id, t.term_ord, d.*, row_number() OVER (PARTITION BY thread_id, book_id, left(excerpt, 80) ORDER BY term_ord, def_id) AS r FROM {_DEFS} d JOIN {_THREADS} ON t.term = d.term)
    SELECT thread_id, book_id, b.title, array_to_string(b.author, ', ') AS author, row_number() OVER (PARTITION BY thread_id, book_id ORDER BY term_ord, def_id) AS n, term, def_id, locator
    FROM m JOIN {_BOOKS} b ON b.id = m.book_id WHERE r = 1
""")
def thread_passages(spark, root):
    return views.thread_passages(_thread_tables(spark)[1], tables.definitions(spark, root), tables.catalogue(spark, root))


@query(f"SELECT t.thread_id, count(d.def_id) AS n_passages, count(DISTINCT d.book_id) AS n_books FROM {_THREADS} LEFT JOIN {_DEFS} d ON d.term = t.term GROUP BY t.thread_id")
def thread_counts(spark, root):
    return views.thread_counts(*_thread_tables(spark), tables.definitions(spark, root).select("term", "book_id"))


@query(f"""
    WITH c AS (SELECT term AS thread_id, def_id AS ord, CASE WHEN def_id LIKE '%7' THEN 'lost-' || book_id ELSE book_id END AS book_id, excerpt FROM {_DEFS} WHERE ord = 0)
    SELECT thread_id, ord, c.book_id, coalesce(b.title, c.book_id) AS title, coalesce(array_to_string(b.author, ', '), '') AS author, b.year, excerpt, 'technology' AS matched_term FROM c LEFT JOIN {_BOOKS} b ON b.id = c.book_id
""")
def curated_passages(spark, root):
    return views.curated_passages(_curated(spark, root), tables.catalogue(spark, root))


_FW = " UNION ALL ".join(f"SELECT '{f}' AS framework, book_id FROM x WHERE " + " OR ".join(f"contains(t, '{w}')" for w in views.framework_words(f)) for f in FRAMEWORKS)
_MATCHED = f"""x AS (SELECT id AS book_id, lower(title || ' ' || array_to_string(author, ' ')) AS t FROM {_BOOKS} UNION ALL SELECT book_id, lower(excerpt) FROM {_DEFS} WHERE term IN {TERMS} AND book_id IN (SELECT id FROM books)),
    fm AS (SELECT DISTINCT framework, book_id FROM ({_FW}))"""


@query(f"WITH {_MATCHED} SELECT * FROM fm")
def framework_match(spark, root):
    return views.framework_match(FRAMEWORKS, tables.catalogue(spark, root), tables.definitions(spark, root), TERMS)


@query(f"""
    WITH {_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE term WHEN 'trace' THEN 1 ELSE 2 END, ord, def_id) AS n FROM {_DEFS} WHERE term IN {TERMS})
    SELECT framework, r.book_id, b.title, array_to_string(b.author, ', ') AS author, n, term, def_id FROM fm JOIN r ON r.book_id = fm.book_id JOIN {_BOOKS} b ON b.id = r.book_id WHERE n <= 3
""")
def framework_passages(spark, root):
    books, defs = tables.catalogue(spark, root), tables.definitions(spark, root)
    return views.framework_passages(views.framework_match(FRAMEWORKS, books, defs, TERMS), books, defs, TERMS)


@query(f"""
    SELECT term, row_number() OVER (PARTITION BY term ORDER BY array_to_string(b.author, ', '), b.title, def_id) AS position, array_to_string(b.author, ', ') AS author, b.title, def_id, locator
    FROM {_DEFS} d JOIN {_BOOKS} b ON b.id = d.book_id WHERE term IN {TERMS}
""")
def compared_terms(spark, root):
    return views.compared_terms(tables.definitions(spark, root), tables.catalogue(spark, root), TERMS)


@query(f"SELECT id, title FROM {_BOOKS} WHERE id IN (SELECT book_id FROM toc WHERE title = 'Index')")
def flashcard_deck(spark, root):
    return views.deck(tables.catalogue(spark, root), tables.read(spark, root, "toc").where("title = 'Index'").select("book_id")).select("id", "title")


@query()
def flashcard_shuffle(spark, root):
    return views.shuffled(tables.catalogue(spark, root).select("id", "title"), "id", seed=7)


@query(r"""
    SELECT id, CASE WHEN strpos(c, ' — ') > 1 THEN left(c, strpos(c, ' — ') - 1) ELSE c END AS coined, CASE WHEN strpos(c, ' — ') > 1 THEN substring(c, strpos(c, ' — ')) END AS meaning
    FROM (SELECT id, CASE WHEN id < 'm' THEN term || ' — ' || definition ELSE definition END AS c FROM glossary)
""")
def coinage_split(spark, root):
    c = F.when(F.col("id") < "m", F.concat("term", F.lit(" — "), "definition")).otherwise(F.col("definition"))
    coined, meaning = text.coinage(c)
    return tables.read(spark, root, "glossary").select("id", coined.alias("coined"), meaning.alias("meaning"))


_CITES = f"""
    b AS {_BOOKS}, c AS (SELECT DISTINCT * FROM (SELECT book_id, term AS scholar FROM definitions UNION ALL SELECT id, unnest(author) FROM b)),
    sb AS (SELECT lower(a) AS scholar_lower, min(id) AS book_id FROM (SELECT id, unnest(author) AS a FROM b) GROUP BY 1),
    k AS (SELECT * FROM c WHERE book_id IN (SELECT id FROM b)),
    n AS (SELECT lower(scholar) AS scholar, min(scholar) AS name, count(*) AS n FROM k GROUP BY 1),
    citing AS (SELECT * FROM b WHERE id IN (SELECT book_id FROM c)), own AS (SELECT * FROM sb WHERE book_id IN (SELECT id FROM citing)),
    j AS (SELECT k.book_id, lower(k.scholar) AS s, own.book_id AS target FROM k LEFT JOIN own ON own.scholar_lower = lower(k.scholar)),
    nodes AS (
      SELECT id, title AS label, 'book' AS type, m IS NOT NULL AS cited, coalesce(m, 0) AS n FROM citing LEFT JOIN
        (SELECT id AS bid, max(n.n) AS m FROM (SELECT id, unnest(author) AS a FROM citing) x JOIN n ON n.scholar = lower(a) GROUP BY id) ON bid = id
      UNION ALL SELECT 'scholar-' || regexp_replace(lower(name), '[^a-z0-9]', '-', 'g'), name, 'scholar', true, n FROM n WHERE scholar NOT IN (SELECT scholar_lower FROM own)),
    edges AS (
      SELECT book_id AS source, target, 'cites_author' AS type FROM j WHERE target IS NOT NULL AND target <> book_id
      UNION ALL SELECT j.book_id, 'scholar-' || regexp_replace(lower(name), '[^a-z0-9]', '-', 'g'), 'cites' FROM j JOIN n ON n.scholar = j.s WHERE target IS NULL)
"""


@query(f"""
    WITH {_CITES} SELECT id, label, type, cited, n, CASE WHEN type = 'book' THEN greatest(24, 24 + 3 * n) ELSE greatest(16, 12 + 4 * n) END AS radius,
      CASE WHEN type = 'book' AND cited THEN 'scholarIn' WHEN type = 'book' THEN 'book' ELSE 'scholarOut' END AS colour FROM nodes
""")
def graph_nodes(spark, root):
    return graph.nodes(*_citations(spark, root))


@query(f"WITH {_CITES} SELECT * FROM edges")
def graph_edges(spark, root):
    return graph.edges(*_citations(spark, root))


@query(f"WITH {_CITES} SELECT source AS id, target AS other FROM edges UNION SELECT target, source FROM edges")
def graph_neighbours(spark, root):
    return graph.neighbours(graph.edges(*_citations(spark, root)))


@query(f"WITH {_CITES} SELECT id, label FROM nodes WHERE contains(lower(label), 'archive') ORDER BY label, id LIMIT 8")
def node_search(spark, root):
    return graph.search_nodes(graph.nodes(*_citations(spark, root)), "archive").select("id", "label")


@query(f"""
    SELECT publisher AS cluster, count(*) AS n, min(CAST(word_count AS DOUBLE)) - 60 AS x0, min(CAST(page_count AS DOUBLE)) - 60 AS y0, max(CAST(word_count AS DOUBLE)) + 60 AS x1, max(CAST(page_count AS DOUBLE)) + 60 AS y1
    FROM {_BOOKS} WHERE publisher IS NOT NULL GROUP BY publisher HAVING count(*) >= 2
""")
def cluster_boxes(spark, root):
    b = tables.latest(tables.read(spark, root, "books").select("id", "publisher", "word_count", "page_count", "loaded_at"), "id")
    members = b.where("publisher is not null").select("id", F.col("publisher").alias("cluster"))
    return graph.cluster_boxes(members, b.select("id", F.col("word_count").cast("double").alias("x"), F.col("page_count").cast("double").alias("y")))


@query(f"""
    WITH {_CITES} SELECT id, CASE WHEN type <> 'book' THEN 0.1 WHEN i THEN 1.0 ELSE 0.15 END AS circle, CASE WHEN type <> 'book' THEN 0.05 WHEN i THEN 1.0 ELSE 0.08 END AS text_opacity
    FROM (SELECT nodes.*, id IN (SELECT id FROM b WHERE publisher = 'Saltry Academic') AS i FROM nodes)
""")
def node_opacity(spark, root):
    members = tables.read(spark, root, "books").where("publisher is not null").select("id", F.col("publisher").alias("cluster")).distinct()
    return graph.opacity(graph.nodes(*_citations(spark, root)), members, "book", "Saltry Academic").select("id", F.col("circle").cast("decimal(3,2)").alias("circle"), F.col("text_opacity").cast("decimal(3,2)").alias("text_opacity"))


def _slug_sql(x: str) -> str:
    spaces = _SPACE[1:-1]
    kept = rf"[^\p{{L}}\p{{M}}\p{{N}}_{spaces}-]"
    bare = rf"regexp_replace(regexp_replace(lower({x}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{kept}', '', 'g')"
    return rf"left(trim(regexp_replace(regexp_replace({bare}, '[{spaces}_]+', '-', 'g'), '-+', '-', 'g'), '-'), 80)"


@query(rf"""
    WITH b AS (SELECT id, {_slug_sql("title")} AS slug, {_slug_sql("coalesce(title, 'unknown')")} AS long, author[1] AS first, {_slug_sql(rf"regexp_extract(author[1], '[^\s]*$')")} AS last, len(author) AS n FROM {_BOOKS}),
    w AS (SELECT *, CASE WHEN length(long) > 40 THEN rtrim(left(long, 40), '-') ELSE long END AS what, CASE WHEN n > 0 THEN CASE WHEN first = '' THEN 'unknown' ELSE last END ELSE '' END AS who FROM b)
    SELECT id, slug, CASE WHEN coalesce(who, '') <> '' THEN who || '-' || what ELSE what END AS made_id FROM w
""")
def book_ids(spark, root):
    return tables.catalogue(spark, root).select("id", text.slug(F.col("title")).alias("slug"), metadata.book_id(F.col("author"), F.col("title")).alias("made_id"))


@query(rf"SELECT id, list_min(list_transform(regexp_extract_all(title, '\b((?:19|20)[0-9]{{2}})\b', 1), lambda y: CAST(y AS INTEGER))) AS year FROM {_BOOKS}")
def title_years(spark, root):
    return tables.catalogue(spark, root).select("id", metadata.year(F.col("title")).alias("year"))


@query(rf"SELECT filename, translate(regexp_replace(filename, '\.[^.]*$', ''), '_-', '  ') AS title, len(list_filter([filename], lambda f: false)) AS n_authors, CAST(NULL AS INTEGER) AS year FROM (SELECT DISTINCT filename FROM books)")
def file_names(spark, root):
    m = metadata.from_file_name(F.col("filename"))
    return tables.read(spark, root, "books").select("filename").distinct().select("filename", m["title"].alias("title"), F.size(m["author"]).alias("n_authors"), m["year"].alias("year"))


@query(rf"""
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM {_PAGES} WHERE text IS NOT NULL
""")
def html_text(spark, root):
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<!doctype html><html><head><style>p{}</style><script>var s = '</p>';</script></head><body><!-- <p>no</p> --><p class='a'>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></body></html>"))
    return tables.pages(spark, root).where("text is not null").select("page_id", text.html_to_text(html).alias("text")).dropDuplicates(["page_id"])


@query(rf"""
    WITH l AS (SELECT page_id, regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS x FROM {_PAGES}))
    SELECT page_id, count(*) AS n FROM (SELECT *, len(string_split_regex(t, '{_SPACE}+')) AS w FROM l) WHERE t <> '' AND length(t) <= 100 AND NOT regexp_matches(t, '[.,;]$') AND w <= 12 AND (
      (regexp_matches(t, '^\d+{_SPACE}+[A-Z]') AND length(t) < 80) OR (regexp_matches(t, '(?i)^({text.HEADING_WORDS})\b') AND w <= 8)
      OR (t = upper(t) AND regexp_matches(t, '[A-Z]') AND length(t) > 2 AND length(t) < 60 AND w <= 6)) GROUP BY page_id
""".replace(r"^\d+" + _SPACE, r"^\d+\s"))
def headings(spark, root):
    lines = tables.pages(spark, root).select("page_id", F.size(F.filter(F.split("text", "\n"), text.is_heading)).alias("n"))
    return lines.where("n > 0").dropDuplicates(["page_id"]).select("page_id", F.col("n").cast("long").alias("n"))


@query(r"SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\d{1,3}\.\s'))) AS n FROM documents) WHERE n > 0")
def footnotes(spark, root):
    lines = F.filter(F.split("text", "\n"), text.is_footnote)
    return tables.read(spark, root, "documents").select("doc_id", F.size(lines).alias("n")).where("n > 0")


@query(rf"""
    WITH l AS (SELECT page_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM {_PAGES})
    SELECT page_id, coalesce(len(ls) < 3 OR len(list_filter(ls, lambda x: length(x) < 5 OR regexp_matches(x, '(?i){"|".join(text.FRONT_MATTER)}'))) / len(ls) > 0.5, true) AS front FROM l
""")
def front_matter(spark, root):
    return tables.pages(spark, root).select("page_id", text.is_front_matter(F.col("text")).alias("front")).dropDuplicates(["page_id"])


@query()
def page_paragraphs(spark, root):
    return paragraphs.paragraphs(tables.pages(spark, root).where("text is not null"))


@query(f"SELECT def_id, regexp_replace(excerpt, '(?i)(trace|margin)', '<mark>\\1</mark>', 'g') AS marked, strpos(lower(excerpt), 'trace') - 1 AS at FROM {_DEFS}")
def highlighted(spark, root):
    return tables.read(spark, root, "definitions").select("def_id", text.highlight(F.col("excerpt"), TERMS).alias("marked"), text.find(F.col("excerpt"), "trace").alias("at")).dropDuplicates(["def_id"])


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq, page_id) AS n FROM {_PAGES} WHERE text IS NOT NULL)
    SELECT book_id, left(string_agg(left(text, 15000), chr(10) || chr(10) ORDER BY n), 15000) AS context FROM r WHERE n <= 20 GROUP BY book_id
""")
def book_context(spark, root):
    return prompts.book_sample(tables.pages(spark, root))


@query(f"""
    WITH c AS (SELECT term, row_number() OVER (PARTITION BY term ORDER BY array_to_string(b.author, ', '), b.title, def_id) AS position, array_to_string(b.author, ', ') || ', "' || b.title || '" (p.' || coalesce(CAST(locator AS VARCHAR), '') || '): "' || excerpt || '"' AS line
      FROM {_DEFS} d JOIN {_BOOKS} b ON b.id = d.book_id WHERE term IN {TERMS})
    SELECT term, string_agg(line, chr(10) ORDER BY position) AS context FROM c WHERE position <= 15 GROUP BY term
""")
def term_context(spark, root):
    defs = tables.definitions(spark, root)
    return prompts.term_context(views.compared_terms(defs, tables.catalogue(spark, root), TERMS), defs.select("def_id", "excerpt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parts(spark, root):
    found = text.json_part(F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")), "k long", array=False)
    return tables.read(spark, root, "events").select("event_id", found["k"].alias("k"))


@query()
def definitions_flagged(spark, root):
    terms = [r[0] for r in tables.read(spark, root, "glossary").select(F.explode(text.term_parts(F.col("term")))).distinct().collect()]
    return definitions.flag(tables.pages(spark, root), sorted(terms))


@query("SELECT book_id, term, ord, d.locator, d.locator_type, d.excerpt FROM (SELECT id AS book_id, unnest(map_keys(definitions)) AS term, unnest(map_values(definitions)) AS l FROM (SELECT DISTINCT ON (id) id, definitions FROM books ORDER BY id)) m, LATERAL (SELECT unnest(l) AS d, unnest(range(len(l))) AS ord)")
def definitions_from_maps(spark, root):
    once = tables.latest(tables.read(spark, root, "books").select("id", "definitions", "loaded_at"), "id")
    return tables.definitions_of(once)
