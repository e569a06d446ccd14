from pyspark.sql import functions as F

from lectern.functions import metadata

HASH = "0123456789abcdef0123456789abcdef"
MARK = metadata.ARCHIVE_MARKS[0]


def test_file_names(column):
    name = f"Algorithms of Oppression -- Noble, Safiya Umoja -- 2018 -- NYU Press -- isbn13 9781479837243 -- {HASH} -- {MARK}.pdf"
    m = column(metadata.from_file_name, [name, "my_file-name.pdf", name.replace("2018 -- NYU Press", "NYU Press, 2018"), name.replace("2018 -- NYU Press", "2018 -- 2019 Reprint"), name.replace("'", "’")])
    assert m[0].asDict() == {"title": "Algorithms of Oppression", "author": ["Safiya Umoja Noble"], "year": 2018, "publisher": "NYU Press", "isbn": "9781479837243"}
    assert m[1].asDict() == {"title": "my file name", "author": [], "year": None, "publisher": None, "isbn": None}
    assert (m[2].year, m[2].publisher) == (2018, None)
    assert (m[3].year, m[3].publisher) == (2018, "2019 Reprint")
    assert m[4].title == "Algorithms of Oppression"


def test_authors(column):
    got = column(metadata.authors, ["Ana Li, Bo Ray, Cy Day", "Brock, Jr", "Li, Ana & Ray, Bo;", "Li, Ana; NetLibrary, Inc; Cy Day", "Li, Ana (author) [x], 1970-", "", "P_ K_ Dick"])
    assert got == [["Ana Li", "Bo Ray", "Cy Day"], ["Brock Jr."], ["Ana Li", "Bo Ray"], ["Ana Li", "Cy Day"], ["Ana Li"], [], ["P. K. Dick"]]


def test_years_and_titles(column):
    assert column(metadata.year, ["Reprinted 2004, first 1998", "no year", None, "12004"]) == [1998, None, None, None]
    assert column(metadata.clean_title, ["ǂThe  Thing _ A Story: : of it ,"]) == ["The Thing: A Story: of it"]


def test_book_ids(spark):
    rows = [(["Safiya Umoja Noble"], "Algorithms of Oppression"), ([], "Only a Title"), (["Andre Brock Jr."], "Distributed Blackness: African American Cybercultures"), ([""], None), (None, "x")]
    df = spark.createDataFrame(rows, "author array<string>, title string")
    got = [r[0] for r in df.select(metadata.book_id(F.col("author"), F.col("title"))).collect()]
    assert got == ["noble-algorithms-of-oppression", "only-a-title", "jr-distributed-blackness-african-american-c", "unknown-unknown", "x"]


def test_manual_records_and_gaps(spark):
    files = spark.createDataFrame([("/b/core.pdf",), ("/b/other_one.epub",)], "path string")
    manual = spark.createDataFrame([("core.pdf", "By Hand", ["A B"], 2019, "P")], "filename string, title string, author array<string>, year int, publisher string")
    inner = spark.createDataFrame([("other_one.epub", "Inner", ["C D"], 1999, "Q"), ("core.pdf", "No", ["X"], 1, "Y")], manual.schema)
    got = {r.filename: r for r in metadata.with_metadata(files, manual, inner).collect()}
    assert (got["core.pdf"].title, got["core.pdf"].year, got["core.pdf"].id) == ("By Hand", 2019, "b-by-hand")
    assert (got["other_one.epub"].title, got["other_one.epub"].author, got["other_one.epub"].publisher) == ("other one", ["C D"], "Q")
