"""Bibliographic metadata from file names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import slug, strip

#: Marks of an archive's naming scheme in the last part of a file name (fixed values).
ARCHIVE_MARKS = ("Anna's Archive", "Anna’s Archive")
_HASH = r"^[0-9a-f]{32}$"
_ISBN = r"(?i)^isbn13"
#: Vendors that stand among authors (fixed values).
VENDORS = ("netlibrary", "inscribe")


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def year(c: Column) -> Column:
    """The earliest year 19xx or 20xx that stands alone; null if there is none."""
    return F.array_min(years(c))


def clean_title(c: Column) -> Column:
    t = strip(F.replace(c, F.lit("ǂ"), F.lit("")))
    for pattern, by in ((r"(?U)\s*_\s*", ": "), (r"(?U):\s*:", ":"), (r"(?U)\s{2,}", " "), (r"(?U)\s*[,:;_]\s*$", "")):
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def author_name(c: Column) -> Column:
    """`Last, First` as `First Last`, a trailing `Jr` kept, `_` for a period undone."""
    n = strip(c)
    for pattern, by in ((r"(?U)(\w)_(\s)", "$1.$2"), (r"(?U)(\w)_$", "$1."), (r"(?U)^Jr\.?\s+", ""), (r"(?U)\s{2,}", " ")):
        n = F.regexp_replace(n, pattern, by)
    parts = F.split(n, ",", 2)
    last, first = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    turned = F.when(F.lower(F.regexp_replace(first, r"\.+$", "")) == "jr", F.concat(last, F.lit(" Jr."))).otherwise(F.concat_ws(" ", first, last))
    return F.when(F.contains(n, F.lit(",")) & (first != "") & ~first.rlike(r"^\d"), turned).otherwise(n)


def authors(c: Column) -> Column:
    """Array of names from an author part: parted by ` & ` or else `; `, or three short names or more by commas, or one name."""
    a = F.regexp_replace(c, r"\[.*?\]", "")
    a = F.regexp_replace(a, r"(?i)\((?:author|editor|Foreword\s+by|contributor)\)", "")
    a = strip(F.regexp_replace(strip(F.regexp_replace(a, r"(?U),\s*\d{4}-?\d{0,4}\s*$", "")), ";+$", ""))

    def listed(separator: str) -> Column:
        parts = F.transform(F.split(a, separator), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), ";+$", ""), ",+$", "")))
        vendor = lambda x: F.lower(x).rlike("^(" + "|".join(VENDORS) + ")")
        return F.filter(F.transform(F.filter(parts, lambda x: (x != "") & ~vendor(x)), author_name), lambda x: x != "")

    commas = F.transform(F.split(a, ","), strip)
    short = F.forall(commas, lambda x: F.size(F.split(x, r"(?U)\s+")) <= 3)
    return (
        F.when(F.contains(a, F.lit(" & ")), listed(" & "))
        .when(F.contains(a, F.lit("; ")), listed("; "))
        .when((F.size(commas) >= 3) & short, F.filter(commas, lambda x: x != ""))
        .otherwise(F.filter(F.array(author_name(a)), lambda x: x != ""))
    )


def book_id(author: Column, title: Column) -> Column:
    """Slug of the first author's last word, and of the title cut to 40."""
    first = F.get(author, F.lit(0))
    last = F.element_at(F.split(first, r"(?U)\s+"), -1)
    who = F.when(F.size(author) > 0, F.when(first == "", F.lit("unknown")).otherwise(slug(last))).otherwise("")
    long = slug(F.coalesce(title, F.lit("unknown")))
    what = F.when(F.length(long) > 40, F.regexp_replace(F.substring(long, 1, 40), "-+$", "")).otherwise(long)
    return F.when(F.coalesce(who, F.lit("")) != "", F.concat_ws("-", who, what)).otherwise(what)


def from_file_name(path: Column, marks: tuple[str, ...] = ARCHIVE_MARKS) -> Column:
    """Struct (title, author, year, publisher, isbn) of a file name.

    Names of the archive's scheme are parted at ` -- `: title, authors, then
    dates, publishers, ISBN and hash. The first part with a year gives it; every
    other part of the middle is the publisher so far, so the last one stands, and
    a part with a second year is one too. Other names are the title, no more.
    """
    s = stem(path)
    raw = F.split(s, " -- ")
    last = F.element_at(raw, -1)
    ours = (F.size(raw) >= 3) & F.forall(F.array(F.lit(True)), lambda _: sum((F.contains(last, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0)
    parts = F.filter(F.transform(raw, strip), lambda x: ~x.isin(*marks))
    hashes = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(_HASH), i)), lambda i: i.isNotNull())
    end = F.coalesce(F.nullif(F.element_at(F.when(F.size(hashes) > 0, hashes), -1), F.lit(0)), F.size(parts))
    middle = F.when(end > 2, F.slice(parts, F.lit(3), F.greatest(end - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    middle = F.filter(middle, lambda x: ~x.rlike(_HASH) & ~x.rlike(_ISBN))
    fold = F.aggregate(
        middle,
        F.struct(F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("publisher")),
        lambda state, x: F.when(state["year"].isNull() & year(x).isNotNull(), F.struct(year(x).alias("year"), state["publisher"].alias("publisher"))).otherwise(
            F.struct(state["year"].alias("year"), x.alias("publisher"))
        ),
    )
    isbns = F.filter(parts, lambda x: x.rlike(_ISBN))
    isbn = F.nullif(F.regexp_extract(F.element_at(F.when(F.size(isbns) > 0, isbns), -1), r"(?i)isbn13\s+(\d{13})", 1), F.lit(""))
    none = F.array().cast("array<string>")
    parsed = F.struct(
        clean_title(F.get(parts, F.lit(0))).alias("title"), F.when(F.size(parts) > 1, authors(F.get(parts, F.lit(1)))).otherwise(none).alias("author"), fold["year"].alias("year"), fold["publisher"].alias("publisher"), isbn.alias("isbn")
    )
    plain = F.struct(
        F.translate(s, "_-", "  ").alias("title"), none.alias("author"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("isbn")
    )
    return F.when(ours, parsed).otherwise(plain)


def with_metadata(files: DataFrame, manual: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """Metadata of the files of column `path`: a manual record for the file name if there is one, else the file name's; gaps are filled from what the file itself says.

    `manual` and `inner` have filename, title, author, year, publisher, once per
    file name. Empty titles and author lists count as gaps; the ISBN has no other
    source than the name.
    """
    fields = ("title", "author", "year", "publisher", "isbn")
    df = files.withColumn("filename", base_name(F.col("path"))).withColumn("_m", from_file_name(F.col("path")))
    df = df.select("path", "filename", *[F.col(f"_m.{f}").alias(f) for f in fields])
    if manual is not None:
        m = manual.select("filename", F.lit(True).alias("_manual"), *[F.col(f).alias(f"_{f}") for f in fields[:4]])
        df = df.join(m, "filename", "left")
        chosen = [F.when(F.col("_manual"), F.col(f"_{f}") if f != "isbn" else F.lit(None).cast("string")).otherwise(F.col(f)).alias(f) for f in fields]
        df = df.select("path", "filename", *chosen)
    if inner is not None:
        i = inner.select("filename", *[F.col(f).alias(f"_{f}") for f in fields[:4]])
        df = df.join(i, "filename", "left")
        own = {"title": F.nullif("title", F.lit("")), "author": F.when(F.size("author") > 0, F.col("author")), "year": F.nullif("year", F.lit(0)), "publisher": F.nullif("publisher", F.lit(""))}
        df = df.select("path", "filename", *[F.coalesce(own[f], F.col(f"_{f}")).alias(f) for f in fields[:4]], "isbn")
    return df.withColumn("id", book_id(F.coalesce("author", F.array().cast("array<string>")), F.col("title")))
