"""Book files: listing, format dispatch, readers, and errors as rows.

Readers run where the files are read, one file a call. ZIP archives of numbered
texts and EPUB are read with the standard library; readers of other formats are
plugged in by suffix. A file that fails becomes an error row.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.metadata import base_name, suffix
from lectern.functions.text import html_to_text

SUFFIXES = (".pdf", ".epub", ".mobi", ".azw3", ".zip")


@dataclass
class Content:
    """What a reader returns: (locator or None, part name, text, whether it is HTML) rows, contents and inner metadata."""

    locator_type: str
    parts: list[tuple[int | None, str, str, bool]]
    toc: list[tuple[str, str, int]] = field(default_factory=list)
    title: str | None = None
    author: list[str] = field(default_factory=list)
    year: int | None = None
    publisher: str | None = None


Reader = Callable[[bytes], Content]


def list_files(spark: SparkSession, root: str, skip: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """`path, length, content` of the book files directly below `root`; `skip` holds file names to leave out."""
    files = spark.read.format("binaryFile").load(root).select("path", "length", "content")
    return files.where(suffix(F.col("path")).isin(*suffixes) & ~base_name(F.col("path")).isin("", *skip))


def read_zip(data: bytes) -> Content:
    """Numbered `.txt` members in the order of the first number of their base name; members without one, or of up to ten characters, are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = []
        for name in z.namelist():
            number = re.search(r"\d+", posixpath.basename(name))
            if name.lower().endswith(".txt") and number:
                found.append((int(number[0]), name))
        parts = [(n, name, text, False) for n, name in sorted(found) if len((text := z.read(name).decode("utf-8", "replace").strip())) > 10]
    if not parts:
        raise ValueError("no text pages in the archive")
    return Content("page", parts)


def read_epub(data: bytes) -> Content:
    """Documents in spine order as HTML, the table of contents depth first, and Dublin Core metadata."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tags = lambda node, tag: [x for x in node.iter() if x.tag.rpartition("}")[2] == tag]
        package_path = tags(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        package, base = ElementTree.fromstring(z.read(package_path)), posixpath.dirname(package_path)
        at = lambda href, start=base: posixpath.normpath(posixpath.join(start, href))
        items = {x.get("id"): x for x in tags(package, "item")}
        parts = [(None, at(items[r.get("idref")].get("href")), z.read(at(items[r.get("idref")].get("href"))).decode("utf-8", "replace"), True) for r in tags(package, "itemref") if r.get("idref") in items]
        text = lambda tag: [x.text.strip() for x in tags(package, tag) if x.text and x.text.strip()]
        years_ = [int(y) for d in text("date")[:1] for y in re.findall(r"\b(?:19|20)\d{2}\b", d)]
        toc: list[tuple[str, str, int]] = []
        ncx = next((x for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
        if ncx is not None:

            def walk(node, level: int) -> None:
                for point in (x for x in node if x.tag.rpartition("}")[2] == "navPoint"):
                    label, target = tags(point, "text"), tags(point, "content")
                    if label and label[0].text and target and target[0].get("src"):
                        toc.append((label[0].text.strip(), target[0].get("src"), level))
                    walk(point, level + 1)

            try:
                walk(tags(ElementTree.fromstring(z.read(at(ncx.get("href")))), "navMap")[0], 0)
            except (KeyError, IndexError, ElementTree.ParseError):
                pass  # a table of contents is welcome, not required
    return Content("section", parts, toc, (text("title") or [None])[0], text("creator"), min(years_, default=None), (text("publisher") or [None])[0])


#: Readers by suffix; callers add their own for PDF, MOBI and AZW3.
READERS: dict[str, Reader] = {".zip": read_zip, ".epub": read_epub}


def with_ocr(pages_: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], str], share: float = 0.8) -> Reader:
    """A reader of paged files: text pages, or, if more than `share` of them are blank, recognised text for the blank ones. A recogniser that fails ends recognition and keeps what there is."""

    def read(data: bytes) -> Content:
        texts = pages_(data)
        if texts and sum(not t.strip() for t in texts) > share * len(texts):
            for i, t in enumerate(texts):
                if not t.strip():
                    try:
                        texts[i] = recognise(data, i)
                    except Exception:  # noqa: BLE001
                        break
        return Content("page", [(i + 1, str(i + 1), t, False) for i, t in enumerate(texts) if t.strip()])

    return read


_EXTRACTED = "file string, kind string, ord int, locator int, locator_type string, part string, text string, html boolean, title string, author array<string>, year int, publisher string, level int, error string"


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """One row per part (`kind` part), contents entry (toc), book (book) or failed file (error)."""
    known = READERS | (readers or {})
    known = {**known, ".azw3": known[".mobi"]} if ".mobi" in known and ".azw3" not in known else known

    def rows(path: str, data: bytes) -> Iterator[dict]:
        name = posixpath.basename(path)
        reader = known.get(posixpath.splitext(name)[1].lower())
        try:
            if reader is None:
                raise ValueError(f"no reader for {posixpath.splitext(name)[1] or name}")
            c = reader(data)
        except Exception as e:  # noqa: BLE001 - a failed file is a row
            yield {"file": name, "kind": "error", "error": f"{type(e).__name__}: {e}"}
            return
        yield {"file": name, "kind": "book", "title": c.title, "author": c.author, "year": c.year, "publisher": c.publisher}
        for i, (locator, part, text, html) in enumerate(c.parts):
            yield {"file": name, "kind": "part", "ord": i, "locator": locator, "locator_type": c.locator_type, "part": part, "text": text, "html": html}
        for i, (title, href, level) in enumerate(c.toc):
            yield {"file": name, "kind": "toc", "ord": i, "part": href, "title": title, "level": level}

    columns = [x.split()[0] for x in _EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(list(rows(path, bytes(data))), columns=columns).astype(object)
                yield found.where(found.notna(), None)

    return files.select("path", "content").mapInPandas(run, _EXTRACTED)


def sections(extracted: DataFrame, least: int = 50) -> DataFrame:
    """`file, seq, locator, locator_type, part, text`: HTML as text, parts of up to `least` characters dropped, and sections numbered from 1 as kept."""
    text = F.when(F.col("html"), html_to_text(F.col("text"))).otherwise(F.col("text"))
    kept = extracted.where("kind = 'part'").withColumn("text", text).where(~F.col("html") | (F.length(F.trim("text")) > least))
    number = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    return kept.select("file", (number - 1).alias("seq"), F.coalesce("locator", number).alias("locator"), "locator_type", "part", "text")


def contents(extracted: DataFrame, sections_: DataFrame) -> DataFrame:
    """`file, ord, title, section, level`: contents entries with their section, or null: the first kept one, by locator, whose part is the entry's target without its fragment, or ends in it, or has its base name."""
    target = F.regexp_replace(F.col("part"), "#.*$", "")
    base = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    entries = extracted.where("kind = 'toc'").select("file", "ord", "title", "level", target.alias("target"), base(target).alias("base"))
    parts = sections_.select("file", F.col("part"), base(F.col("part")).alias("base"), "locator")
    # Each of the tests implies an equal base name, so the join is on it and the first by locator is what the tests in turn would find.
    found = entries.where("base <> ''").join(parts, ["file", "base"]).groupBy("file", "ord").agg(F.min("locator").alias("section"))
    return entries.join(found, ["file", "ord"], "left").select("file", "ord", "title", "section", "level")


def errors(extracted: DataFrame) -> DataFrame:
    return extracted.where("kind = 'error'").select("file", "error")
