"""Sources: page Markdown, layout JSON, images, CSV and HTML tables, listings.

Readers take folders or globs and give one table with what the file names say. Files that can't be read give a null
value and a note, never a failed job.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import input_kind, requires_conversion
from ..functions.text import strip
from ..operators.merge import parse_pages
from ..operators.nested import LAYOUT

# Page numbers in the names of layout files and images, first match first.
JSON_PAGE = r"page(?:_images)?_page_(\d{3})"
PAGE_PATTERNS = (r"page_images_page_(\d+)", r"page_(\d+)", r"page(\d+)")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and time of files, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def inspect(listing: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """SRC-01, SRC-02: kind of each input and a note about those that can't be used. ``wanted``: paths that must be there."""
    found = listing.withColumn("kind", input_kind(F.col("path"))).withColumn("convert", requires_conversion(F.col("path")))
    note = F.when(F.col("kind") == "unsupported", "unsupported").when(F.col("size") == 0, "empty file")
    found = found.withColumn("note", note)
    if wanted is None:
        return found
    return wanted.join(found, "path", "left").withColumn("note", F.when(F.col("kind").isNull(), "not found").otherwise(F.col("note")))


def pdf_page_count(content: Column) -> Column:
    """SRC-02: struct of ``pages`` and ``note`` of a PDF's bytes: its page objects, as far as they are not in compressed streams,
    else the count that its page tree states; null with a note where there is neither."""
    text = F.decode(content, "iso-8859-1")
    objects = F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])"))
    stated = F.regexp_extract(text, r"/Type\s*/Pages\b[^>]*?/Count\s+([0-9]+)", 1).try_cast("int")
    n = F.when(objects > 0, objects).otherwise(stated)
    note = F.when(content.isNull() | ~text.startswith("%PDF-"), "no PDF").when(n.isNull(), "no pages found")
    return F.struct(F.when(note.isNull(), n).cast("int").alias("pages"), note.alias("note"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: Markdown of pages and parts in the order of their numbers; other files are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    folder = F.element_at(F.split("path", "/"), -2)
    return parse_pages(raw).withColumn("doc_id", folder).select("doc_id", "page", "part", "path", "text")


def page_of_name(name: Column, patterns: Sequence[str] = PAGE_PATTERNS) -> Column:
    """SRC-05: the number that the first matching pattern finds, else null."""
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, 1).cast("int")) for p in patterns])


def default_page(files: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """SRC-06: the only file of a folder is page 1 if its name has no number."""
    n = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return files.join(n, list(keys)).withColumn("page", F.when(F.col("page").isNull() & (F.col("__n") == 1), 1).otherwise(F.col("page"))).drop("__n")


def spark_layout_schema() -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    s = from_arrow_schema(LAYOUT)
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.fields if f.name != "layout_id")


def read_layouts(spark: SparkSession, path: str, inside: str | None = None) -> DataFrame:
    """SRC-04, SRT-04: layout JSON of pages in the order of their names; files without a page number are left out, damaged
    ones have null arrays. ``inside`` is the place of the files in their result folder, whose name is the document's."""
    raw = spark.read.schema(spark_layout_schema()).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    meta = raw.select("*", F.col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    out = meta.where(name.rlike(JSON_PAGE))
    up = -2 - len([p for p in (inside or "").split("/") if p])
    folder = F.element_at(F.split("path", "/"), up)
    return out.withColumn("doc_id", folder).withColumn("page", F.regexp_extract(name, JSON_PAGE, 1).cast("int")).orderBy("path")


def layout_cells(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """SRC-07, SET-01: the cells of all tables of typed pages; tables without cells have none."""
    t = pages.select(*keys, F.posexplode("tables").alias("table_no", "t"))
    c = t.select(*keys, "table_no", F.posexplode("t.cells").alias("idx", "c")).where("c is not null")
    return c.select(*keys, "table_no", "idx", "c.row", "c.col", F.col("c.contents").alias("text"), "c.row_span", "c.col_span", "c.box")


CELLS = "doc_id string, page int, table_no int, idx int, row int, col int, text string, row_span int, col_span int, box array<int>"


def parse_csv_tables(text: str, tables_only: bool = False) -> list[list[list[str]]]:
    """SRC-08: the tables of a CSV text, parted by blank rows; with ``tables_only`` those with more than one column."""
    tables: list[list[list[str]]] = [[]]
    for row in csv.reader(io.StringIO(text)):
        if any(v.strip() for v in row):
            tables[-1].append(row)
        elif tables[-1]:
            tables.append([])
    return [t for t in tables if t and (not tables_only or max(map(len, t)) > 1)]


class _Tables(HTMLParser):
    """Cells of the tables of a page: (is header, text, row span, column span) by row. Inner rows belong to all tables around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[int] = []
        self.cells: list[list] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif tag == "tr":
            for k in self.open:
                self.tables[k].append([])
        elif tag in ("td", "th") and self.open and self.tables[self.open[-1]]:
            cell = [tag == "th", "", _span(a.get("rowspan")), _span(a.get("colspan"))]
            self.cells.append(cell)
            for k in self.open:
                if self.tables[k]:
                    self.tables[k][-1].append(cell)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cells:
            self.cells.pop()

    def handle_data(self, data: str) -> None:
        for c in self.cells:
            c[1] += data


def _span(x: str | None) -> int:
    try:
        return max(1, int(x or 1))
    except ValueError:
        return 1


def parse_html_tables(html: str) -> list[list[tuple[int, int, str, int, int]]]:
    """SRC-09: (row, column, text, row span, column span) of each table. In a row headers come before other cells; places
    that earlier spans cover are passed over."""
    p = _Tables()
    p.feed(html or "")
    out = []
    for rows in p.tables:
        cells, taken = [], set()
        for r, row in enumerate(rows, 1):
            c = 1
            for _, text, rs, cs in sorted(row, key=lambda x: not x[0]):
                while (r, c) in taken:
                    c += 1
                cells.append((r, c, text.strip(), rs, cs))
                taken |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
                c += cs
        if cells:
            out.append(cells)
    return out


def table_files(files: DataFrame, kind: str, tables_only: bool = False) -> DataFrame:
    """SRC-08, SRC-09: cells of the tables in texts (``doc_id``, ``page``, ``text``) of CSV or HTML. No tables, no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, p, t in zip(pdf["doc_id"], pdf["page"], pdf["text"]):
                if not t:
                    continue
                if kind == "csv":
                    tables = [[(r, c, v.strip(), 1, 1) for r, row in enumerate(x, 1) for c, v in enumerate(row, 1)] for x in parse_csv_tables(t, tables_only)]
                else:
                    tables = parse_html_tables(t)
                rows += [(d, p, k, i, r, c, v, rs, cs, None) for k, cells in enumerate(tables) for i, (r, c, v, rs, cs) in enumerate(cells)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("doc_id", F.col("page").cast("int").alias("page"), "text").mapInPandas(run, CELLS)


def requested_pages(images: DataFrame, pages: DataFrame | None, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """SRC-14, JON-10: images of the requested pages that are there, or all, in order."""
    return (images if pages is None else images.join(pages.select(*keys).distinct(), list(keys), "left_semi")).orderBy(*keys)


def load_rules(text: str) -> list[tuple[str, str]]:
    """SRC-15: a rule pack from JSON: pattern and literal replacement; entries without either or that are no pattern are left out."""
    import re

    out = []
    try:
        entries = json.loads(text)
    except ValueError:
        return []
    for e in entries if isinstance(entries, list) else []:
        if not isinstance(e, dict) or not e.get("pattern") or e.get("replacement") is None:
            continue
        try:
            re.compile(e["pattern"])
        except re.error:
            continue
        flags = "".join({"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s"}.get(f, "") for f in e.get("flags", []))
        out.append((f"(?{flags}U)" + e["pattern"], e["replacement"].replace("\\", "\\\\").replace("$", "\\$")))
    return out


def recognized(images: DataFrame, recognize, schema: str) -> DataFrame:  # noqa: ANN001
    """The slot for a recognizer (ORC-05, ORC-16, ORC-23): ``recognize()`` is called once a worker and gives a function
    from a batch of images to a batch of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or recognize()
            yield model(pdf)

    return images.mapInPandas(run, schema)


def safe_folder(name: Column) -> Column:
    """PRD-15: folder names without separators, parents and blanks around."""
    return (strip(name) != "") & ~name.rlike(r"[/\\]") & ~name.contains("..")
