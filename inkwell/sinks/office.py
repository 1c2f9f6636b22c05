"""Workbooks (SNK-05, SNK-06, SNK-07) and documents (SNK-10) in Office Open XML, with the standard library only.

One row per file goes in, one row with its bytes comes out, or the file is written where the task runs. A workbook or
document is made by one task: what goes into one is bounded by what such a file can hold.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.ranks import numbered

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Styles by number: text, integer, float, percent, percent with a decimal, date, header.
_FORMATS = {"#,##0": 1, "#,##0.00": 2, "0%": 3, "0.0%": 4, "yyyy/mm/dd": 5}


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _clean(s: str) -> str:
    return "".join(c for c in s if c in "\t\n\r" or ord(c) >= 32)


def _cell(ref: str, v: object, style: int) -> str:
    if v is None or v == "":
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(v, dt.date):
        return f'<c r="{ref}" s="{style}"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f'<c r="{ref}" s="{style}"><v>{v}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(str(v)))}</t></is></c>'


def workbook(sheets: Iterable[dict]) -> bytes:
    """A workbook. A sheet has ``name``, ``rows`` (of values or (value, format) pairs), and optionally ``merges`` (top, left,
    bottom, right), ``table`` (a name: the rows become a table with a header), ``status`` (a review column with a list),
    ``widths``, ``links`` (cell reference to target)."""
    sheets = list(sheets) or [{"name": "Sheet1", "rows": []}]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        types, tables = [], 0
        for n, s in enumerate(sheets, 1):
            rows = []
            for r, row in enumerate(s["rows"], 1):
                cells = []
                for c, x in enumerate(row, 1):
                    v, f = x if isinstance(x, tuple) else (x, None)
                    cells.append(_cell(f"{column_name(c)}{r}", v, 6 if r == 1 and s.get("table") else _FORMATS.get(f, 0)))
                rows.append(f'<row r="{r}">{"".join(cells)}</row>')
            cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in sorted((s.get("widths") or {}).items()))
            x = f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            x += f"<cols>{cols}</cols>" * bool(cols) + f"<sheetData>{''.join(rows)}</sheetData>"
            merges = [m for m in s.get("merges") or [] if (m[0], m[1]) != (m[2], m[3])]
            if merges:
                x += f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{column_name(a)}{t}:{column_name(b)}{u}"/>' for t, a, u, b in merges) + "</mergeCells>"
            if s.get("status") and len(rows) > 1:
                at = column_name(s["status"])
                x += f'<dataValidations count="1"><dataValidation type="list" allowBlank="1" sqref="{at}2:{at}{len(rows)}"><formula1>"○,×"</formula1></dataValidation></dataValidations>'
            if s.get("links"):
                x += "<hyperlinks>" + "".join(f'<hyperlink ref="{ref}" location={quoteattr(to)} display={quoteattr(to)}/>' for ref, to in s["links"].items()) + "</hyperlinks>"
            if s.get("table") and s["rows"]:
                tables += 1
                head = [str(v[0] if isinstance(v, tuple) else v) for v in s["rows"][0]][: s.get("width") or None]
                ref = f"A1:{column_name(len(head))}{max(2, len(rows))}"
                cols_xml = "".join(f'<tableColumn id="{k}" name={quoteattr(_clean(h).replace(chr(10), "_x000a_"))}/>' for k, h in enumerate(head, 1))
                z.writestr(f"xl/tables/table{tables}.xml", f'{_HEAD}<table xmlns="{_MAIN}" id="{tables}" name={quoteattr(s["table"])} displayName={quoteattr(s["table"])} ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(head)}">{cols_xml}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>')
                z.writestr(f"xl/worksheets/_rels/sheet{n}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/table" Target="../tables/table{tables}.xml"/></Relationships>')
                x += '<tableParts count="1"><tablePart r:id="rId1"/></tableParts>'
                types.append(f'<Override PartName="/xl/tables/table{tables}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"/>')
            z.writestr(f"xl/worksheets/sheet{n}.xml", x + "</worksheet>")
            types.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        names = "".join(f'<sheet name={quoteattr(s["name"])} sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{n}" Type="{_REL}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{rels}<Relationship Id="rIdS" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        own = "".join(f'<numFmt numFmtId="{k}" formatCode="{f}"/>' for k, f in ((164, "0.0%"), (165, "yyyy/mm/dd")))
        border = "<border><left/><right/><top/><bottom/></border><border>" + "".join(f'<{e} style="thin"/>' for e in ("left", "right", "top", "bottom")) + "</border>"
        xfs = "".join(f'<xf numFmtId="{k}" fontId="0" fillId="0" borderId="1" applyNumberFormat="1" applyAlignment="1"><alignment vertical="{v}" {h}wrapText="1"/></xf>' for k, v, h in ((0, "top", ""), (3, "top", ""), (4, "top", ""), (9, "top", ""), (164, "top", ""), (165, "top", ""), (0, "center", 'horizontal="center" ')))
        z.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="2">{own}</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="2">{border}</borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="7">{xfs}</cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{"".join(types)}</Types>')
    return buf.getvalue()


def document(blocks: Iterable[tuple[str, int | None, str]]) -> bytes:
    """A document from (kind, level, text) blocks; tables are lines with bars."""
    out = []

    def run(t: str) -> str:
        parts = _clean(t).split("\n")
        return "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in parts) + "</w:r>"

    def para(t: str, style: str = "") -> str:
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + (run(t) if t else "") + "</w:p>"

    for kind, level, text in blocks:
        text = text or ""
        if kind == "page":
            out.append(para(text.lstrip("# ").strip(), "Heading1"))
        elif kind == "heading":
            out.append(para(text or " ", f"Heading{level or 1}"))
        elif kind == "bullet":
            out.append(para(text, "ListBullet"))
        elif kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{para(c)}</w:tc>" for c in line.split("\t")) + "</w:tr>" for line in text.split("\n"))
            out.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>{rows}</w:tbl>')
        else:
            out.append(para(text))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{"".join(out)}</w:body></w:document>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
    return buf.getvalue()


SHEETS = "array<struct<name:string,table:string,rows:array<array<struct<i:bigint,d:double,dt:date,s:string,fmt:string>>>,merges:array<array<int>>,width:int,status:int>>"


def workbooks(files: DataFrame, file: str = "file") -> DataFrame:
    """(file, content): workbooks from rows of a file name and its ``sheets`` (see ``SHEETS``)."""

    def value(c: dict) -> tuple:
        v = next((c[k] for k in ("i", "d", "dt") if c[k] is not None), c["s"])
        return v, c["fmt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [workbook({**s, "rows": [[value(c) for c in r] for r in s["rows"] or []]} for s in sheets or []) for sheets in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[file, "content"])

    return files.select(file, F.col("sheets").cast(SHEETS).alias("sheets")).mapInArrow(run, f"`{file}` string, content binary")


def documents(blocks: DataFrame, key: str = "doc_id", per_volume: int = 20_000) -> DataFrame:
    """(key, volume, content): documents from block streams (``block``, ``kind``, ``level``, ``text``).

    A document of more than ``per_volume`` blocks becomes several volumes, numbered from 1, so that none has to fit into
    one task.
    """
    at = numbered(blocks.select(key, "block"), [key], ["block"], "__n").select(F.col(key).alias("__key"), F.col("block").alias("__block"), (F.floor((F.col("__n") - 1) / per_volume) + 1).cast("int").alias("volume"))
    placed = blocks.join(at, blocks[key].eqNullSafe(at["__key"]) & (blocks["block"] == at["__block"]))
    per = placed.groupBy(key, "volume").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "level", "text"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [document((x["kind"], x["level"], x["text"]) for x in bs) for bs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=[key, "volume", "content"])

    return per.select(key, "volume", "b").mapInArrow(run, f"`{key}` {blocks.schema[key].dataType.simpleString()}, volume int, content binary")


class OfficeFiles(DataSource):
    """``df.write.format("office_files").option("path", folder)``: rows of (file, content) to files, visible when all are written."""

    @classmethod
    def name(cls) -> str:
        return "office_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        names = []
        for r in rows:
            part = os.path.join(self.path, f".{r['file']}.part-{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r["content"])
            names.append((part, os.path.join(self.path, r["file"])))
        m = WriterCommitMessage()
        m.names = names  # type: ignore[attr-defined]
        return m

    def commit(self, messages: list) -> None:
        for m in messages:
            for part, final in m.names if m else ():
                os.replace(part, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.names if m else ():
                if os.path.exists(part):
                    os.remove(part)
