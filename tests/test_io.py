"""Readers and writers, with files."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from inkwell.operators import tables as T
from inkwell.sinks import files as W
from inkwell.sinks import office as O
from inkwell.sources import files as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_pages_and_listing(spark, tmp_path):
    write(tmp_path / "doc_a" / "page_002.md", "two\nlines")
    write(tmp_path / "doc_a" / "page_001_p02.md", "one b")
    write(tmp_path / "doc_a" / "page_001_p01.md", "one a")
    write(tmp_path / "doc_a" / "notes.txt", "no")
    got = [(r.doc_id, r.page, r.part, r.text) for r in S.read_pages(spark, str(tmp_path / "*" / "*")).orderBy("page", "part").collect()]
    assert got == [("doc_a", 1, 1, "one a"), ("doc_a", 1, 2, "one b"), ("doc_a", 2, 0, "two\nlines")]
    kinds = {r.name: (r.kind, r.note) for r in S.inspect(S.list_files(spark, str(tmp_path))).collect()}
    assert kinds["notes.txt"] == ("unsupported", "unsupported")
    wanted = spark.createDataFrame([("/nope.png",)], "path string")
    assert S.inspect(S.list_files(spark, str(tmp_path)), wanted).first().note == "not found"


def test_layouts(spark, tmp_path):
    page = {"tables": [{"cells": [{"row": 1, "col": 2, "contents": " x ", "box": [1, 2, 3, 4]}, None]}, {"cells": []}], "paragraphs": [], "detections": [{"content": "a", "points": [[1, 2]]}]}
    write(tmp_path / "d" / "page_images_page_003_p1.json", json.dumps(page))
    write(tmp_path / "d" / "page_images_page_004_p1.json", "{broken")
    write(tmp_path / "d" / "other.json", "{}")
    df = S.read_layouts(spark, str(tmp_path / "d"))
    assert [(r.page, r.detections is None) for r in df.collect()] == [(3, False), (4, True)]
    c = T.defaults(S.layout_cells(df)).collect()
    assert [(r.page, r.table_no, r.idx, r.row, r.col, r.row_span, r.text) for r in c] == [(3, 0, 0, 1, 2, 1, "x")]


def test_page_names(spark):
    names = ["page_images_page_007_p1.json", "x_page_3.png", "page12.png", "none.png"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", S.page_of_name(F.col("n")).alias("p")).orderBy("i")
    assert [r.p for r in df.collect()] == [7, 3, 12, None]
    one = spark.createDataFrame([("a", None), ("b", None), ("b", 2)], "doc_id string, page int")
    assert sorted(((r.doc_id, r.page) for r in S.default_page(one).collect()), key=str) == [("a", 1), ("b", 2), ("b", None)]


def test_csv_and_html(spark):
    csv = 'a,"b,c"\n1,2\n\n , \nonly\nlines\n\nx,y\n'
    df = spark.createDataFrame([("d", 1, csv), ("e", 1, None), ("f", 1, "")], "doc_id string, page int, text string")
    got = [(r.table_no, r.row, r.col, r.text) for r in S.table_files(df, "csv", tables_only=True).orderBy("table_no", "row", "col").collect()]
    assert got == [(0, 1, 1, "a"), (0, 1, 2, "b,c"), (0, 2, 1, "1"), (0, 2, 2, "2"), (1, 1, 1, "x"), (1, 1, 2, "y")]
    assert {r.table_no for r in S.table_files(df, "csv").collect()} == {0, 1, 2}
    html = "<table><tr><td>d1</td><th rowspan=2>h</th></tr><tr><td colspan='2'>w &amp; x</td><td>y</td></tr></table><p><table><tr><td>2"
    cells = S.parse_html_tables(html)
    assert cells[0] == [(1, 1, "h", 2, 1), (1, 2, "d1", 1, 1), (2, 2, "w & x", 1, 2), (2, 4, "y", 1, 1)]
    assert cells[1] == [(1, 1, "2", 1, 1)]
    assert S.parse_html_tables("<p>none</p>") == []


def test_rules():
    text = json.dumps([{"pattern": "a+", "replacement": "$1\\n"}, {"pattern": "(", "replacement": ""}, {"replacement": "x"}, 5, {"pattern": "b", "replacement": "", "flags": ["IGNORECASE"]}])
    assert S.load_rules(text) == [("(?U)a+", "\\$1\\\\n"), ("(?iU)b", "")]
    assert S.load_rules("{") == [] and S.load_rules("{}") == []


def test_sections_are_written_in_order(spark, tmp_path):
    rows = [("d", p, f"<{p}>\n\n") for p in range(1, 60)] + [("e", 1, "x\n\n")]
    W.write_sections(spark.createDataFrame(rows, "doc_id string, page int, section string").repartition(7), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "doc_id=d").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == "".join(f"<{p}>\n\n" for p in range(1, 60))
    with pytest.raises(RuntimeError):
        W.write_sections(spark.createDataFrame(rows, "doc_id string, page int, section string"), str(tmp_path / "out"))
    W.write_sections(spark.createDataFrame(rows[-1:], "doc_id string, page int, section string"), str(tmp_path / "out"), overwrite=True)
    assert [p.name for p in (tmp_path / "out").glob("doc_id=*")] == ["doc_id=e"]


def test_issues_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "r", "t")], "page int, line int, reason string, text string")
    assert W.write_issues(df, str(tmp_path / "r")) and not W.write_issues(df.limit(0), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()
    W.append_log(df, str(tmp_path / "log"))
    W.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def sheet_xml(content, n):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))  # all parts are well formed
        return z.read(f"xl/worksheets/sheet{n}.xml").decode(), z.namelist()


def test_workbook():
    content = O.workbook([
        {"name": "A<1>", "rows": [["h1", "h2"], [(1234, "#,##0"), ("<x>", None)], [(0.5, "0%"), None]], "table": "t_1", "status": 5, "widths": {1: 18}},
        {"name": "B", "rows": [["m", ""], ["", ""]], "merges": [(1, 1, 2, 2), (1, 1, 1, 1)], "links": {"A1": "'A'!A1"}},
    ])
    x, names = sheet_xml(content, 1)
    assert "<v>1234</v>" in x and "&lt;x&gt;" in x and "tablePart" in x and 'sqref="E2:E3"' in x and "xl/tables/table1.xml" in names
    y, _ = sheet_xml(content, 2)
    assert 'mergeCell ref="A1:B2"' in y and 'count="1"' in y and "hyperlink" in y
    assert sheet_xml(O.workbook([]), 1)


def test_workbooks_and_documents(spark, tmp_path):
    cell = lambda s: f"named_struct('i', cast(null as bigint), 'd', cast(null as double), 'dt', cast(null as date), 's', '{s}', 'fmt', cast(null as string))"
    df = spark.sql(f"select 'a.xlsx' as file, array(named_struct('name', 'S', 'table', 'T', 'rows', array(array({cell('h')}), array({cell('v')})), 'merges', cast(null as array<array<int>>), 'width', 1, 'status', cast(null as int))) as sheets")
    made = O.workbooks(df)
    spark.dataSource.register(O.OfficeFiles)
    made.write.format("office_files").option("path", str(tmp_path / "x")).mode("append").save()
    x, _ = sheet_xml((tmp_path / "x" / "a.xlsx").read_bytes(), 1)
    assert ">v<" in x
    blocks = spark.createDataFrame([("d", 1, "page", 1, "# Page 1"), ("d", 2, "paragraph", None, "a & b"), ("d", 3, "table", None, "x\ty"), ("d", 4, "bullet", None, "i")], "doc_id string, block int, kind string, level int, text string")
    content = O.documents(blocks).first().content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        doc = z.read("word/document.xml").decode()
    assert "a &amp; b" in doc and "Page 1" in doc and "<w:tbl>" in doc and "oMath" not in doc


def test_meta_and_preview(spark):
    df = spark.createDataFrame([("d", 1, "A"), ("d", 2, "B")], "doc_id string, segment_no int, sheet string")
    rows = [(r.key, r.value) for r in W.meta_rows(df, ["doc_id"], input="f.pdf").orderBy("n").collect()]
    assert rows == [("input", "f.pdf"), ("sheets", "2"), ("sheet", "#'A'!A1"), ("sheet", "#'B'!A1")]
    img = spark.createDataFrame([(bytearray(b"\x89PNG"),)], "content binary")
    assert W.preview(img).first().url == "data:image/png;base64,iVBORw=="


def test_png_size(spark):
    import base64

    from inkwell.operators.figures import png_size

    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAUAAAAHCAYAAADAp4fuAAAADUlEQVR4nGNgGAWkAgABNgAB")
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"GIF")), (3, None)], "i int, content binary").select("i", png_size(F.col("content")).alias("s")).orderBy("i")
    got = [r.s for r in df.collect()]
    assert (got[0].width, got[0].height, got[0].area) == (5, 7, 35) and got[1] is None and got[2] is None


def test_recognizer_slot(spark):
    def load():
        return lambda pdf: pdf.assign(text=pdf["name"].str.upper())[["name", "text"]]

    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {tuple(r) for r in S.recognized(df, load, "name string, text string").collect()} == {("a", "A"), ("b", "B")}


def test_documents_have_volumes(spark):
    rows = [("hot", k, "paragraph", None, f"t{k}") for k in range(25)] + [("a", 3, "paragraph", None, "x"), (None, 1, "paragraph", None, "y")]
    made = O.documents(spark.createDataFrame(rows, "doc_id string, block int, kind string, level int, text string"), per_volume=10).collect()
    assert sorted(map(str, ((r.doc_id, r.volume) for r in made))) == sorted(map(str, [("hot", 1), ("hot", 2), ("hot", 3), ("a", 1), (None, 1)]))
    texts = {r.volume: zipfile.ZipFile(io.BytesIO(r.content)).read("word/document.xml").decode() for r in made if r.doc_id == "hot"}
    assert "t0<" in texts[1] and "t9<" in texts[1] and "t10<" in texts[2] and "t24<" in texts[3]


def test_pdf_pages(spark):
    rows = [(1, b"%PDF-1.4 << /Type /Page /x >> << /Type/Page>> << /Type /Pages >>"), (2, b"%PDF-1.7 << /Type /Pages /Kids [] /Count 12 >>"), (3, b"%PDF-1.7 xx"), (4, b"PK"), (5, None), (6, b"")]
    got = {r.i: (r.p.pages, r.p.note) for r in spark.createDataFrame(rows, "i int, c binary").select("i", S.pdf_page_count(F.col("c")).alias("p")).collect()}
    assert got == {1: (2, None), 2: (12, None), 3: (None, "no pages found"), 4: (None, "no PDF"), 5: (None, "no PDF"), 6: (None, "no PDF")}
