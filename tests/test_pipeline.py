"""Folders to outputs, arguments, names."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from inkwell.operators.figures import filtered
from inkwell.plans import pipeline as P

CELLS = [(1, 1, "都道府県", 1, 1), (1, 2, "数", 1, 2), (2, 1, "神奈川", 1, 1), (2, 2, "1,234", 1, 1), (2, 3, "○", 1, 1)]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def folders(tmp_path):
    write(tmp_path / "in" / "a" / "page_001.md", "# H\n\ntext $x$ と")
    write(tmp_path / "in" / "a" / "page_002.md", "|k|v|\n|---|---|\n|1|2|")
    write(tmp_path / "in" / "b" / "page_001.md", "only text\n\nsecond")
    table = {"tables": [{"cells": [{"row": r, "col": c, "contents": t, "row_span": rs, "col_span": cs} for r, c, t, rs, cs in CELLS]}], "paragraphs": [], "detections": [], "figures": []}
    write(tmp_path / "in" / "a" / "formats" / "json" / "page_images_page_001_p1.json", json.dumps(table))
    return str(tmp_path / "in" / "*")


def sheets_of(path):
    with zipfile.ZipFile(io.BytesIO(path.read_bytes())) as z:
        return z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()


def test_convert(spark, tmp_path):
    src = folders(tmp_path)
    for mode in ("table", "layout"):
        out = tmp_path / mode
        done = P.convert(spark, src, str(out), ("md", "csv", "xlsx", "docx"), mode, layouts="formats/json")
        assert set(done) == {"md", "review", "csv", "xlsx", "docx"}
        md = "".join(f.read_text() for f in sorted((out / "md" / "doc_id=a").glob("*.txt")))
        assert md == "# Page 1\n\n# H\ntext x と\n\n\n# Page 2\n\n|k|v|\n|---|---|\n|1|2|\n\n"
        assert sorted(p.name for p in (out / "xlsx").iterdir()) == ["a.xlsx", "b.xlsx"]
        book, sheet = sheets_of(out / "xlsx" / "a.xlsx")
        assert "<v>1234</v>" in sheet and ("神奈川" in book) == (mode == "table") and ("mergeCell" in sheet) == (mode == "layout")
        assert "本文" in sheets_of(out / "xlsx" / "b.xlsx")[0]
        csv = {p.name.split("=")[1]: "".join(f.read_bytes().decode() for f in sorted(p.glob("*.txt"))) for p in (out / "csv").glob("file=*")}
        assert csv["b__text"] == '"only text\nsecond"\r\n'  # cleaning leaves no blank line
        assert ("a__神奈川" in csv) == (mode == "table") and any('"1,234"' in x for x in csv.values())
        assert (out / "docx" / "b.docx").stat().st_size > 500


def test_arguments(spark):
    own, extra = P.split_args("sample.pdf --mode full -- --chunk-size 10 --end 3".split())
    assert own == ["sample.pdf", "--mode", "full"] and extra == ["--chunk-size", "10", "--end", "3"] and P.split_args(["a"]) == (["a"], [])
    assert P.with_flags(["--fallback-tesseract"], fallback_tesseract=True, force_tesseract_merge=True) == ["--fallback-tesseract", "--force-tesseract-merge"]
    assert P.RecognizerOptions().arguments() == ["--lite", "-d", "cpu", "--figure"] and P.RecognizerOptions("full", extra=("-x",)).arguments("json") == ["-d", "cpu", "-x"]
    rows = [("bosyuu", ["--label", "p3-9"]), ("bosyuu", ["--start", "9", "--end", "9"]), ("bosyuu", []), ("bosyuu", ["--start", "2"]), ("new", [])]
    i = spark.createDataFrame(rows, "stem string, args array<string>")
    assert [r.x for r in i.select(P.output_folder(F.col("stem"), F.col("args")).alias("x")).collect()] == ["bosyuu_p3-9", "bosyuu_p9-9", "bosyuu", None, "new"]
    f = spark.createDataFrame([("bosyuu_p9-9", 1), ("bosyuu_p2-4", 5), ("bosyuu_p2-8", 7)], "name string, mtime int")
    got = [(r.args, r.folder) for r in P.resolved_folders(i, f).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(rows[0][1], "bosyuu_p3-9"), (rows[1][1], "bosyuu_p9-9"), ([], "bosyuu_p2-8"), (["--start", "2"], "bosyuu_p2-8"), ([], "new")]))


def test_outputs(spark):
    f = spark.createDataFrame([("r/a/x.md", "a", 5), ("r/a/x.docx", "a", 5000), ("r/b/y.md", "b", 50)], "path string, folder string, size int")
    assert [r.path for r in P.collect_outputs(f, spark.createDataFrame([("a",), ("a",)], "folder string"), ["md", "docx"]).collect()] == ["r/a/x.docx", "r/a/x.md"]
    assert [r.path for r in P.self_test(f).collect()] == ["r/a/x.md"]
    refs = spark.createDataFrame([("./f/a.png",), ("f/b.png",)], "src string")
    got = {r.src: (r.file, r.placeholder) for r in P.placed_images(refs, spark.createDataFrame([("f/a.png",)], "path string")).collect()}
    assert got == {"./f/a.png": ("f/a.png", None), "f/b.png": (None, "[画像が見つかりません: f/b.png]")}
    b = spark.createDataFrame([("d", "page", "# Page 2"), ("d", "page", "# Page 3"), ("d", "paragraph", "9")], "doc_id string, kind string, text string")
    s = spark.createDataFrame([("d", 2, 2, "y"), ("d", 2, 1, "x")], "doc_id string, page int, rank int, name string")
    assert {r.page: r.images for r in P.images_at_headings(b, s).collect()} == {2: ["x", "y"], 3: None}


def test_filters():
    a = np.array([[0, 0, 0, 0], [0, 255, 255, 0], [0, 255, 9, 0], [0, 0, 0, 0]])
    assert filtered(a, "min").max() == 0 and filtered(a, "median")[1, 1] == 0
    assert filtered(a, "unsharp")[1, 1] == 255 and (filtered(np.full((3, 3), 7), "unsharp") == 7).all()
