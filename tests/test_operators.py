"""Lines, regions, figures, merging, logs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.operators import figures as FG
from inkwell.operators import lines as L
from inkwell.operators import merge as MG
from inkwell.operators import regions as R
from inkwell.streaming import progress as P


def lines(spark, texts, key="d"):
    return spark.createDataFrame([(key, i, t) for i, t in enumerate(texts, 1)], "doc_id string, line int, text string")


def test_islands_and_paragraphs(spark):
    df = lines(spark, ["|a|b|", "|c|d|", "x", "|e|f|", "", "y ", " z", "　", "w"])
    got = {(r.start, r.end) for r in L.islands(df, ["doc_id"], F.col("text").startswith("|")).collect()}
    assert got == {(0, 2), (3, 4)}
    assert [r.text for r in L.paragraphs(df, ["doc_id"]).orderBy("paragraph").collect()] == ["|a|b|\n|c|d|\nx\n|e|f|", "y\n z", "w"]


def test_fill_demote_limit(spark):
    df = lines(spark, ["# T", "# Page 1", "a", "# B", "# Page 2", "c"])
    assert [r.page for r in L.page_of_lines(df, ["doc_id"]).orderBy("line").collect()] == [None, 1, 1, 1, 2, 2]
    assert [r.text for r in L.demote(df, ["doc_id"]).orderBy("line").collect()] == ["# T", "# Page 1", "a", "## B", "# Page 2", "c"]
    df = lines(spark, ["", "", "", "a", " ", "", "", "", "b"])
    assert [r.line for r in L.limit_blanks(df, ["doc_id"]).orderBy("line").collect()] == [1, 2, 4, 5, 6, 9]


def test_blocks(spark):
    df = lines(spark, ["# Page 3", "## H", "a", "b", "", "c", "|x|y|", "|-|-|", "- i", "2) k", "![](f.png)", "<img broken"])
    got = [(r.kind, r.level, r.text) for r in L.blocks(df, ["doc_id"]).orderBy("first_line").collect()]
    assert got == [("page", 1, "# Page 3"), ("heading", 2, "H"), ("paragraph", None, "a b"), ("paragraph", None, "c"), ("table", None, "|x|y|\n|-|-|"), ("bullet", None, "i"), ("ordered", None, "2. k"), ("image", None, "![](f.png)"), ("paragraph", None, "<img broken")]
    ref = [r.src for r in L.image_references(lines(spark, ['a ![](m.png) <img src="h.png" width="2cm">']), "doc_id").orderBy("n").collect()]
    assert ref == ["h.png", "m.png"]


def greedy(ls, snippets):
    left, out = list(snippets), {}
    for n, t in ls:
        for s in left:
            if s[1] in t:
                out[s[0]] = n
                left.remove(s)
                break
    return out


def test_matching_against_loops(spark):
    rng = random.Random(2)
    ls, sn, want = [], [], {}
    for page in range(1, 9):
        texts = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(10)]
        snips = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([2, 3, 4])))) for k in range(1, 8)]
        ls += [("d", page, n, t) for n, t in enumerate(texts, 1)]
        sn += [("d", page, k, f"n{k}", t) for k, t in snips]
        want |= {(page, k): v for k, v in greedy(list(enumerate(texts, 1)), snips).items()}
    a = spark.createDataFrame(ls, "doc_id string, page int, line int, text string")
    b = spark.createDataFrame(sn, "doc_id string, page int, rank int, name string, text string")
    got = R.match_snippets(a, b).collect()
    assert len(got) == len(sn) and {(r.page, r.rank): r.line for r in got if r.line} == want


def test_insert_links(spark):
    a = spark.createDataFrame([("d", 1, 1, "# Page 1"), ("d", 1, 2, "x = 12"), ("d", 1, 3, "![eq](figures/eq_page001_09.png)"), ("d", 1, 4, "end")], "doc_id string, page int, line int, text string")
    b = spark.createDataFrame([("d", 1, 1, "a.png", "X=12"), ("d", 1, 2, "b.png", "none")], "doc_id string, page int, rank int, name string, text string")
    got = [r.text for r in R.insert_links(a, b).orderBy("line").collect()]
    assert got == ["# Page 1", "x = 12", "", "![eq](figures/a.png)", "", "end", "", "![eq](figures/b.png)", ""]


def test_regions(spark):
    page = [(1, [("比率 = 1/2", "p", [0, 0, 100, 50], None), ("12+3", None, [100, 50, 0, 0], 0.9), ("プレーン", None, [0, 0, 1, 1], 0.9)], [("3+44", [[0, 0], [9, 0], [9, 5], [0, 5]], None, 0.7, None), ("5+66", [[0, 0]], None, 0.9, None), None])]
    df = spark.createDataFrame(page, "page int, paragraphs array<struct<contents:string,role:string,box:array<int>,score:double>>, detections array<struct<content:string,points:array<array<int>>,box:array<int>,rec_score:double,det_score:double>>")
    c = R.candidates(df, "page")
    assert c.count() == 4
    top = R.top_regions(R.gate(c), ["page"], k=1).collect()
    assert [(r.text, r.box, r["rank"]) for r in top] == [("12+3", [0, 0, 100, 50], 1)]
    assert {r.text for r in R.gate(c).collect()} == {"12+3", "3+44"}


def test_refine(spark):
    ls = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["x = 12", "y = 3+4", "ただの文", "z = 9 - 1", "w"], 1)], "doc_id string, page int, line int, text string")
    fs = spark.createDataFrame([("d", 1, "$b$", False, 0.9, 20.0, 1), ("d", 1, "a", True, 0.9, 10.0, 2), ("d", 1, "low", True, 0.1, 1.0, 3)], "doc_id string, page int, latex string, isolated boolean, score double, y_center double, ord int")
    got = [r.text for r in R.refine_page(ls, fs).orderBy("line").collect()]
    assert got == ["$$\na\n$$", "ただの文", "$b$"]
    assert [tuple(r)[2:] for r in R.refine_counts(ls, fs).collect()] == [(2, 0)]


def test_merge(spark):
    files = spark.createDataFrame([("d", "r/d/page_002_p02.md", " b "), ("d", "r/d/page_002_p01.md", "a"), ("d", "r/d/x_page1.md", ""), ("d", "r/d/page3.md", "$c$ と"), ("d", "r/d/merged.md", "no"), ("d", None, "no"), ("d", "r/d/page_004.md", None)], "doc_id string, path string, text string")
    pages = MG.merge_parts(MG.parse_pages(files))
    assert {r.page: r.text for r in pages.collect()} == {2: "a\n\nb", 3: "$c$ と"}
    assert [r.section for r in MG.sections(pages).orderBy("page").collect()] == ["# Page 2\n\na\n\nb\n\n", "\n# Page 3\n\n$c$ と\n\n"]
    cleaned, issues = MG.merge(files)
    assert {r.page: r.text for r in cleaned.collect()}[3] == "c と"
    assert [(r.page, r.line, r.reason) for r in issues.collect()] == [(3, 1, "noisy_dollar")]


def test_folders(spark):
    f = spark.createDataFrame([("a_p1-2", 3), ("a", 5), ("a_b", 9), ("ab", 99)], "name string, mtime int")
    i = spark.createDataFrame([("a",), ("a_b",), ("z",)], "stem string")
    assert {r.stem: r.folder for r in MG.latest_folder(i, f).collect()} == {"a": "a_b", "a_b": "a_b", "z": None}
    b = spark.createDataFrame([("d", "x.md"), ("d", "y.XLSX"), ("e", "n.txt")], "doc_id string, name string")
    assert {r.doc_id: r.best for r in MG.best_files(b).collect()} == {"d": "y.XLSX"}


def test_renumber(spark):
    df = spark.createDataFrame([("d", n) for n in ["page_images_page_001_p1_figure_0.png", "page_001_p2_figure_0.JPG", "page_001_p1_figure_10.png", "page_001_p1_figure_2.png", "other.png"]], "doc_id string, name string")
    got = {r.old: r.new for r in FG.renumber(df).collect()}
    assert got["page_images_page_001_p1_figure_0.png"] == "fig_page001_01.png" and got["page_001_p1_figure_10.png"] == "fig_page001_03.png" and got["page_001_p2_figure_0.JPG"] == "fig_page001_04.jpg" and len(got) == 4


def test_statistics_and_decisions(spark):
    rng = np.random.default_rng(0)
    pics = {0: np.full((8, 8), 255), 1: rng.integers(0, 3, (8, 8)) * 2, 2: rng.integers(0, 256, (60, 60))}
    rows = [(k, int(a.shape[1]), int(a.shape[0]), int(v), int(v), int(v)) for k, a in pics.items() for v in a.ravel()]
    df = spark.createDataFrame(rows, "k int, width int, height int, r int, g int, b int")
    got = {r.k: r for r in FG.decide(FG.figure_statistics(df, ["k"])).collect()}
    for k, a in pics.items():
        assert got[k].unique_colors == len(np.unique(a)) and got[k].avg_std == pytest.approx(a.std(), abs=1e-3) and got[k].mean_luma == pytest.approx(a.mean(), abs=1)
    assert [got[k].decision for k in range(3)] == ["too_whitespace", "auto_drop", "keep"]
    assert got[0].removed and not got[2].removed
    few = FG.figure_statistics(df, ["k"], G.IconRules(max_color_samples=2)).where("k = 2").first()
    assert few.unique_colors == 0 and few.dominant_ratio == 0


def test_outlines():
    y, x = np.mgrid[:400, :400] - 200
    ring = np.where(np.abs(np.hypot(y, x) - 180) < 2, 0, 255)
    square = np.where(np.abs(np.maximum(abs(y), abs(x)) - 150) < 2, 0, 255)
    assert FG.outline_symbols([ring, square, np.full((20, 20), 255), np.where(y == 0, 0, 255)]) == ["○", "□", None, None]
    assert FG.outline_symbols([]) == []


def test_rings(spark):
    y, x = np.mgrid[:40, :40]
    ring = np.where(np.abs(np.hypot(y - 19.5, x - 19.5) - 17) < 1, 0, 255)
    pics = {0: ring, 1: np.full((20, 20), 255), 2: np.where(x[:20, :20] < 4, 0, 255), 3: ring[:6, :6]}
    rows = [(k, a.shape[1], a.shape[0], int(j), int(i), int(a[i, j])) for k, a in pics.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    got = {r.k: r for r in FG.ring_measures(spark.createDataFrame(rows, "k int, width int, height int, x int, y int, v int"), ["k"]).collect()}
    assert [got[k].ring for k in range(4)] == [True, False, False, False]
    assert got[2].left == 0.4 and got[2].right == 0 and got[2].ink == 0.2


def test_tone_curves(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 400)
    df = spark.createDataFrame([(1, int(v)) for v in a], "t int, v int")
    hist = np.bincount(a, minlength=256)
    cdf = np.clip(hist.cumsum().astype(float), 0, len(a) * 2 / 8)
    lut = np.floor((cdf - cdf.min()) / max(1, cdf.max() - cdf.min()) * 255 + 0.5)
    assert all(r.to == lut[r.v] for r in FG.tone_curves(df, ["t"]).collect())


def test_geometry(spark):
    df = spark.createDataFrame([("0.1,0.2,0.5,0.9",), ("0,0,0,1",), ("a,b",), ("-1,0,2,2",)], "t string").select(G.parse_crop(F.col("t")).alias("c"))
    got = [r.c and tuple(r.c) for r in df.collect()]
    assert got == [(0.1, 0.2, 0.5, 0.8), None, None, (0.0, 0.0, 1.0, 1.0)]
    one = spark.range(1).select(
        G.inner(F.array(*map(F.lit, (0, 0, 100, 50)))).alias("a"), G.inner(F.array(*map(F.lit, (0, 0, 2, 2)))).alias("b"), G.padded(F.array(*map(F.lit, (3, 3, 98, 98))), 6, F.lit(100), F.lit(100)).alias("c"),
        G.resized(F.lit(1200), F.lit(900), 2600).alias("d"), G.preview_size(F.lit(1200), F.lit(900), 600).alias("e"), G.median_threshold(F.array(*map(F.lit, (1, 2, 150, 160)))).alias("f"), G.gamma_curve(0.7).alias("g"),
    ).first()
    assert one.a == [18, 9, 82, 41] and one.b == [0, 0, 2, 2] and one.c == [0, 0, 100, 100] and one.d == [2600, 1949] and one.e == [600, 450] and one.f == 160
    assert one.g == [min(255, int((i / 255) ** (1 / 0.7) * 255 + 0.5)) for i in range(256)]
    with pytest.raises(ValueError):
        G.IconRules().with_(nope=1)
    with pytest.raises(KeyError):
        G.get_profile("nope")
    rules, unknown = G.IconRules.layered({"policy": "keep"}, '{"max_width": 5, "x": 1}')
    assert rules.policy == "keep" and rules.max_width == 5 and unknown == ["x"]


T0 = dt.datetime(2024, 1, 1)
STAGES = [("--- merge を実行 ---", 92.0)]
LOG = [("j", 0, 0, "処理範囲: 1〜4"), ("j", 1, 1, "--- Page 1/4 (abs 1/9) ---"), ("j", 2, 11, "--- Done 1/4 ---"), ("j", 3, 12, "--- Page 2/4 ---"), ("j", 4, 32, "--- Done 2/4 ---"), ("j", 4, 32, "--- Done 2/4 ---"), ("j", 5, 40, "--- Done 1/4 ---"), ("j", 6, 41, "--- merge を実行 ---"), ("j", 7, None, None), ("k", 0, 0, "")]


def log(spark):
    return spark.createDataFrame([(j, s, None if t is None else T0 + dt.timedelta(seconds=t), x) for j, s, t, x in LOG], "job_id string, seq bigint, ts timestamp, line string")


def test_progress(spark):
    got = [(r.seq, r.progress, r.eta_seconds) for r in P.progress(log(spark), stages=STAGES).orderBy("job_id", "seq").collect()]
    assert got == [(2, 22.5, 30), (4, 45.0, 30), (5, 45.0, 45), (6, 92.0, None)]


def test_progress_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log(spark).where("seq <= 3").coalesce(1).write.parquet(src)
    stream = P.progress_stream(spark.readStream.schema(log(spark).schema).parquet(src), STAGES)

    def run():
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, k: b.write.mode("append").parquet(out)).start()
        q.awaitTermination()

    run()
    log(spark).where("seq between 2 and 6").coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted((r.progress, r.eta_seconds, r.lines) for r in spark.read.parquet(out).where("job_id = 'j'").collect())
    assert got == [(22.5, None, 4), (92.0, None, 3)]  # lines that came again changed nothing
