"""Tables: the golden case, and grids, signatures and segments against plain loops."""

import random

from pyspark.sql import functions as F

from inkwell.operators import tables as T
from inkwell.sinks.files import csv_line, segment_lines

SCHEMA = "doc_id string, page int, table_no int, idx int, row int, col int, text string, row_span int, col_span int, r string"
GOLD = [(1, 1, "都道府県", 2, 1), (1, 2, "学校名", 2, 1), (1, 3, "募集状況", 1, 2), (2, 3, "国語", 1, 1), (2, 4, "数学", 1, 1), (3, 1, "神奈川", 2, 1), (3, 2, "A校", 1, 1), (3, 3, "○", 1, 1), (4, 2, "B校", 1, 1), (4, 4, "○", 1, 1),
        (5, 1, "東京", 3, 1), (5, 2, "採用情報", 1, 3), (6, 2, "C校", 1, 1), (6, 3, "○", 1, 1), (7, 2, "D校", 1, 1), (7, 4, "○", 1, 1)]


def frame(spark, tables):
    return spark.createDataFrame([("d", 1, k, i, *c, None) for k, cells in enumerate(tables) for i, c in enumerate(cells)], SCHEMA)


def test_golden(spark):
    s = {r.segment: r for r in T.sheets(frame(spark, [GOLD])).collect()}
    assert [s[k].sheet for k in (1, 2)] == ["神奈川", "東京"]
    assert (s[1].header_rows, s[1].data_rows, s[2].header_rows, s[2].data_rows) == ([1, 2], [3, 4], [5], [6, 7])
    assert s[1].header == ["都道府県", "学校名", "募集状況 / 国語", "募集状況 / 数学"]
    assert s[1].data == [["神奈川", "A校", "○", ""], ["神奈川", "B校", "", "○"]]
    assert s[2].header == ["東京", "採用情報", "採用情報_2", "採用情報_3"]
    sig = {r.r: r.signature for r in T.rows_of(frame(spark, [GOLD])).collect()}
    assert [sig[k] for k in range(1, 8)] == [[1, 1, 2], [1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 1], [1, 3], [1, 1, 1, 1], [1, 1, 1, 1]]
    lines = [r.value for r in segment_lines(T.sheets(frame(spark, [GOLD]))).where("file like '%神奈川'").orderBy("line").collect()]
    assert lines == ["都道府県,学校名,募集状況 / 国語,募集状況 / 数学", "神奈川,A校,○,", "神奈川,B校,,○"]


SYMBOLS = set("○〇◯◎△▲▼×✕xX□■●Oo0口")


def loops(cells):
    """Segments of one table by plain loops: [(header rows, data rows)]."""
    cells = [(r or 1, c or 1, (t or "").strip(), max(1, rs or 1), max(1, cs or 1)) for r, c, t, rs, cs in cells]
    h, w = max(r + rs - 1 for r, c, t, rs, cs in cells), max(c + cs - 1 for r, c, t, rs, cs in cells)
    owner, value = {}, {}
    for i, (r, c, t, rs, cs) in enumerate(cells):
        for y in range(r, r + rs):
            for x in range(c, c + cs):
                owner.setdefault((y, x), i)
                value[y, x] = value.get((y, x)) or t
    rows = []
    for y in range(1, h + 1):
        vs = [value.get((y, x), "") for x in range(1, w + 1)]
        if not any(vs):
            rows.append(None)
            continue
        sig, last = [], None
        for x in range(1, w + 1):
            o = owner.get((y, x), -x)
            if sig and o == last:
                sig[-1] += 1
            else:
                sig.append(1)
            last = o
        rows.append((sig, any(v in SYMBOLS for v in vs)))
    runs = []
    for y, row in enumerate(rows, 1):
        if row and y > 1 and rows[y - 2] and rows[y - 2][0] == row[0]:
            runs[-1].append(y)
        elif row:
            runs.append([y])
    out, pending = [], []
    marked = any(r and r[1] for r in rows)
    longest = max(map(len, runs), default=0)
    for run in runs:
        first = next((y for y in run if rows[y - 1][1]), None) if marked else (run[0] if len(run) == longest else None)
        if first is None:
            pending += run
        else:
            out.append((pending + [y for y in run if y < first], [y for y in run if y >= first]))
            pending = []
    return out


def test_segments_against_loops(spark):
    rng = random.Random(5)
    tables = []
    for _ in range(40):
        texts = ["a", "b", "", " ", None, "12"] + (["○", "x", "口"] if rng.random() < 0.5 else [])
        tables.append([(rng.choice([None, *range(1, 7)]), rng.randint(1, 4), rng.choice(texts), rng.choice([None, 0, 1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, -1])) for _ in range(rng.randint(1, 14))])
    got = {}
    for r in T.segments_of(T.rows_of(frame(spark, tables))).orderBy("table_no", "segment", "r").collect():
        got.setdefault(r.table_no, {}).setdefault(r.segment, {"header": [], "data": []})[r.role].append(r.r)
    for k, cells in enumerate(tables):
        want = loops(cells)
        assert [(s["header"], s["data"]) for _, s in sorted(got.get(k, {}).items())] == want, (k, cells)


def test_signatures_cover_the_width(spark):
    rows = T.rows_of(frame(spark, [GOLD])).select("max_col", F.aggregate("signature", F.lit(0), lambda a, x: a + x).alias("n"))
    assert all(r.n == r.max_col for r in rows.collect())


def test_layout_rows(spark):
    cells = [(1, 1, "a", 1, 1), (3, 2, "b", 1, 1), (5, 4, "", 1, 1)]
    got = [(r.r, r.values) for r in T.layout_rows(frame(spark, [cells])).orderBy("r").collect()]
    assert got == [(1, ["a", ""]), (2, ["", ""]), (3, ["", "b"])]


def test_unique_names(spark):
    names = ["a", "a", "a_2", "b", "a", "b", "a_2", "c" * 40, "c" * 40]
    df = spark.createDataFrame([("g", i, n[:31]) for i, n in enumerate(names)] + [("h", 0, "a")], "g string, i int, n string")
    used, want = set(), []
    for n in names:
        n, k = n[:31], 1
        name = n
        while name in used:
            k += 1
            name = n[: 31 - len(f"_{k}")] + f"_{k}" if len(n) + len(f"_{k}") > 31 else n + f"_{k}"
        used.add(name)
        want.append(name)
    got = {(r.g, r.i): r.u for r in T.unique_names(df, ["g"], ["i"], "n", "u", 31).collect()}
    assert [got["g", i] for i in range(len(names))] == want and got["h", 0] == "a"


def test_hot_name(spark):
    df = spark.range(3000).selectExpr("'g' as g", "id as i", "if(id % 3 = 0, 'x', concat('n', id)) as n")
    got = T.unique_names(df, ["g"], ["i"], "n", "u", 31)
    assert got.select("u").distinct().count() == 3000


def test_empty(spark):
    e = frame(spark, [GOLD]).limit(0)
    assert T.sheets(e).count() == T.layout_rows(e).count() == T.grid(e).count() == 0


def test_csv_quotes(spark):
    df = spark.createDataFrame([(['a,b', 'c"d', "e\nf", "g"],)], "v array<string>")
    assert df.select(csv_line(F.col("v")).alias("x")).first().x == '"a,b","c""d","e\nf",g'
