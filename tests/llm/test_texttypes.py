"""Problem 5: statistics against plain counts, the learning against planted accuracies, held-out judgements."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import texttypes as t

SCHEMA = "src string, row_id bigint, order timestamp, text string, kind string"
T0 = dt.datetime(2024, 1, 1)
PROSE = "The table on the next page shows how the queue stores a private buffer. When a cursor is read, the margin of every page grows."
CASES = {
    "prose": [PROSE, "この章では、表計算によって標準的なセル範囲を変換する手順を説明する。\n一般に、列幅は余白よりも小さい。", "Die Zähler löscht die Länge für jede Gebühr und während der Leitung auch die Vorlage."],
    "list": ["- buffer\n- nested queue\n- long-term router", "1.1  公開鍵の段落\n1.2  行列の余白\n2.1  原稿の列幅", "スキーマの行列\n公開鍵の段落\n固有の主キー\n段落の分散"],
    "table": ["queue\tmargin\tratio\n120\t2.5\t33%\n48\t510\t6", "| local queue | margin |\n|---|---|\n| 1200 | 20.5 |\n| 33 | 4.25 |", "alpha,beta,gamma\n12,3.5,99\n7,8,2020/01/02"],
    "formula": ["x^2 + b^2 ≒ 37", "$k_{2} = \\frac{30.40}{81495}$", "行列 ÷ 余白 = 12.5"],
    "junk": ["□□□□□□□□□□□□", "@# ~~ {[ <>| ^^ §§ ]", "zzzzvvvvwwwwkkk\nqqqqqqxxxxx", "x 7 K q 9 zT 4 b R 2 w"],
}


def common(spark):
    return spark.createDataFrame([(w,) for w in "the on a of every is when how next die für jede und der auch".split()], "word string")


def frame(spark, times=4):
    rows = [("regions", 100 * k + j, T0, x, kind) for kind, xs in CASES.items() for k, x in enumerate(xs * times) for j in (list(CASES).index(kind) * 10_000,)]
    return spark.createDataFrame(rows, SCHEMA)


def test_types(spark):
    df = frame(spark)
    got = {r.row_id: r.kind for r in t.classify(df, common(spark)).collect()}
    want = {r.row_id: r.kind for r in df.collect()}
    assert got == want
    assert "formula" not in {r.kind for r in t.classify(df, common(spark), {"regions": ("formula",)}).collect()}


def test_odd_input(spark):
    rows = [("regions", 1, T0, None, "x"), ("regions", 2, T0, "", "x"), ("regions", 3, T0, " \n ", "x"), ("regions", 4, T0, "old - text", "x"), ("regions", 4, T0 + dt.timedelta(1), PROSE, "x"), ("regions", 5, None, PROSE * 3000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r for r in t.classify(df, common(spark)).collect()}
    assert set(got) == {4, 5} and got[4].kind == got[5].kind == "prose"
    assert t.classify(df.limit(0), common(spark)).count() == 0


def test_statistics(spark):
    text = "The queue, it stops.\n12 % of 40\n\n- the end!"
    made = spark.createDataFrame([(text,)], "text string").select("text", *[c.alias(k) for k, c in t.parts(F.col("text")).items()])
    s = made.select(*[c.alias(k) for k, c in t.statistics(F.col("text"), ["the", "of", "it"]).items()]).first()
    words = ["the", "queue", "it", "stops", "12", "of", "40", "-", "the", "end"]
    assert s.n_words == len(words) and s.n_lines == 3
    assert s.mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    assert s.ending_lines == pytest.approx(2 / 3)
    assert s.common_words == pytest.approx(4 / 7)
    assert s.symbol_ratio == pytest.approx(1 / len("".join(text.split())))  # the !
    assert s.item_lines == pytest.approx(1 / 3)


def test_learning_recovers_planted_types():
    rng = np.random.default_rng(0)
    fs = t.labelling_functions()
    truth = rng.integers(0, 5, 6000)
    p = np.array([[0.75 if c == x else 0.06 for _, c, _ in fs] for x in t.TYPES])
    votes = (rng.random((6000, len(fs))) < p[truth]).astype(float)
    pats, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = t.learn(pats, n.astype(float), t.TYPES)
    assert (post.argmax(1)[inv.ravel()] == truth).mean() > 0.9


def test_page_texts(spark):
    det = "array<struct<content:string,points:array<array<int>>,box:array<int>>>"
    rows = [(1, T0, [("head", None, [0, 100, 1, 1]), ("a", [[0, 400], None], None), None, (None, None, None), ("b", None, None), ("9", None, [0, 3400, 1, 1])]), (2, T0, None), (3, T0, [])]
    got = {r.layout_id: r.text for r in t.page_texts(spark.createDataFrame(rows, f"layout_id bigint, ingested_at timestamp, detections {det}")).collect()}
    assert got == {1: "a\nb", 2: None, 3: ""}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_judgements(spark):
    from inkwell.llm import queries as q

    d = "/root/testdata/sf0.01"
    got = q.p5_types(spark, d)
    both = spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("kind", "want").join(got, ["src", "row_id"])
    n, good = both.agg(F.count(F.lit(1)), F.sum((F.col("want") == F.col("kind")).cast("int"))).first()
    assert n > 100 and good / n >= 0.95
