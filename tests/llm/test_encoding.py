"""Problem 6: chunks against whole texts, and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm.encoding import chunks_of, decode, default_vocabulary, encode, encoder, resync

WORDS = ["the", " table", "'s", "!!'", "it's", "  ", "\n\n", " ", "数式領域", "。", "1234", " 5", "é", "　", "<|endoftext|>", "---", "\t", "🙂", "ö̈"]


def text(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


def test_chunks_equal_whole(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.choice([0, 1, 5, 60, 400, 2000])), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "   ", "x"), (203, "a" * 5000, "x"), (204, "a" * 300 + " " + "b" * 900, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    enc = encoder(default_vocabulary())
    want = {r[0]: enc.encode_ordinary(r[1] or "") for r in rows}
    for chunk, overlap, spread in ((64, 32, 64), (64, 32, 1000), (300, 50, 1 << 18), (100000, 100, 1 << 18)):
        got = {r.doc_id: r.ids for r in encode(df, chunk=chunk, overlap=overlap, spread=spread).collect()}
        assert got == want
    pieces = {r.doc_id: r.chunks for r in chunks_of(df, chunk=64, overlap=32).collect()}
    assert sum(n > 1 for n in pieces.values()) > 60 and pieces[200] == pieces[201] == 0 and pieces[202] == pieces[203] == 1
    back = {r.doc_id: r.text for r in decode(encode(df, chunk=200, overlap=64)).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in decode(df).collect()} == {1: None, 2: ""}


def test_resync():
    assert resync("abc def ghi", 5) == 7
    assert resync("abcdefghi", 3) is None
    assert resync("x", 0) == 0


def test_overlap_bound(spark):
    with pytest.raises(ValueError):
        encode(spark.createDataFrame([], "doc_id bigint, text string"), chunk=10, overlap=6)


def test_skew_repeated_rows(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same text. " * 20).alias("text"))
    got = encode(df, chunk=50, overlap=25).groupBy("ids").count().collect()
    assert [r["count"] for r in got] == [300]
