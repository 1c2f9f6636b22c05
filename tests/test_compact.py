"""Problem 3 against a plain rule, and the packing against its bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators.compact import compact, first_fit_decreasing, manifest_of, pack, path_parts, verify

SCHEMA = "file_id bigint, doc_id string, page int, path string, text string, n_bytes bigint, sum string"


def test_paths(spark):
    cases = {
        "result/a/page_1.md": ["result", "a", "page_1.md"],
        "./result//a/./page_1.md": ["result", "a", "page_1.md"],
        "result/a/../a/page_1.md": ["result", "a", "page_1.md"],
        "D:\\ocr\\result\\a\\page_1.md": ["ocr", "result", "a", "page_1.md"],
        "file:///mnt/result/a/page_1.md": ["mnt", "result", "a", "page_1.md"],
        "../../page_1.md": ["page_1.md"],
        "": [],
    }
    df = spark.createDataFrame(list(cases), "string").toDF("p")
    assert {r.p: r.x for r in df.select("p", path_parts(F.col("p")).alias("x")).collect()} == cases


ROWS = [
    (5, "a", 1, "result/a/page_001.md", "x\r\ny", 1, "z"),
    (2, "a", 1, "result\\a\\page_001.md", "x\ny\n", 1, None),
    (3, "a", 1, "result/b/page_001.md", "x\ny", 1, None),
    (4, "a", 1, "result/a/page_001.md", None, 1, None),
    (6, "a", 1, "./result/a/page_001.md", None, 1, None),
    (7, "a", 1, "result/a/page_001.md", "", 1, None),
    (8, "a", 1, None, "same", 1, None),
    (9, "a", 1, None, "same", 1, None),
    (10, "a", 1, "result/a/merged.md", "no", 1, None),
    (11, "a", 1, "result/a/draft_page3_p02.md", "big" * 400, 1, None),
    (12, "a", 1, "result/a/notes.txt", None, 1, None),
]
KEPT = [2, 3, 4, 7, 8, 9, 11]


def test_records(spark, tmp_path):
    out = str(tmp_path / "out")
    done = compact(spark.createDataFrame(ROWS, SCHEMA), out, target=100, bins_per_group=2)
    assert sorted(r.file_id for r in done.collect()) == KEPT
    assert {r.file_id: r.text for r in done.collect()} == {r[0]: r[4] for r in ROWS if r[0] in KEPT}
    assert set(done.columns) == {"file_id", "doc_id", "page", "path", "text", "n_bytes", "sum", "bin"}
    with pytest.raises(RuntimeError):  # what is committed is never overwritten
        compact(spark.createDataFrame(ROWS, SCHEMA), out, target=100)


def test_empty(spark):
    assert compact(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_folder_holds_a_third(spark):
    rows = [(i, "d", 1, f"result/{'hot' if i % 3 == 0 else i % 50}/page_{i}.md", "t" * (i % 97), 1, None) for i in range(3000)]
    done = compact(spark.createDataFrame(rows, SCHEMA).repartition(5), target=4000, bins_per_group=4)
    assert done.count() == 3000
    per = [r.b for r in done.groupBy("bin").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert max(per) <= 4000
    total = sum(i % 97 for i in range(3000))
    assert len(per) <= total / 4000 * 1.25 + 1


def test_empty_texts_are_spread(spark):
    m = spark.range(5000).select(F.col("id").alias("file_id"), F.lit(0).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("sum"))
    packed, groups = pack(m, 1000, rows_per_group=500)
    per = [r["count"] for r in packed.groupBy("bin").count().collect()]
    assert groups == 10 and len(per) == 10 and max(per) < 700


def test_files_and_repeated_ids(spark, tmp_path):
    rows = [(i, "d", 1, f"result/f/page_{i}.md", "t" * 50, 1, None) for i in range(400)]
    out = str(tmp_path / "out")
    again = [(7, "d", 1, "result/f/page_7.md", "u", 1, None), rows[9]]
    done = compact(spark.createDataFrame(rows + again, SCHEMA).repartition(3), out, target=1000)
    assert sorted(r.file_id for r in done.collect()) == list(range(400))
    bins = spark.read.parquet(f"{out}/bins").collect()
    files = sorted(p.name for p in (tmp_path / "out" / "data").glob("*.parquet"))
    assert files == sorted(b.file for b in bins) and sum(b.rows for b in bins) == 400 and len(bins) == done.select("bin").distinct().count()
    assert max(b.rows for b in bins) <= 20 and len(files) <= 400 / 20 * 1.25 + 1


def test_stray_files_are_dropped(spark, tmp_path):
    from inkwell.operators.compact import _drop_strays

    folder = tmp_path / "data"
    spark.range(3).coalesce(1).write.parquet(str(folder))
    for junk in ("_SUCCESS", "._SUCCESS.crc", *(p.name for p in folder.glob(".*.crc"))):
        (folder / junk).unlink(missing_ok=True)
    name = next(folder.glob("*.parquet")).name
    (folder / "part-stray.parquet").write_bytes(b"x")
    _drop_strays(spark, str(folder), spark.createDataFrame([(name,)], "file string"), 1)
    assert [p.name for p in folder.glob("*.parquet")] == [name]


def test_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(0, 130, rng.integers(0, 80))
        b = first_fit_decreasing(s, 100)
        load = np.bincount(b, weights=s) if len(s) else np.array([])
        alone = {k for k, x in zip(b, s) if x > 100}
        assert all(load[k] <= 100 or k in alone for k in range(len(load)))
        assert (load <= 50).sum() <= 1 or not len(load)


def test_a_damaged_bin_is_seen(spark):
    files = spark.createDataFrame(ROWS, SCHEMA)
    m = pack(manifest_of(files), 100)[0].persist()
    good = files.join(m.select("file_id", "bin"), "file_id")
    assert verify(good, m) == len(KEPT)
    for bad in (good.where("file_id <> 3"), good.unionByName(good.where("file_id = 3")), good.withColumn("text", F.when(F.col("file_id") == 3, "x").otherwise(F.col("text")))):
        with pytest.raises(ValueError):
            verify(bad, m)
    m.unpersist()
