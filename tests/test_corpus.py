"""Queries of the corpus over small tables written for the case."""

import datetime as dt

from inkwell.plans import corpus as Q

AT = dt.datetime(2025, 1, 1)


def tables(spark, path, **rows):
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_all_regions_of_a_page_are_linked(spark, tmp_path):
    lines = ["x = 12", "a longer line of this page", "y = 34", "z = 56", "w = 78"]
    regions = [(1, "x = 12", 0.9), (2, "nowhere", 0.8), (3, "y=34", 0.7), (4, "z=56", 0.6), (5, "longer line", None), (6, "", 0.9), (7, None, 0.9)]
    d = tables(
        spark, tmp_path,
        regions=([(k, "d", 1, t, s, AT) for k, t, s in regions] + [(4, "d", 1, "z=56", 0.6, AT)], "region_id bigint, doc_id string, page int, text string, score double, seen_at timestamp"),
        layout_json=([(1, "d", 1, [(x,) for x in lines], AT)], "layout_id bigint, doc_id string, page int, detections array<struct<content:string>>, ingested_at timestamp"),
    )
    assert {(r.line, r["rank"]) for r in Q.snippet_candidates(spark, d).collect()} == {(1, 1), (2, 5), (3, 3), (4, 4)}
    assert {r["rank"]: r.line for r in Q.snippet_matches(spark, d).collect()} == {1: 1, 2: None, 3: 3, 4: 4, 5: 2}
    links = [r.text for r in Q.linked_pages(spark, d).orderBy("line").collect() if r.text]
    at = lambda k: f"![eq](figures/eq_page001_{k:02d}.png)"
    assert links == [lines[0], at(1), lines[1], at(5), lines[2], at(3), lines[3], at(4), lines[4], at(2)]


def test_all_files_of_a_part_are_merged(spark, tmp_path):
    files = [
        (1, "r/d/page10_p01.md", ""),  # an empty listing of the file below
        (2, "./r//d/page10_p01.md", "比率 = 1/2"),
        (3, "r/d/draft_page10_p01.md", "draft"),
        (4, "r/d/page10_p01.md", "比率 = 1/2\r\n"),  # listed again
        (5, "r/d/page10_p02.md", "draft"),  # the same text in another part
        (6, "r/d/page10_p01.md", "新しい"),  # the same file with another text
        (7, "r/d/page_011.md", "eleven"),
        (8, "r/d/page_011.md", None),
    ]
    d = tables(spark, tmp_path, page_files=([(k, "d", None, None, p, t) for k, p, t in files], "file_id bigint, doc_id string, page int, part int, path string, text string"))
    ten = "draft\n\n新しい\n\n比率 = 1/2\n\ndraft"
    assert {r.page: r.text for r in Q.merged_pages(spark, d).collect()} == {10: ten, 11: "eleven"}
    assert [r.section for r in Q.merged_sections(spark, d).orderBy("page").collect()] == [f"# Page 10\n\n{ten}\n\n", "\n# Page 11\n\neleven\n\n"]
    assert [(r.page, r.line, r.reason) for r in Q.page_issues(spark, d).collect()] == [(10, 5, "fraction_like")]


def test_whole_logs(spark, tmp_path):
    log = [("a", k, f"line {k}") for k in range(1, 231)] + [("a", 7, "line 7"), ("b", 1, "stderr: no page"), ("b", 2, None), ("b", 3, ""), ("b", 3, "")]
    d = tables(spark, tmp_path, progress_log=(log, "job_id string, seq bigint, line string"))
    assert sorted(tuple(r) for r in Q.job_tail(spark, d).collect()) == [("a", k) for k in range(31, 231)] + [("b", 1), ("b", 2), ("b", 3)]
    want = [("a", k, f"line {k}") for k in range(1, 231)] + [("b", 1, "[err] stderr: no page"), ("b", 3, "")]
    assert sorted((r.job_id, r.seq, r.line) for r in Q.marked_log(spark, d).collect()) == want
