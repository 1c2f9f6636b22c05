"""Queries over the pages, lines, cells, regions and logs of a corpus, one per operator or small group of operators.

Every query runs over its whole tables. Its SQL stands next to it in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import cells as C
from ..functions import formulas as M
from ..functions import geometry as G
from ..functions import text as T
from ..operators import figures as FG
from ..operators import lines as L
from ..operators import merge as MG
from ..operators import regions as R
from ..operators import tables as TB
from ..operators.compact import path_parts, with_record
from ..operators.delivery import latest_delivery
from ..session import read
from ..sinks.files import segment_lines
from ..sources.files import page_of_name, table_files
from ..streaming import progress as P


def docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text is not null")


def doc_lines(s: SparkSession, d: str) -> DataFrame:
    return L.explode_lines(docs(s, d), "doc_id")


def cells(s: SparkSession, d: str) -> DataFrame:
    return latest_delivery(read(s, d, "cells"), "cell_id", "seen_at")


def layouts(s: SparkSession, d: str) -> DataFrame:
    return latest_delivery(read(s, d, "layout_json"), "layout_id", "ingested_at")


def regions(s: SparkSession, d: str) -> DataFrame:
    return latest_delivery(read(s, d, "regions"), "region_id", "seen_at")


def page_parts(s: SparkSession, d: str) -> DataFrame:
    """Page parts of the listing, each record once as in problem 3: same folder, file name and text (line ends aside).

    Other files of a part stay, and other texts of a file. ``path`` is the folder and file name, however it was spelled.
    """
    parsed = with_record(MG.parse_pages(read(s, d, "page_files").drop("page", "part").where("text is not null")))
    one = parsed.groupBy("__record").agg(F.min("file_id").alias("file_id"))
    return parsed.join(one, ["__record", "file_id"], "left_semi").select("doc_id", "page", "part", F.concat_ws("/", "__folder", "__name").alias("path"), "text")


# ---- lines and predicates


def math_issue_lines(s: SparkSession, d: str) -> DataFrame:
    return MG.math_issues(docs(s, d), ["doc_id"], script=r"[A-Za-zÀ-ÿ\x{3040}-\x{9FFF}]")


def math_issue_counts(s: SparkSession, d: str) -> DataFrame:
    return math_issue_lines(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def region_issues(s: SparkSession, d: str) -> DataFrame:
    return MG.math_issues(regions(s, d).where("text is not null"), ["region_id"])


def math_features(s: SparkSession, d: str) -> DataFrame:
    f = M.math_features(F.col("text"))
    return doc_lines(s, d).where("text <> ''").select("doc_id", "line", f["ops"].alias("ops"), f["digits"].alias("digits"), F.bround(f["digit_ratio"], 6).alias("digit_ratio"), f["has_base"].alias("has_base"))


def looks_math_lines(s: SparkSession, d: str) -> DataFrame:
    return doc_lines(s, d).where(M.looks_math(F.col("text"))).select("doc_id", "line", "text")


def math_docs(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.coalesce(M.has_math(F.col("text")), F.lit(False)).alias("has_math"))


def formula_block_islands(s: SparkSession, d: str) -> DataFrame:
    return L.islands(doc_lines(s, d), ["doc_id"], M.formula_block(F.col("text"))).select("doc_id", F.col("start").cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"), "n_lines")


def repeat_runs(s: SparkSession, d: str) -> DataFrame:
    r = L.runs(doc_lines(s, d), ["doc_id"], "line", F.col("text"))
    return r.groupBy("doc_id", "run").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "first_line", "n")


def sparse_docs(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", M.sparse(F.col("text")).alias("sparse"))


def paragraphs(s: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(doc_lines(s, d), ["doc_id"])


def block_kinds(s: SparkSession, d: str) -> DataFrame:
    return doc_lines(s, d).select("doc_id", "line", L.block_kind(F.col("text")).alias("kind"))


def block_stream(s: SparkSession, d: str) -> DataFrame:
    return L.blocks(doc_lines(s, d), ["doc_id"])


def table_blocks(s: SparkSession, d: str) -> DataFrame:
    return L.islands(doc_lines(s, d), ["doc_id"], C.is_table_line(F.col("text"))).select("doc_id", F.col("start").cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"), "n_lines")


def bar_cells(s: SparkSession, d: str) -> DataFrame:
    return L.table_cells(doc_lines(s, d), "doc_id")


def image_references(s: SparkSession, d: str) -> DataFrame:
    return L.image_references(doc_lines(s, d), "doc_id").select("doc_id", "line", F.col("n").cast("int").alias("n"), "src")


def page_of_lines(s: SparkSession, d: str) -> DataFrame:
    return L.page_of_lines(doc_lines(s, d), ["doc_id"]).where("not is_heading").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"))


def demoted_lines(s: SparkSession, d: str) -> DataFrame:
    hashed = doc_lines(s, d).withColumn("text", F.regexp_replace("text", "^## ", "# "))
    return L.demote(hashed, ["doc_id"])


def limited_blanks(s: SparkSession, d: str) -> DataFrame:
    wide = L.explode_lines(docs(s, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id")
    return L.limit_blanks(wide, ["doc_id"])


# ---- texts


def plain_text(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.md5(T.plain_text(F.col("text"))).alias("plain_md5"))


def cleaned_documents(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.clean_document(F.col("text")).alias("text"))


def stripped_tex(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).where("text is not null").select("region_id", T.strip_tex(F.col("text")).alias("text"))


def match_forms(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).where("text is not null").select("region_id", T.match_form(F.col("text")).alias("form"))


def formula_pack(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).where("text is not null").select("region_id", T.apply_templates(F.col("text"), T.FORMULA_PACK).alias("text"))


def rendered_formulas(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).where("text is not null").select("region_id", T.render_formula(F.col("text"), F.col("score") >= 0.7).alias("text"))


# ---- pages and files


def page_names(s: SparkSession, d: str) -> DataFrame:
    f = MG.parse_pages(read(s, d, "page_files").drop("page", "part"))
    return f.select("file_id", "page", "part", MG.normal_name().alias("name"))


def path_folders(s: SparkSession, d: str) -> DataFrame:
    p = path_parts(F.col("path"))
    return read(s, d, "page_files").where("path is not null").select("file_id", F.element_at(p, -2).alias("folder"), F.element_at(p, -1).alias("name"), C.suffix(F.col("path")).alias("suffix"))


def input_kinds(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").where("path is not null")
    return f.groupBy(C.input_kind(F.regexp_replace("path", r"\.txt$", ".HEIC")).alias("kind"), C.requires_conversion(F.regexp_replace("path", r"\.txt$", ".HEIC")).alias("convert")).agg(F.count(F.lit(1)).alias("n"))


def layout_page_numbers(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return layouts(s, d).select("layout_id", page_of_name(name).alias("page"))


def folder_ranges(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "page_files").select("doc_id").distinct().select("doc_id", C.page_range(F.col("doc_id")).alias("page_range"))


def merged_pages(s: SparkSession, d: str) -> DataFrame:
    return MG.merge_parts(page_parts(s, d))


def merged_sections(s: SparkSession, d: str) -> DataFrame:
    return MG.sections(merged_pages(s, d))


def page_issues(s: SparkSession, d: str) -> DataFrame:
    return MG.math_issues(merged_pages(s, d))


def newest_listing(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files")
    return f.groupBy("doc_id").agg(F.max_by("file_id", F.struct("listed_at", "file_id")).alias("file_id"), F.max("listed_at").alias("listed_at"))


def newest_folder(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").groupBy(F.col("doc_id").alias("name")).agg(F.max("listed_at").alias("mtime"))
    stems = f.select(F.regexp_replace("name", "_p[0-9]+-[0-9]+$", "").alias("stem")).distinct()
    return MG.latest_folder(stems, f)


def best_outputs(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").where("path is not null").select("doc_id", F.element_at(path_parts(F.col("path")), -1).alias("name"))
    return MG.best_files(f)


def recent_folders(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").groupBy(F.col("doc_id").alias("name")).agg(F.max("listed_at").alias("mtime"))
    return MG.recent(f, 10)


def pages_without_tables(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "cells").select("doc_id", "page")
    return MG.tables_or_text(t, layouts(s, d).select("doc_id", "page").distinct(), ["doc_id", "page"])


def requested_pages(s: SparkSession, d: str) -> DataFrame:
    return layouts(s, d).select("layout_id", "doc_id", "page").join(read(s, d, "regions").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")


def first_locations(s: SparkSession, d: str) -> DataFrame:
    images = read(s, d, "cells").select("doc_id", "page", F.lit(2).alias("priority"), F.lit("cells").alias("path")).unionByName(read(s, d, "regions").select("doc_id", "page", F.lit(1).alias("priority"), F.lit("regions").alias("path"))).distinct()
    return R.first_location(layouts(s, d).select("layout_id", "doc_id", "page"), images).select("layout_id", "path")


def page_spans(s: SparkSession, d: str) -> DataFrame:
    r = F.split(F.regexp_extract("doc_id", r"_p(\d+-\d+)$", 1), "-")
    f = read(s, d, "page_files").where("page is not null").groupBy("doc_id").agg(F.max("page").alias("total"))
    span = MG.page_span(F.get(r, F.lit(0)).try_cast("int"), F.get(r, F.lit(1)).try_cast("int"), F.col("total"))
    return f.select("doc_id", F.size(span).alias("n_pages"), F.try_element_at(span, F.lit(1)).alias("first_page"))


# ---- tables


def cell_types(s: SparkSession, d: str) -> DataFrame:
    v = C.typed_value(F.col("text"))
    return cells(s, d).where("text is not null and trim(text) <> ''").select("cell_id", v.alias("v")).select("cell_id", "v.kind", "v.i", F.round("v.d", 9).alias("d"), "v.dt", "v.fmt")


def cell_symbols(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).where("text is not null").where(C.is_symbol(F.col("text"))).select("cell_id", C.symbol_form(T.strip(F.col("text"))).alias("symbol"))


def table_extents(s: SparkSession, d: str) -> DataFrame:
    return TB.extents(cells(s, d))


def cell_grid(s: SparkSession, d: str) -> DataFrame:
    return TB.grid(cells(s, d))


def row_signatures(s: SparkSession, d: str) -> DataFrame:
    return TB.rows_of(cells(s, d)).select(*TB.KEYS, "r", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"), "has_symbol")


def table_segments(s: SparkSession, d: str) -> DataFrame:
    return TB.segments_of(TB.rows_of(cells(s, d))).select(*TB.KEYS, "segment", "role", "r")


def segment_headers(s: SparkSession, d: str) -> DataFrame:
    h = TB.segments(cells(s, d))
    return h.select(*TB.KEYS, "segment", "width", "name", F.array_join("header", "|").alias("header"), F.size("data").alias("n_rows"))


def segment_shapes(s: SparkSession, d: str) -> DataFrame:
    h = TB.segments(cells(s, d))
    return h.select(*TB.KEYS, "segment", "width", "name", F.size("header_rows").alias("n_header"), F.size("data_rows").alias("n_data"))


def segment_names(s: SparkSession, d: str) -> DataFrame:
    return TB.sheets(cells(s, d)).select(*TB.KEYS, "segment", "sheet", "file")


def segment_cells(s: SparkSession, d: str) -> DataFrame:
    return TB.typed_cells(TB.segments(cells(s, d))).select(*TB.KEYS, "segment", "data_row", "col", "v.kind")


def segment_csv(s: SparkSession, d: str) -> DataFrame:
    return segment_lines(TB.sheets(cells(s, d)))


def layout_csv(s: SparkSession, d: str) -> DataFrame:
    return TB.layout_rows(cells(s, d)).select(*TB.KEYS, "r", F.array_join("values", "\t").alias("line"))


def column_widths(s: SparkSession, d: str) -> DataFrame:
    return TB.column_widths(TB.segments(cells(s, d)))


def safe_names(s: SparkSession, d: str) -> DataFrame:
    t = cells(s, d).where("text is not null").select("text").distinct()
    f = F.lit("x")
    return t.select("text", C.sheet_title(F.col("text"), f).alias("sheet"), C.table_name(F.col("text"), f).alias("display"), C.file_name(F.col("text"), f).alias("file"))


def csv_blocks(s: SparkSession, d: str) -> DataFrame:
    """Tables of the regions' texts, read as CSV with blank rows between tables."""
    f = regions(s, d).where("text is not null").select(F.col("region_id").cast("string").alias("doc_id"), "page", "text")
    return table_files(f, "csv", tables_only=True).select("doc_id", "table_no", "idx", "row", "col", "text")


def html_blocks(s: SparkSession, d: str) -> DataFrame:
    """The tables of the cells, written as HTML and read again."""
    c = cells(s, d).where("doc_id is not null")
    esc = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    td = F.concat(F.lit("<td>"), esc, F.lit("</td>"))
    rows = c.groupBy("doc_id", "page", "table_no", F.coalesce("row", F.lit(1)).alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", td.alias("t")))), lambda x: x["t"]), "").alias("tr"))
    html = rows.groupBy("doc_id", "page", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: F.concat(F.lit("<tr>"), x["tr"], F.lit("</tr>"))), "").alias("t"))
    f = html.select(F.concat_ws("/", "doc_id", F.col("page").cast("string"), F.col("table_no").cast("string")).alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("<table>"), "t", F.lit("</table>")).alias("text"))
    return table_files(f, "html").select("doc_id", "idx", "row", "col", "text")


# ---- regions


def math_candidates(s: SparkSession, d: str) -> DataFrame:
    return R.candidates(layouts(s, d), "layout_id").select("layout_id", "src_no", F.col("ord").cast("int").alias("ord"), "score")


def gated_regions(s: SparkSession, d: str) -> DataFrame:
    return R.gate(regions(s, d), max_aspect=8.0).select("region_id", F.array_join(F.transform("box", lambda x: x.cast("string")), ",").alias("box"))


def top_regions(s: SparkSession, d: str) -> DataFrame:
    top = R.top_regions(R.gate(regions(s, d), max_aspect=8.0), k=12, tie=("ord", "region_id"))
    named = R.snippet_names(top.where("page is not null"))
    return named.select("region_id", F.col("rank").cast("int").alias("rank"), "name", F.array_join(F.transform("crop", lambda x: x.cast("string")), ",").alias("crop"))


def region_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of each page; the lines of several layouts of one page follow each other."""
    text = F.array_join(F.transform("detections", lambda x: F.coalesce(x["content"], F.lit(""))), "\n").alias("text")
    per = layouts(s, d).where("detections is not null").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("layout_id", text))).alias("t"))
    return L.explode_lines(per.select("doc_id", "page", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")), "doc_id", "page")


def snippets(s: SparkSession, d: str) -> DataFrame:
    """Every region with text, with its own text, numbered by score on its page; no upper bound (WIN-09 has 20, pages have up to 14)."""
    r = regions(s, d).where("text is not null and text <> ''")
    ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("score").desc_nulls_last(), "region_id")))
    return ranked.select("doc_id", "page", "rank", F.format_string("eq_page%03d_%02d.png", "page", "rank").alias("name"), "text")


def snippet_candidates(s: SparkSession, d: str) -> DataFrame:
    return R.contained(region_lines(s, d), snippets(s, d)).select("doc_id", "page", "line", F.col("rank").cast("int").alias("rank"))


def snippet_matches(s: SparkSession, d: str) -> DataFrame:
    return R.match_snippets(region_lines(s, d), snippets(s, d)).select("doc_id", "page", "line", F.col("rank").cast("int").alias("rank"), "name")


def linked_pages(s: SparkSession, d: str) -> DataFrame:
    return R.insert_links(region_lines(s, d), snippets(s, d))


def recognized_formulas(s: SparkSession, d: str) -> DataFrame:
    r = regions(s, d).where("text is not null and box is not null and score is not null and size(box) = 4")
    return r.select("doc_id", "page", F.col("text").alias("latex"), (F.col("score") >= 0.8).alias("isolated"), "score", ((F.col("box")[1] + F.col("box")[3]) / 2).alias("y_center"), F.col("region_id").alias("ord"))


def refined_counts(s: SparkSession, d: str) -> DataFrame:
    return R.refine_counts(region_lines(s, d), recognized_formulas(s, d))


def refined_pages(s: SparkSession, d: str) -> DataFrame:
    return R.refine_page(region_lines(s, d), recognized_formulas(s, d))


def paired_by_order(s: SparkSession, d: str) -> DataFrame:
    a = regions(s, d).where("doc_id is not null and page is not null").select("doc_id", "page", "region_id", "ord")
    b = layouts(s, d).where("detections is not null").select("doc_id", "page", F.posexplode("detections").alias("pos", "x")).where("x is not null").groupBy("doc_id", "page").agg(F.collect_list(F.struct("pos")).alias("p")).select("doc_id", "page", F.explode("p.pos").alias("pos"))
    p = R.pair_by_order(a, b, ["doc_id", "page"], [F.col("ord"), F.col("region_id")], [F.col("pos")])
    return p.where("region_id is not null").select("region_id", F.col("pos").cast("int").alias("pos"))


def detection_boxes(s: SparkSession, d: str) -> DataFrame:
    x = layouts(s, d).select("layout_id", F.posexplode("detections").alias("pos", "x")).where("x is not null")
    box = G.polygon_box(F.col("x.points"))
    return x.select("layout_id", F.col("pos").cast("int").alias("pos"), F.array_join(F.transform(box, lambda v: v.cast("string")), ",").alias("box"))


def inner_crops(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).where("size(box) = 4")
    return c.select("cell_id", F.array_join(F.transform(G.inner(F.col("box")), lambda v: v.cast("string")), ",").alias("crop"))


def image_sizes(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).where("size(box) = 4").select("cell_id", (F.col("box")[2] - F.col("box")[0]).alias("w"), (F.col("box")[3] - F.col("box")[1]).alias("h")).where("w > 0 and h > 0")
    a, b = G.resized(F.col("w"), F.col("h"), 2600), G.preview_size(F.col("w"), F.col("h"), 100)
    return c.select("cell_id", a[0].alias("ocr_w"), a[1].alias("ocr_h"), b[0].alias("preview_w"), b[1].alias("preview_h"))


def relative_crops(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).where("size(box) = 4")
    b = [F.col("box")[k] for k in range(4)]
    rel = [F.round(b[0] / 2480.0, 3), F.round(b[1] / 3508.0, 3), F.round((b[2] - b[0]) / 2480.0, 3), F.round((b[3] - b[1]) / 3508.0, 3)]
    text = F.concat_ws(",", *[x.cast("string") for x in rel])
    crop = G.parse_crop(text)
    px = G.crop_pixels(crop, F.lit(2480), F.lit(3508))
    return c.select("cell_id", px[0].alias("left"), px[1].alias("top"), px[2].alias("right"), px[3].alias("bottom"))


# ---- figures


def pixels(s: SparkSession, d: str) -> DataFrame:
    """Vectors as grey pictures of 16 columns: their values as 24 levels."""
    e = read(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("k", "v")).where("v is not null")
    level = (F.least(F.lit(23), F.greatest(F.lit(0), F.floor((F.col("v") + 0.5) * 24))).cast("int") * 11).alias("v")
    return e.select("vec_id", F.lit(16).alias("width"), (F.col("n") / 16).cast("int").alias("height"), (F.col("k") % 16).cast("int").alias("x"), (F.col("k") / 16).cast("int").alias("y"), level)


def figure_statistics(s: SparkSession, d: str) -> DataFrame:
    p = pixels(s, d).select("vec_id", "width", "height", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), F.lit(200).alias("page_width"), F.lit(300).alias("page_height"))
    return FG.figure_statistics(p, ["vec_id"])


def figure_decisions(s: SparkSession, d: str) -> DataFrame:
    return FG.decide(figure_statistics(s, d), G.IconRules(auto_drop_avg_std=40.0, likely_avg_std=70.0, auto_drop_unique_colors=12, likely_unique_colors=14, auto_drop_area_ratio=0.01)).select("vec_id", "decision", "removed")


def tone_curves(s: SparkSession, d: str) -> DataFrame:
    p = pixels(s, d).select("vec_id", F.floor(F.col("x") / 8).cast("int").alias("tx"), F.floor(F.col("y") / 2).cast("int").alias("ty"), "v")
    return FG.tone_curves(p, ["vec_id", "tx", "ty"])


def median_thresholds(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (F.least(F.lit(23), F.greatest(F.lit(0), F.floor((v + 0.5) * 24))).cast("int") * 11)).alias("px"))
    return e.select("vec_id", G.median_threshold(F.col("px")).alias("threshold"), FG.black_ratio(G.binarized(F.col("px"))).alias("black"))


def image_variants(s: SparkSession, d: str) -> DataFrame:
    images = read(s, d, "embeddings").select("vec_id", F.lit(1240).alias("width"), (F.lit(1000) + F.col("vec_id") % 700).cast("int").alias("height"))
    profiles = s.createDataFrame([(p.key, p.target_long_edge, p.grayscale, p.keep_color) for p in G.PROFILES.values()], "key string, target_long_edge int, grayscale boolean, keep_color boolean")
    v = FG.variants(images, profiles)
    return v.select("vec_id", "key", "mode", F.col("size")[0].alias("new_width"), F.col("size")[1].alias("new_height"))


def outline_symbols(s: SparkSession, d: str) -> DataFrame:
    px = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    p = pixels(s, d).groupBy("vec_id", "width", "height").agg(px.alias("p")).select("vec_id", "width", "height", F.transform("p", lambda q: q["v"]).alias("pixels"))
    return FG.symbols(p, ["vec_id"])


def renumbered_figures(s: SparkSession, d: str) -> DataFrame:
    f = layouts(s, d).where("figures is not null").select("layout_id", "page", F.posexplode("figures").alias("k", "f")).where("page is not null")
    names = f.select(F.col("layout_id"), F.format_string("page_images_page_%03d_p%d_figure_%d.PNG", F.col("page"), (F.col("k") % 2 + 1).cast("int"), (F.col("k") / 2).cast("int")).alias("name"))
    return FG.renumber(names, ["layout_id"])


# ---- logs and streams


def log_events(s: SparkSession, d: str) -> DataFrame:
    return P.events(read(s, d, "progress_log")).where("event is not null").groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("current").alias("sum_current"), F.sum("total").alias("sum_total"))


def job_progress(s: SparkSession, d: str) -> DataFrame:
    p = P.progress(read(s, d, "progress_log"))
    return p.select("job_id", "seq", "event", "current", "total", F.round("progress", 6).alias("progress"), "eta_seconds")


def job_tail(s: SparkSession, d: str) -> DataFrame:
    return P.last_lines(read(s, d, "progress_log").dropDuplicates(["job_id", "seq"])).select("job_id", "seq")


def marked_log(s: SparkSession, d: str) -> DataFrame:
    """The merged log of every job in the order of ``seq``; lines delivered twice count once, null lines are left out."""
    log = read(s, d, "progress_log").select("job_id", "seq", "line").distinct()
    err = F.col("line").startswith("stderr")
    return P.merged_log(log.where(~err), log.where(err))


def _drained(s: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream gives when it is run over what is there, as a table in the shared folder."""
    import uuid

    from ..session import shared_dir

    at = f"{shared_dir(s)}/inkwell/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return s.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/out")


def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    import os

    path = f"{d}/{table}.parquet"
    schema = read(s, d, table).schema
    # a stream reads folders: the table's folder, or the one file of the folder it is in
    glob = {} if os.path.isdir(path) else {"pathGlobFilter": f"{table}.parquet"}
    return s.readStream.schema(schema).options(**glob).parquet(path if not glob else d)


def progress_stream(s: SparkSession, d: str) -> DataFrame:
    log = _stream(s, d, "progress_log").select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "line")
    out = _drained(s, P.progress_stream(log), "update", "progress")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("progress", "current", "total"), "batch").alias("r"))
    return last.select("job_id", F.round("r.progress", 6).alias("progress"), "r.current", "r.total")


def event_windows(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return P.windowed_counts(e, "ts", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding_windows(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return P.windowed_counts(e, "ts", "event_type", "2 hours", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").where("user_id is not null")
    return P.session_counts(e, "ts", "user_id").select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def event_stream_counts(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _drained(s, P.windowed_counts(e, "ts", "event_type"), "update", "counts")
    last = out.groupBy("window", "event_type").agg(F.max("n").alias("n"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def event_properties(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


# ---- sets


def all_labels(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "term_list").select(F.col("term").alias("label"))
    b = read(s, d, "lexicon").select(F.col("word").alias("label"))
    return a.unionByName(b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def first_labels(s: SparkSession, d: str) -> DataFrame:
    return MG.distinct_in_order(cells(s, d).where("text is not null"), ["text"], "cell_id")


def terms_not_words(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "term_list").select(F.lower("term").alias("label")).subtract(read(s, d, "lexicon").select(F.lower("word").alias("label")))


def common_labels(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "term_list").select("term").intersect(cells(s, d).select(F.col("text").alias("term")))


# ---- star schema (beyond what documents need)


def star_revenue(s: SparkSession, d: str) -> DataFrame:
    li, o, c, n, r = (read(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def star_rollup(s: SparkSession, d: str) -> DataFrame:
    li = read(s, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"))


def star_cube(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def star_unordered(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").join(read(s, d, "orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT"), "left_anti").select("c_custkey", "c_name")


def star_ranks(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(s, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def star_asof(s: SparkSession, d: str) -> DataFrame:
    """For each event the last order of the same day or before, by one window over both: no comparison of all pairs."""
    e = read(s, d, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(None).cast("bigint").alias("o"))
    o = read(s, d, "orders").select(F.lit(None).cast("bigint").alias("event_id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("t", F.col("o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("last_order", F.last("o", ignorenulls=True).over(w)).where("event_id is not null").select("event_id", "last_order")


def _queries() -> dict:
    names = [n for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
    helpers = {"docs", "doc_lines", "cells", "layouts", "regions", "page_parts", "region_lines", "snippets", "recognized_formulas", "pixels"}
    return {n: globals()[n] for n in names if n not in helpers}


QUERIES = _queries()
