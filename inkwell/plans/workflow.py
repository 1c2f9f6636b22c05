"""Queries over names, references, listings, logs, pictures and outputs, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import formulas as M
from ..functions import geometry as G
from ..functions import text as T
from ..operators import figures as FG
from ..operators import lines as L
from ..operators import merge as MG
from ..operators import regions as R
from ..operators import tables as TB
from ..operators.compact import path_parts
from ..operators.nested import flatten_layouts
from ..session import read
from ..sinks import files as W
from ..sources import files as S
from ..streaming import progress as P
from . import pipeline as PL
from . import sql as Q
from .corpus import cells, doc_lines, docs, layouts, merged_pages, merged_sections, pixels, regions, snippets, top_regions

FIGURE = r"fig_page[0-9]+_[0-9]+\.png"

# ---- references and markup


def markdown_images(s: SparkSession, d: str) -> DataFrame:
    """Lines with pictures, as HTML (every other one with its text), as Markdown again."""
    html = F.when(F.col("line") % 2 == 0, r'<img src="$2" width="10" alt="$1">').otherwise(r'<IMG class="x" src="$2">')
    tagged = F.regexp_replace("text", F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), html)
    return doc_lines(s, d).where(r"text rlike '!\\[[^\\]]*\\]\\('").select("doc_id", "line", T.image_tags(tagged).alias("text"))


def sanitized_math(s: SparkSession, d: str) -> DataFrame:
    """Formulas in dollar signs as other writers delimit them, and back."""
    other = F.regexp_replace(F.regexp_replace("text", r"\$\$([^$\n]+)\$\$", r"\\[$1\\]"), r"\$([^$\n]+)\$", r"\\($1\\)")
    return docs(s, d).where("text like '%$%' and not contains(text, chr(92) || '-')").select("doc_id", F.md5(T.sanitize_math(other)).alias("text_md5"))


def markdown_line_counts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.size(T.markdown_lines(F.col("text"))).alias("n_lines"))


def renamed_links(s: SparkSession, d: str) -> DataFrame:
    """Every figure a document refers to under a new name."""
    named = docs(s, d).select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({FIGURE})"), 1))).alias("old"))
    names = FG.renamed_map(named.select("doc_id", "old", F.replace("old", F.lit("fig_page"), F.lit("abb")).alias("new")), ["doc_id"])
    return docs(s, d).join(names, "doc_id").select("doc_id", F.md5(T.rewrite_links(F.col("text"), F.col("names"))).alias("text_md5"))


def dropped_figures(s: SparkSession, d: str) -> DataFrame:
    """The references to each document's first figure away."""
    name = F.regexp_extract("text", f"({FIGURE})", 1)
    return docs(s, d).where(name != "").select("doc_id", F.md5(T.remove_figure(F.col("text"), name)).alias("text_md5"))


def image_widths(s: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("px"), F.lit("cm"), F.lit("mm"), F.lit(""), F.lit("em")), (F.col("cell_id") % 5 + 1).cast("int"))
    token = F.concat(F.lit('<img width="'), (F.col("cell_id") % 977).cast("string"), F.when(F.col("cell_id") % 3 == 0, ".5").otherwise(""), unit, F.lit('" src="x">'))
    return cells(s, d).select("cell_id", F.round(C.width_mm(token), 6).alias("mm"))


def run_texts(s: SparkSession, d: str) -> DataFrame:
    return regions(s, d).where("text is not null").select("region_id", T.run_text(F.col("text")).alias("text"))


def document_tables(s: SparkSession, d: str) -> DataFrame:
    """The tables among the lines of documents as rows of one width, without dividers and placeholders."""
    at = doc_lines(s, d).where(C.is_table_line(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("line")
    blocks = at.withColumn("g", F.col("line") - F.row_number().over(w)).groupBy("doc_id", "g").agg(F.min("line").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    rows = blocks.select("doc_id", "start", F.posexplode(C.table_rows(F.col("lines"))).alias("k", "row"))
    return rows.select("doc_id", "start", F.col("k").cast("int").alias("k"), F.array_join("row", "|").alias("row"))


def fallback_texts(s: SparkSession, d: str) -> DataFrame:
    """Sparse documents with another recognizer's text in place of theirs, and every text with it appended."""
    other = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" other "), F.col("doc_id").cast("string")))
    return docs(s, d).select("doc_id", F.md5(M.recognized_or_other(F.col("text"), other)).alias("replaced"), F.md5(M.recognized_or_other(F.col("text"), other, merge=True)).alias("merged"))


# ---- names, arguments and listings


def asked_folders(s: SparkSession, d: str) -> DataFrame:
    """The folder that arguments ask for: by range where the folder's name has one, by label, else the stem."""
    f = read(s, d, "page_files").select("doc_id").distinct()
    stem, span = F.regexp_replace("doc_id", "_p[0-9]+-[0-9]+$", ""), F.regexp_extract("doc_id", "_p([0-9]+)-([0-9]+)$", 0)
    lo, hi = (F.regexp_extract("doc_id", "_p([0-9]+)-([0-9]+)$", k) for k in (1, 2))
    label = F.when(F.length("doc_id") % 3 == 0, F.array(F.lit("--label"), F.lit("x1"))).otherwise(F.array().cast("array<string>"))
    args = F.when(span != "", F.array(F.lit("--start"), lo, F.concat(F.lit("--end="), hi))).otherwise(label)
    return f.select("doc_id", PL.output_folder(stem, args).alias("folder"))


def resolved_folders(s: SparkSession, d: str) -> DataFrame:
    """Inputs by stem, without arguments: the newest folder of each."""
    f = read(s, d, "page_files").groupBy(F.col("doc_id").alias("name")).agg(F.max("listed_at").alias("mtime"))
    i = f.select(F.regexp_replace("name", "_p[0-9]+-[0-9]+$", "").alias("stem")).distinct().withColumn("args", F.array().cast("array<string>"))
    return PL.resolved_folders(i, f).select("stem", "folder")


def safe_folders(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").where("path is not null").select(F.explode(F.split("path", "/")).alias("name")).distinct()
    return f.select("name", S.safe_folder(F.col("name")).alias("safe"))


def default_pages(s: SparkSession, d: str) -> DataFrame:
    """The only file of a folder as page 1 if its name has no number."""
    name = F.element_at(path_parts(F.col("path")), -1)
    f = read(s, d, "page_files").where("path is not null").select("doc_id", "file_id", F.when(F.col("file_id") % 2 == 0, S.page_of_name(name)).alias("page"))
    f = f.withColumn("g", F.floor(F.col("file_id") / 40))
    return S.default_page(f, ["doc_id", "g"]).select("doc_id", "file_id", "page")


def numbered_pages(s: SparkSession, d: str) -> DataFrame:
    f = read(s, d, "page_files").where("path is not null").select("doc_id", F.concat_ws("#", F.element_at(path_parts(F.col("path")), -1), F.col("file_id").cast("string")).alias("name")).distinct()
    return MG.page_numbers(f, start=5).select("doc_id", "name", "page")


def collected_outputs(s: SparkSession, d: str) -> DataFrame:
    listing = read(s, d, "page_files").where("path is not null").select("path", F.col("doc_id").alias("folder"), F.col("n_bytes").alias("size"))
    wanted = read(s, d, "documents").select(F.col("source").alias("folder")).distinct()
    return PL.collect_outputs(listing, wanted, ["md", "txt"]).select("path", "size")


def failed_outputs(s: SparkSession, d: str) -> DataFrame:
    return PL.self_test(read(s, d, "page_files").where("path is not null").select("file_id", "path", F.col("n_bytes").alias("size"))).select("file_id")


def layout_order(s: SparkSession, d: str) -> DataFrame:
    """Layout files of each folder in the order of their names."""
    w = Window.partitionBy("doc_id").orderBy(F.element_at(F.split("path", "/"), -1), "layout_id")
    return layouts(s, d).where("path is not null").select("layout_id", F.row_number().over(w).alias("n"))


def layout_images(s: SparkSession, d: str) -> DataFrame:
    """Every layout with the image of its page, or none."""
    files = read(s, d, "page_files").where("path is not null and page is not null").select("doc_id", "page", F.lit(1).alias("priority"), "path")
    return R.first_location(layouts(s, d).select("layout_id", "doc_id", "page"), files).select("layout_id", F.col("path").alias("image"))


def regions_on_pages(s: SparkSession, d: str) -> DataFrame:
    images = read(s, d, "page_files").where("page is not null").select("doc_id", "page")
    return R.with_images(regions(s, d), images).select("region_id")


def layout_cell_rows(s: SparkSession, d: str) -> DataFrame:
    """The cells of all tables of the typed pages, strung together."""
    c = S.layout_cells(layouts(s, d), ["layout_id"])
    return c.select("layout_id", F.col("table_no").cast("int").alias("table_no"), F.col("idx").cast("int").alias("idx"), "row", "col", "text", "row_span", "col_span", F.array_join(F.transform("box", lambda x: x.cast("string")), ",").alias("box"))


def p1_typed(s: SparkSession, d: str) -> DataFrame:
    """The flat tables of the typed records, with all that the elements hold."""
    e = flatten_layouts(layouts(s, d))
    box = F.array_join(F.transform("box", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    return e.select("layout_id", "kind", "parent_no", "child_no", "content", "role", box.alias("box"), "row", "col", "row_span", "col_span", "score", "rec_score", "det_score", "x", "y")


def pdf_pages(s: SparkSession, d: str) -> DataFrame:
    """Page counts of made-up files: one page object a page, and files that are none."""
    page, n = F.lit("3 0 obj << /Type /Page /Parent 2 0 R >> endobj\n"), F.coalesce("n_pages", F.lit(0))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Pages >> endobj\n"), F.repeat(page, n))
    f = read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.encode(F.lit("no file"), "utf-8")).otherwise(F.encode(body, "utf-8")).alias("content"))
    return f.select("doc_id", S.pdf_page_count(F.col("content")).alias("p")).select("doc_id", "p.pages", "p.note")


# ---- boxes and pictures


def picture_files(s: SparkSession, d: str) -> DataFrame:
    """Sizes from the headers of made-up picture files."""
    h = lambda c: F.lpad(F.hex(c), 8, "0")
    w, t = F.col("vec_id") % 5000 + 1, F.col("vec_id") % 777 + 1
    content = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), h(w), h(t)))
    e = read(s, d, "embeddings").select("vec_id", FG.png_size(F.when(F.col("vec_id") % 9 == 0, F.encode(F.lit("GIF89a"), "utf-8")).otherwise(content)).alias("p"))
    return e.select("vec_id", "p.width", "p.height", "p.area")


def gamma_curves(s: SparkSession, d: str) -> DataFrame:
    """The curves of some exponents, one of which a page variant uses."""
    one = None
    for k, g in enumerate((0.7, 1.0, 2.2)):
        c = s.range(1).select(F.lit(k).alias("k"), F.posexplode(G.gamma_curve(g)).alias("i", "v"))
        one = c if one is None else one.unionByName(c)
    return one.select("k", F.col("i").cast("int").alias("i"), "v")


def ring_measures(s: SparkSession, d: str) -> DataFrame:
    p = pixels(s, d).withColumn("v", F.when(F.col("v") < 110, 0).otherwise(255))
    m = FG.ring_measures(p, ["vec_id"])
    return m.select("vec_id", *[F.round(c, 6).alias(c) for c in ("ink", "centre", "edge", "left", "right", "top", "bottom")], "ring")


def filtered_pictures(s: SparkSession, d: str) -> DataFrame:
    """Pictures through a median filter."""
    px = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    p = pixels(s, d).groupBy("vec_id", "width", "height").agg(px.alias("p")).select("vec_id", "width", "height", F.transform("p", lambda q: q["v"]).alias("pixels"))
    return FG.filtered_pixels(p, ["vec_id"], "median").select("vec_id", F.array_join("pixels", ",").alias("pixels"))


def filled_cells(s: SparkSession, d: str) -> DataFrame:
    """Empty cells with the symbols that were found at their places."""
    symbol = F.element_at(F.array(F.lit("○"), F.lit("□"), F.lit(None).cast("string")), (F.col("cell_id") % 3 + 1).cast("int"))
    found = FG.cell_crops(cells(s, d)).select("cell_id", symbol.alias("symbol"))
    return FG.fill_empty_cells(cells(s, d), found, ["cell_id"]).select("cell_id", "text")


def previews(s: SparkSession, d: str) -> DataFrame:
    return W.preview(read(s, d, "term_list").select("term_id", F.encode("term", "utf-8").alias("content"))).select("term_id", "url")


# ---- outputs


def heading_images(s: SparkSession, d: str) -> DataFrame:
    """Page headings of the merged documents with the snippets of their pages."""
    lines = L.explode_lines(merged_sections(s, d).withColumnRenamed("section", "text"), "doc_id", "page").where("text rlike '^# Page [0-9]+$'")
    b = lines.select("doc_id", F.lit("page").alias("kind"), "text").distinct()
    h = PL.images_at_headings(b, snippets(s, d))
    return h.select("doc_id", "page", F.array_join("images", ",").alias("images"))


def placed_images(s: SparkSession, d: str) -> DataFrame:
    """References of documents to images, with the file or the text in its place."""
    refs = L.image_references(doc_lines(s, d), "doc_id").select("doc_id", "line", F.col("n").cast("int").alias("n"), "src")
    there = refs.select(F.regexp_replace(T.strip(F.col("src")), r"^\./", "").alias("path")).distinct().where(F.length("path") % 2 == 0)
    return PL.placed_images(refs, there).select("doc_id", "line", "n", "file", "placeholder")


def snippet_totals(s: SparkSession, d: str) -> DataFrame:
    return top_regions(s, d).agg(F.count(F.lit(1)).alias("n_saved"))


def workbook_facts(s: SparkSession, d: str) -> DataFrame:
    """The rows of the sheet about each workbook."""
    return W.meta_rows(TB.sheets(cells(s, d)), ["doc_id"], format="xlsx", mode="table").select("doc_id", F.col("n").cast("int").alias("n"), "key", "value")


def review_headers(s: SparkSession, d: str) -> DataFrame:
    h = TB.segments(cells(s, d))
    return h.select(*TB.KEYS, "segment", F.array_join(W.review_column(F.col("header"), F.col("width")), "|").alias("header"))


def folder_issues(s: SparkSession, d: str) -> DataFrame:
    """Lines that need review, of every document as a page of its folder."""
    return MG.math_issues(docs(s, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"))


def _page_snippets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the merged pages, and every third of them as a snippet of its page."""
    lines = L.explode_lines(merged_pages(s, d), "doc_id", "page")
    snip = lines.where("line % 3 = 1").select("doc_id", "page", ((F.col("line") + 2) / 3).cast("int").alias("rank"), F.format_string("eq_page%03d_%02d.png", F.col("page"), ((F.col("line") + 2) / 3).cast("int")).alias("name"), "text")
    return lines, snip


def line_candidates(s: SparkSession, d: str) -> DataFrame:
    return R.contained(*_page_snippets(s, d)).select("doc_id", "page", "line", "rank")


def line_matches(s: SparkSession, d: str) -> DataFrame:
    return R.match_snippets(*_page_snippets(s, d)).select("doc_id", "page", "line", "rank", "name")


def line_links(s: SparkSession, d: str) -> DataFrame:
    return R.insert_links(*_page_snippets(s, d))


# ---- logs

# marks of the stages behind recognition, as the program that writes this log would state them
STAGES = (("--- merge を実行 ---", 92.0), ("[convert] docx", 96.0))


def _other_writer(s: SparkSession, d: str) -> DataFrame:
    """The log in the shapes of another writer."""
    x = F.col("line")
    for a, b in ((r"^reading page (\d+) of (\d+)", "--- Page $1/$2 ---"), (r"^layout done: (\d+)/(\d+)", "--- Done $1/$2 ---"), (r"^\[warn\] low score on page (\d+) \(of (\d+)\)", "処理範囲: $1 〜 $2"), (r"^memory \d+ percent", "--- merge を実行 ---"), (r"^stderr: retry", "x [convert] docx x")):
        x = F.regexp_replace(x, a, b)
    return read(s, d, "progress_log").withColumn("line", x)


def log_shapes(s: SparkSession, d: str) -> DataFrame:
    """What the lines of another writer say: all four kinds of events."""
    e = P.events(_other_writer(s, d), stages=STAGES).where("event is not null").select("job_id", "seq", "event", "current", "total", "stage")
    return e.distinct()


def staged_progress(s: SparkSession, d: str) -> DataFrame:
    p = P.progress(_other_writer(s, d).where("job_id is not null and seq is not null"), stages=STAGES)
    return p.select("job_id", "seq", "event", F.round("progress", 6).alias("progress"))


def new_lines(s: SparkSession, d: str) -> DataFrame:
    log = read(s, d, "progress_log").select("job_id", "seq", "line").distinct()
    return P.log_since(log, 20).select("job_id", "seq", "next_cursor")


def job_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The state of each job as of the last line that said something."""
    states = P.events(read(s, d, "progress_log")).where("event in ('page', 'done')").select("job_id", "seq", "event", "current", "total").distinct()
    return P.snapshot(states, version="seq")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_T = "doc_id, page, table_no"
_NAME = "pp[-1]"
_REFS = (
    "(SELECT doc_id, line, CAST(unnest(range(len(r))) AS INTEGER) AS n, unnest(r) AS src FROM (SELECT doc_id, line, list_concat(list_transform(regexp_extract_all(text, '<img[^>]*src=\"[^\"]+\"[^>]*>'), "
    f"lambda t: regexp_extract(t, 'src=\"([^\"]+)\"', 1)), regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS r FROM {Q.DOC_LINES}))"
)
_PARTS_OF = f"list_transform(string_split(regexp_replace(regexp_replace({Q.strip('text')}, '^\\|', ''), '\\|$', ''), '|'), lambda y: {Q.strip('y')})"
_TABLES = (
    f"(SELECT doc_id, line, min(line) OVER (PARTITION BY doc_id, g) AS start, c, len(list_filter(c, lambda y: regexp_matches(replace(y, ' ', ''), '^:?-{{3,}}:?$'))) = len(c) AS divider, len(list_filter(c, lambda y: {Q.strip('''replace(y, '<br>', '')''')} IN ('', '-', '–', '—'))) = len(c) AS blank "
    f"FROM (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g, {_PARTS_OF} AS c FROM {Q.DOC_LINES} WHERE {Q.TABLE_LINE}))"
)
_SHARE = "coalesce(avg(CASE WHEN {0} THEN CASE WHEN b THEN 1.0 ELSE 0.0 END END), 0.0)"
_BAND = "(CASE WHEN {0} THEN 1 ELSE 0 END)"
_TIMES = " + ".join(_BAND.format(x) for x in ("y < k", "y >= height - k", "x < k", "x >= width - k"))
_RING = (
    f"(SELECT vec_id, width, height, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS ink, {_SHARE.format('y >= trunc(height * 0.3) AND y < trunc(height * 0.7) AND x >= trunc(width * 0.3) AND x < trunc(width * 0.7)')} AS centre, sum(CASE WHEN b THEN {_TIMES} ELSE 0 END) / sum({_TIMES}) AS edge, "
    f"{_SHARE.format('x < width // 2')} AS l, {_SHARE.format('x >= width // 2')} AS r, {_SHARE.format('y < height // 2')} AS t, {_SHARE.format('y >= height // 2')} AS u FROM (SELECT *, v < 110 AS b, greatest(1, CAST(trunc(least(width, height) * 0.15) AS INTEGER)) AS k FROM {Q.PIXELS}) GROUP BY vec_id, width, height)"
)
_SHAPED = (
    "(SELECT *, CASE WHEN event IN ('page', 'done') THEN CAST(regexp_extract(line, '(\\d+)(?: of |/)(\\d+)', 1) AS INTEGER) WHEN event = 'range' THEN CAST(regexp_extract(line, 'page (\\d+) ', 1) AS INTEGER) END AS current, CASE WHEN event IN ('page', 'done') THEN CAST(regexp_extract(line, '(\\d+)(?: of |/)(\\d+)', 2) AS INTEGER) "
    "WHEN event = 'range' THEN CAST(regexp_extract(line, 'of (\\d+)', 1) AS INTEGER) END AS total, CASE WHEN regexp_matches(line, '^memory \\d+ percent') THEN 92.0::DOUBLE WHEN starts_with(line, 'stderr: retry') THEN 96.0::DOUBLE END AS stage FROM (SELECT *, CASE WHEN starts_with(line, '[warn] low score') THEN 'range' WHEN starts_with(line, 'reading page') THEN 'page' "
    "WHEN regexp_matches(line, '^layout done|^page \\d+/\\d+ written') THEN 'done' WHEN regexp_matches(line, '^memory \\d+ percent|^stderr: retry') THEN 'stage' END AS event FROM progress_log))"
)
_OUT = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'other ' || doc_id END"
_SPARSE = r"len(regexp_extract_all(replace(regexp_replace(text, '<img[^>]+>', '', 'g'), '\g<1>', ''), '[A-Za-z0-9\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')) < 30"
_ELEMENTS = {
    "detection": "SELECT layout_id, 'detection' AS kind, k AS parent_no, -1 AS child_no, e.content AS content, NULL AS role, e.box AS b, NULL::INTEGER AS row, NULL::INTEGER AS col, NULL::INTEGER AS row_span, NULL::INTEGER AS col_span, NULL::DOUBLE AS score, e.rec_score AS rec_score, e.det_score AS det_score, NULL::INTEGER AS x, NULL::INTEGER AS y FROM det WHERE e IS NOT NULL",
    "point": "SELECT layout_id, 'point', k, j, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, p[1], p[2] FROM (SELECT layout_id, k, CAST(unnest(range(len(e.points))) AS INTEGER) AS j, unnest(e.points) AS p FROM det) WHERE p IS NOT NULL",
    "paragraph": "SELECT layout_id, 'paragraph', k, -1, e.contents, e.role, e.box, NULL, NULL, NULL, NULL, e.score, NULL, NULL, NULL, NULL FROM par WHERE e IS NOT NULL",
    "table": "SELECT layout_id, 'table', k, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tab WHERE e IS NOT NULL",
    "cell": "SELECT layout_id, 'cell', k, j, c.contents, NULL, c.box, c.row, c.col, c.row_span, c.col_span, NULL, NULL, NULL, NULL, NULL FROM (SELECT layout_id, k, CAST(unnest(range(len(e.cells))) AS INTEGER) AS j, unnest(e.cells) AS c FROM tab) WHERE c IS NOT NULL",
    "figure": "SELECT layout_id, 'figure', k, -1, NULL, NULL, e.box, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fig WHERE e IS NOT NULL",
}
_WITH = ", ".join(f"{n} AS (SELECT layout_id, CAST(unnest(range(len({a}))) AS INTEGER) AS k, unnest({a}) AS e FROM {Q.LAYOUTS})" for n, a in (("det", "detections"), ("par", "paragraphs"), ("tab", "tables"), ("fig", "figures")))

_LINES = Q.lines(Q.MERGED, "doc_id, page")
_SNIPS = f"(SELECT doc_id, page, CAST((line + 2) // 3 AS INTEGER) AS rank, printf('eq_page%03d_%02d.png', page, (line + 2) // 3) AS name, text FROM {_LINES} WHERE line % 3 = 1)"

SQL = {
    "folder_issues": Q.issues(Q.lines("(SELECT source AS doc_id, doc_id AS page, text FROM documents)", "doc_id, page"), "doc_id, page", r"[\x{3040}-\x{9FFF}]"),
    "line_candidates": f"SELECT doc_id, page, line, rank FROM {Q.contained(_LINES, _SNIPS)}",
    "line_matches": f"WITH RECURSIVE {Q.matched(_LINES, _SNIPS)} SELECT * FROM placed",
    "line_links": Q.linked(_LINES, _SNIPS),
    "markdown_images": f"SELECT doc_id, line, regexp_replace(regexp_replace(text, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', CASE WHEN line % 2 = 0 THEN '<img src=\"\\2\" width=\"10\" alt=\"\\1\">' ELSE '<IMG class=\"x\" src=\"\\2\">' END, 'g'), '(?i)<img[^>]*?src=\"([^\"]+)\"[^>]*?(?:alt=\"([^\"]*)\")?[^>]*?>', '![\\2](\\1)', 'g') AS text FROM {Q.DOC_LINES} WHERE regexp_matches(text, '!\\[[^\\]]*\\]\\(')",
    "sanitized_math": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text LIKE '%$%' AND NOT contains(text, chr(92) || '-')",
    "markdown_line_counts": r"SELECT doc_id, CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM (SELECT doc_id, string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p FROM documents WHERE text IS NOT NULL)",
    "renamed_links": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(src="|\]\()(?:\./)?(?:figures/)?fig_page([0-9]+_[0-9]+\.png)(["\)])', '\1./figures/abb\2\3', 'g'), '(?:\./)?(?:figures/)?fig_page([0-9]+_[0-9]+\.png)', 'abb\1', 'g')) AS text_md5 FROM documents WHERE regexp_matches(text, 'fig_page[0-9]+_[0-9]+\.png')""",
    "dropped_figures": r"""SELECT doc_id, md5(regexp_replace(text, '!\[[^\]]*\]\((?:\./)?figures/' || n || '\)|<img[^>]+src="(?:\./)?figures/' || n || '"[^>]*>', '', 'g')) AS text_md5 FROM (SELECT doc_id, text, replace(regexp_extract(text, 'fig_page[0-9]+_[0-9]+\.png', 0), '.', '\.') AS n FROM documents) WHERE n <> ''""",
    "image_widths": "SELECT cell_id, round(CASE u WHEN 'cm' THEN v * 10 WHEN 'mm' THEN v ELSE v * 25.4 / 96 END, 6) AS mm FROM (SELECT cell_id, ['px', 'cm', 'mm', '', 'em'][cell_id % 5 + 1] AS u, CAST((cell_id % 977) || CASE WHEN cell_id % 3 = 0 THEN '.5' ELSE '' END AS DOUBLE) AS v FROM " + Q.CELLS + ")",
    "run_texts": f"SELECT region_id, nullif(CASE WHEN {Q.strip('b')} = '$$' THEN '' ELSE text END, '') AS text FROM (SELECT region_id, b, {Q.stripped('b')} AS text FROM (SELECT region_id, replace(text, '<br>', chr(10)) AS b FROM {Q.REGIONS} WHERE text IS NOT NULL))",
    "document_tables": f"SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(row_number() OVER (PARTITION BY doc_id, start ORDER BY line) - 1 AS INTEGER) AS k, array_to_string(list_transform(list_concat(c, list_transform(range(w - len(c)), lambda i: '')), lambda y: CASE WHEN {Q.strip('''replace(y, '<br>', chr(10))''')} = '-' THEN '' ELSE {Q.strip('''replace(y, '<br>', chr(10))''')} END), '|') AS row FROM (SELECT *, max(len(c)) OVER (PARTITION BY doc_id, start) AS w FROM (SELECT *, bool_or(NOT divider AND NOT blank) OVER (PARTITION BY doc_id, start) AS full_ FROM {_TABLES}) WHERE NOT full_ OR (NOT divider AND NOT blank))",
    "fallback_texts": f"SELECT doc_id, md5(CASE WHEN {_SPARSE} AND o <> '' THEN o ELSE text END) AS replaced, md5(CASE WHEN o <> '' THEN text || chr(10) || chr(10) || '<!-- tesseract -->' || chr(10) || chr(10) || o ELSE text END) AS merged FROM (SELECT *, {_OUT} AS o FROM documents WHERE text IS NOT NULL)",
    "asked_folders": "SELECT doc_id, CASE WHEN regexp_matches(doc_id, '_p[0-9]+-[0-9]+$') THEN doc_id WHEN length(doc_id) % 3 = 0 THEN doc_id || '_x1' ELSE doc_id END AS folder FROM (SELECT DISTINCT doc_id FROM page_files)",
    "resolved_folders": "WITH f AS (SELECT doc_id AS name, max(listed_at) AS mtime FROM page_files GROUP BY doc_id), s AS (SELECT DISTINCT regexp_replace(name, '_p[0-9]+-[0-9]+$', '') AS stem FROM f) SELECT stem, coalesce((SELECT name FROM f WHERE name = stem), (SELECT max_by(name, (mtime, name)) FROM f WHERE starts_with(name, stem || '_'))) AS folder FROM s",
    "safe_folders": f"SELECT DISTINCT name, {Q.strip('name')} <> '' AND NOT regexp_matches(name, '[/\\\\]') AND NOT contains(name, '..') AS safe FROM (SELECT unnest(string_split(path, '/')) AS name FROM page_files WHERE path IS NOT NULL)",
    "default_pages": f"SELECT doc_id, file_id, CASE WHEN page IS NULL AND n = 1 THEN 1 ELSE page END AS page FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, file_id, file_id // 40 AS g, CASE WHEN file_id % 2 = 0 THEN CAST(coalesce(nullif(regexp_extract({_NAME}, 'page_images_page_(\\d+)', 1), ''), nullif(regexp_extract({_NAME}, 'page_(\\d+)', 1), ''), nullif(regexp_extract({_NAME}, 'page(\\d+)', 1), '')) AS INTEGER) END AS page FROM (SELECT DISTINCT file_id, doc_id, pp FROM {Q.FILES})))",
    "numbered_pages": f"SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY name) + 4 AS INTEGER) AS page FROM (SELECT DISTINCT doc_id, concat_ws('#', {_NAME}, CAST(file_id AS VARCHAR)) AS name FROM {Q.FILES})",
    "collected_outputs": f"SELECT path, max(n_bytes) AS size FROM {Q.FILES} WHERE {Q.SUFFIX} IN ('.md', '.txt') AND doc_id IN (SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY path",
    "failed_outputs": f"SELECT file_id FROM {Q.FILES} WHERE n_bytes < CASE {Q.SUFFIX} WHEN '.md' THEN 10 WHEN '.docx' THEN 1000 ELSE 0 END",
    "layout_order": f"SELECT layout_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY string_split(path, '/')[-1], layout_id) AS INTEGER) AS n FROM {Q.LAYOUTS} WHERE path IS NOT NULL",
    "layout_images": f"SELECT layout_id, (SELECT min(path) FROM page_files p WHERE p.doc_id = l.doc_id AND p.page = l.page AND path IS NOT NULL) AS image FROM {Q.LAYOUTS} l",
    "regions_on_pages": f"SELECT region_id FROM {Q.REGIONS} r WHERE EXISTS (SELECT 1 FROM page_files p WHERE p.doc_id = r.doc_id AND p.page = r.page)",
    "layout_cell_rows": f"WITH {_WITH} SELECT layout_id, k AS table_no, j AS idx, c.row AS row, c.col AS col, c.contents AS text, c.row_span AS row_span, c.col_span AS col_span, array_to_string(c.box, ',') AS box FROM (SELECT layout_id, k, CAST(unnest(range(len(e.cells))) AS INTEGER) AS j, unnest(e.cells) AS c FROM tab) WHERE c IS NOT NULL",
    "p1_typed": f"WITH {_WITH} SELECT * EXCLUDE (b), array_to_string(list_transform(b, lambda v: coalesce(CAST(v AS VARCHAR), '')), ',') AS box FROM ({' UNION ALL '.join(_ELEMENTS.values())})",
    "pdf_pages": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND coalesce(n_pages, 0) > 0 THEN n_pages END AS pages, CASE WHEN doc_id % 7 = 0 THEN 'no PDF' WHEN coalesce(n_pages, 0) = 0 THEN 'no pages found' END AS note FROM documents",
    "picture_files": "SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN w END AS width, CASE WHEN vec_id % 9 <> 0 THEN h END AS height, CASE WHEN vec_id % 9 <> 0 THEN w * h END AS area FROM (SELECT vec_id, vec_id % 5000 + 1 AS w, vec_id % 777 + 1 AS h FROM embeddings)",
    "gamma_curves": "SELECT k, i, CAST(least(255, trunc(pow(i / 255.0::DOUBLE, 1.0::DOUBLE / g) * 255 + 0.5)) AS INTEGER) AS v FROM (SELECT CAST(range AS INTEGER) AS i FROM range(256)), (VALUES (0, 0.7::DOUBLE), (1, 1.0::DOUBLE), (2, 2.2::DOUBLE)) g(k, g)",
    "ring_measures": f"SELECT vec_id, round(ink, 6) AS ink, round(centre, 6) AS centre, round(edge, 6) AS edge, round(l, 6) AS left, round(r, 6) AS right, round(t, 6) AS top, round(u, 6) AS bottom, least(width, height) >= 8 AND ink BETWEEN 0.01 AND 0.25 AND edge > centre * 1.8 AND l / greatest(r, 1e-6) BETWEEN 0.6 AND 1.6 AND t / greatest(u, 1e-6) BETWEEN 0.6 AND 1.6 AS ring FROM {_RING}",
    "filtered_pictures": f"SELECT vec_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM (SELECT a.vec_id, a.y, a.x, CAST(median(b.v) AS INTEGER) AS m FROM {Q.PIXELS} a, (VALUES (-1), (0), (1)) i(dy), (VALUES (-1), (0), (1)) j(dx), {Q.PIXELS} b WHERE b.vec_id = a.vec_id AND b.y = greatest(0, least(a.height - 1, a.y + dy)) AND b.x = greatest(0, least(15, a.x + dx)) GROUP BY ALL) GROUP BY vec_id",
    "filled_cells": f"SELECT cell_id, CASE WHEN trim(coalesce(text, '')) = '' THEN coalesce(CASE WHEN len(box) = 4 THEN ['○', '□', NULL][cell_id % 3 + 1] END, text) ELSE text END AS text FROM {Q.CELLS}",
    "previews": "SELECT term_id, 'data:image/png;base64,' || base64(encode(term)) AS url FROM term_list",
    "heading_images": f"SELECT m.doc_id, m.page, coalesce(s.images, NULL) AS images FROM {Q.MERGED} m LEFT JOIN (SELECT doc_id, page, string_agg(name, ',' ORDER BY rank) AS images FROM {Q.SNIPPETS} GROUP BY doc_id, page) s ON s.doc_id = m.doc_id AND s.page = m.page",
    "placed_images": f"SELECT doc_id, line, n, CASE WHEN length(p) % 2 = 0 THEN p END AS file, CASE WHEN length(p) % 2 <> 0 THEN '[画像が見つかりません: ' || s || ']' END AS placeholder FROM (SELECT *, regexp_replace(s, '^\\./', '') AS p FROM (SELECT *, {Q.strip('src')} AS s FROM {_REFS}))",
    "image_references": f"SELECT doc_id, line, n, {Q.strip('src')} AS src FROM {_REFS}",
    "snippet_totals": "SELECT count(*) AS n_saved FROM (" + Q.SQL["top_regions"] + ")",
    "log_shapes": f"SELECT DISTINCT job_id, seq, event, current, total, stage FROM {_SHAPED} WHERE event IS NOT NULL",
    "staged_progress": f"SELECT job_id, seq, event, round(max(CASE WHEN event = 'done' THEN least(99.0, 90.0 * least(current, total) / greatest(total, 1)) ELSE stage END) OVER (PARTITION BY job_id ORDER BY seq), 6) AS progress FROM (SELECT DISTINCT job_id, seq, event, current, total, stage FROM {_SHAPED} WHERE event IN ('done', 'stage'))",
    "new_lines": "SELECT job_id, seq, max(seq) OVER (PARTITION BY job_id) AS next_cursor FROM (SELECT DISTINCT job_id, seq, line FROM progress_log) WHERE seq > 20",
    "job_snapshot": f"SELECT job_id, max_by(event, seq) AS event, max_by(current, seq) AS current, max_by(total, seq) AS total FROM {Q.LOG} WHERE event IS NOT NULL GROUP BY job_id",
}
