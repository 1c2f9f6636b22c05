"""From result folders to merged Markdown, review lists, CSV files, workbooks and documents.

``python -m inkwell --input FOLDERS --output FOLDER --formats md csv xlsx docx`` runs where recognisers stop: on page
Markdown and layout JSON. What stands behind ``--`` is kept for the recogniser.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cli_int, cli_value, suffix
from ..functions.text import strip
from ..operators import lines as L
from ..operators import merge as MG
from ..operators import tables as T
from ..sinks import files as W
from ..sinks import office, sheets
from ..sources import files as S


@dataclass(frozen=True)
class RecognizerOptions:
    """ORC-16: what a recogniser is asked for, and its arguments."""

    mode: str = "lite"
    device: str = "cpu"
    figures: bool = True
    extra: Sequence[str] = field(default_factory=tuple)

    def arguments(self, fmt: str = "md") -> list[str]:
        out = ["--lite"] if self.mode == "lite" else []
        out += ["-d", self.device]
        if self.figures and fmt == "md":
            out.append("--figure")
        return out + list(self.extra)


def split_args(argv: Sequence[str]) -> tuple[list[str], list[str]]:
    """Own arguments and those for the recogniser, parted by the first ``--``."""
    argv = list(argv)
    at = argv.index("--") if "--" in argv else len(argv)
    return argv[:at], argv[at + 1 :]


def with_flags(extra: Sequence[str], **flags: bool) -> list[str]:
    """ORC-21: flags appended that are not there yet."""
    out = list(extra)
    for name, on in flags.items():
        flag = "--" + name.replace("_", "-")
        if on and flag not in out:
            out.append(flag)
    return out


def output_folder(stem: Column, args: Column) -> Column:
    """ORC-04: the folder name that arguments ask for: by label, by page range, else the stem; null where only the start is
    given, for then the number of pages decides."""
    label, start, end = cli_value(args, "label"), cli_int(args, "start"), cli_int(args, "end")
    return (
        F.when(label.isNotNull() & (label != ""), F.concat_ws("_", stem, label))
        .when(end.isNotNull(), F.concat(stem, F.lit("_p"), F.coalesce(start, F.lit(1)).cast("string"), F.lit("-"), end.cast("string")))
        .when(start.isNotNull(), F.lit(None).cast("string"))
        .otherwise(stem)
    )


def resolved_folders(inputs: DataFrame, folders: DataFrame) -> DataFrame:
    """ORC-04, JON-11: the folder of each input (``stem``, ``args``): the one its arguments ask for if it is there or asked
    for by label; with a start only, the newest that begins so; else the newest of the stem."""
    want = inputs.withColumn("wanted", output_folder(F.col("stem"), F.col("args"))).withColumn("start", cli_int(F.col("args"), "start")).withColumn("label", cli_value(F.col("args"), "label"))
    there = folders.select(F.col("name").alias("wanted"), F.lit(True).alias("there")).distinct()
    begun = folders.select(F.regexp_extract("name", r"^(.*_p[0-9]+-)[0-9]+$", 1).alias("begin"), "name", "mtime").where("begin <> ''").groupBy("begin").agg(F.max_by("name", F.struct("mtime", "name")).alias("by_start"))
    got = want.join(there, "wanted", "left").withColumn("begin", F.concat("stem", F.lit("_p"), F.col("start").cast("string"), F.lit("-"))).join(begun, "begin", "left")
    got = MG.latest_folder(got, folders)
    asked = F.when(F.col("there") | (F.coalesce("label", F.lit("")) != ""), F.col("wanted"))
    by_start = F.when(F.col("wanted").isNull(), F.col("by_start"))
    return got.select("stem", "args", F.coalesce(asked, by_start, "folder", "wanted", "stem").alias("folder"))


def collect_outputs(listing: DataFrame, inputs: DataFrame, formats: Sequence[str]) -> DataFrame:
    """ORC-13: the files of the wanted formats in the folders of the inputs (``folder``), each once, in order."""
    wanted = listing.where(suffix(F.col("path")).isin(*["." + f for f in formats]))
    return wanted.join(inputs.select("folder").distinct(), "folder", "left_semi").groupBy("path").agg(F.first("folder").alias("folder"), F.max("size").alias("size")).orderBy("path")


# Sizes in bytes below which an output is taken to have failed.
LEAST_BYTES = {".md": 10, ".docx": 1000}


def self_test(listing: DataFrame) -> DataFrame:
    """ORC-14: outputs that are smaller than any good one."""
    least = F.lit(0)
    for ext, n in LEAST_BYTES.items():
        least = F.when(suffix(F.col("path")) == ext, n).otherwise(least)
    return listing.where(F.col("size") < least)


def placed_images(references: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-16: references with the file they show (``src`` without a leading ``./``), or the text in its place."""
    known = files.select(F.col("path").alias("__path")).distinct()
    r = references.withColumn("__src", F.regexp_replace(strip(F.col("src")), r"^\./", ""))
    out = r.join(known, r["__src"] == known["__path"], "left")
    missing = F.concat(F.lit("[画像が見つかりません: "), strip(F.col("src")), F.lit("]"))
    return out.withColumn("file", F.col("__path")).withColumn("placeholder", F.when(F.col("__path").isNull(), missing)).drop("__src", "__path")


def images_at_headings(blocks: DataFrame, snippets: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """JON-07: page headings of a block stream with the names of their page's snippets, in order."""
    per = snippets.groupBy(*keys, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("images"))
    page = F.regexp_extract("text", r"(\d+)\s*$", 1).try_cast("int")
    return blocks.where("kind = 'page'").withColumn("page", page).join(per, [*keys, "page"], "left")


def convert(spark: SparkSession, folders: str, out: str, formats: Sequence[str] = ("md",), excel_mode: str = "table", overwrite: bool = False, layouts: str | None = None) -> dict[str, str]:
    """ORC-01: all wanted outputs of the folders that ``folders`` (a path or glob) names. Gives the paths by kind.

    ``layouts`` is the place of the layout JSON inside a folder, as the recogniser names it. Folders without, and documents without tables, get their text instead of tables (JON-09).
    """
    done: dict[str, str] = {}
    files = S.read_pages(spark, f"{folders}/*.md")
    pages, issues = MG.merge(files)
    if "md" in formats:
        W.write_sections(MG.sections(pages), f"{out}/md", overwrite=overwrite)
        done["md"] = f"{out}/md"
        if W.write_issues(issues, f"{out}/math_review.csv", overwrite=overwrite):
            done["review"] = f"{out}/math_review.csv"
    lines = L.explode_lines(MG.sections(pages).withColumnRenamed("section", "text"), "doc_id", "page")
    if "docx" in formats:
        stream = L.blocks(lines, ["doc_id", "page"]).withColumn("block", F.struct("page", "block"))
        volume = F.when(F.col("volume") == 1, "").otherwise(F.concat(F.lit("_"), F.col("volume").cast("string")))
        _write_office(office.documents(stream).select(F.concat("doc_id", volume, F.lit(".docx")).alias("file"), "content"), f"{out}/docx")
        done["docx"] = f"{out}/docx"
    if {"csv", "xlsx"} & set(formats):
        cells = spark.createDataFrame([], S.CELLS)
        if layouts:
            try:
                cells = S.layout_cells(S.read_layouts(spark, f"{folders}/{layouts}/*.json", layouts))
            except AnalysisException:  # no layout at all
                pass
        plain = L.explode_lines(pages.select("doc_id", "page", F.col("text")), "doc_id", "page")
        paragraphs = L.paragraphs(plain, ["doc_id", "page"])
        paragraphs = MG.tables_or_text(cells, paragraphs).withColumn("paragraph", (F.col("page") * 1_000_000 + F.col("paragraph")).cast("bigint"))
        named = T.sheets(cells)
        if "csv" in formats:
            text = paragraphs.select(F.concat("doc_id", F.lit("__text")).alias("file"), F.col("paragraph").alias("line"), W.csv_line(F.array("text")).alias("value"))
            body = W.segment_lines(named) if excel_mode == "table" else T.layout_rows(cells).select(F.format_string("%s__table_p%03d_%02d", "doc_id", "page", "table_no").alias("file"), F.col("r").alias("line"), W.csv_line(F.col("values")).alias("value"))
            W.write_csv_files(body.withColumn("line", F.col("line").cast("bigint")).unionByName(text), f"{out}/csv", overwrite=overwrite)
            done["csv"] = f"{out}/csv"
        if "xlsx" in formats:
            books = sheets.segment_sheets(named) if excel_mode == "table" else sheets.layout_sheets(cells)
            _write_office(office.workbooks(books.unionByName(sheets.text_sheets(paragraphs))), f"{out}/xlsx")
            done["xlsx"] = f"{out}/xlsx"
    return done


def _write_office(made: DataFrame, path: str) -> None:
    made.sparkSession.dataSource.register(office.OfficeFiles)
    made.write.format("office_files").option("path", path).mode("append").save()


def delete_consumed(spark: SparkSession, paths: Sequence[str]) -> None:
    """SNK-02: page files away, once what was made of them is committed."""
    for p in paths:
        W._delete(spark, p)


def main(argv: Sequence[str]) -> dict[str, str]:
    own, extra = split_args(argv)
    p = argparse.ArgumentParser(prog="inkwell")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--formats", nargs="+", default=["md"], choices=["md", "csv", "xlsx", "docx"])
    p.add_argument("--excel-mode", default="table", choices=["table", "layout"])
    p.add_argument("--layouts", help="where in a folder its layout JSON is; tables need it")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(own)
    from ..session import session

    if extra:
        print("for the recogniser:", *extra)
    return convert(session(), a.input, a.output, a.formats, a.excel_mode, a.overwrite, a.layouts)
