"""Writers of many small outputs: partitioned by document, no document put together in memory.

All writers go through ``commit``: written beside, then renamed, so that readers see all or nothing (ORC-21).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compact import _delete, _rename


def commit(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], overwrite: bool = False) -> None:
    """Write beside ``path`` and rename. An existing output stays unless ``overwrite``."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    write(df, staging)
    if overwrite:
        _delete(spark, path)
    try:
        _rename(spark, staging, path)
    except RuntimeError:
        _delete(spark, staging)
        raise


def write_sections(sections: DataFrame, path: str, key: str = "doc_id", overwrite: bool = False) -> None:
    """SNK-01: merged documents as text, one folder per document, its sections (which end with a newline) in order. Large
    documents become several files whose names sort in order."""
    value = F.regexp_replace("section", r"\n\z", "")  # the writer ends every row with one
    out = sections.repartitionByRange(key, "page").sortWithinPartitions(key, "page").select(key, value.alias("value"))
    commit(out, path, lambda d, p: d.write.partitionBy(key).text(p), overwrite)


def write_issues(issues: DataFrame, path: str, overwrite: bool = False) -> bool:
    """SNK-03: the review list as CSV; no file, and an old one deleted, if there is nothing to review."""
    if not issues.limit(1).count():
        _delete(issues.sparkSession, path)
        return False
    commit(issues, path, lambda d, p: d.write.option("header", True).csv(p), overwrite)
    return True


def csv_line(values: Column) -> Column:
    """Values as one CSV line: quoted where a comma, quote or line end is inside."""
    one = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(values, one), ",")


def segment_lines(segments: DataFrame, file: str = "file") -> DataFrame:
    """SNK-04: header and data lines of the file of each segment."""
    rows = F.concat(F.array("header"), F.col("data"))
    return segments.select(file, F.posexplode(rows).alias("line", "row")).select(file, "line", csv_line(F.col("row")).alias("value"))


def write_csv_files(lines: DataFrame, path: str, file: str = "file", overwrite: bool = False) -> None:
    """SNK-04: one folder per file name, its lines in order."""
    out = lines.repartitionByRange(file, "line").sortWithinPartitions(file, "line").select(file, "value")
    commit(out, path, lambda d, p: d.write.partitionBy(file).option("lineSep", "\r\n").text(p), overwrite)


def append_log(records: DataFrame, path: str) -> None:
    """SNK-11: records appended as JSON lines; nothing that is there is read or rewritten."""
    records.write.mode("append").json(path)


def meta_rows(df: DataFrame, keys: Sequence[str], **facts: str) -> DataFrame:
    """SNK-08, ARR-07: key and value rows of a sheet about each workbook: facts, number of sheets, and a link to each."""
    per = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment_no", "sheet"))).alias("s"))
    fixed = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in facts.items()]
    count = F.struct(F.lit("sheets").alias("k"), F.size("s").cast("string").alias("v"))
    links = F.transform("s", lambda x: F.struct(F.lit("sheet").alias("k"), F.concat(F.lit("#'"), x["sheet"], F.lit("'!A1")).alias("v")))
    return per.select(*keys, F.posexplode(F.concat(F.array(*fixed, count), links)).alias("n", "x")).select(*keys, "n", F.col("x.k").alias("key"), F.col("x.v").alias("value"))


def review_column(header: Column, width: Column) -> Column:
    """SNK-09: a status column two columns behind the table."""
    return F.concat(header, F.array_repeat(F.lit(""), 2), F.array(F.lit("ステータス")))


def preview(images: DataFrame) -> DataFrame:
    """SNK-14: images as data URLs."""
    return images.withColumn("url", F.concat(F.lit("data:image/png;base64,"), F.base64("content")))
