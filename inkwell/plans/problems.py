"""Queries of the general training-data problems (1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compact import compact
from ..operators.delivery import latest_delivery
from ..operators.nested import flatten_layouts, flatten_raw
from ..session import read


def p1_elements(spark: SparkSession, sf_dir: str, payload: bool = True) -> DataFrame:
    """Every element of the typed and the raw page records, with its payload and its link to the parent."""
    typed = latest_delivery(read(spark, sf_dir, "layout_json"), "layout_id", "ingested_at")
    raw = read(spark, sf_dir, "layout_raw")
    return flatten_layouts(typed, payload).unionByName(flatten_raw(raw, payload))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_elements(spark, sf_dir, payload=False)


def p3_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated page parts: every record once, in few files."""
    return compact(read(spark, sf_dir, "page_files")).drop("bin")


def p3_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the page parts went to, with their records and bytes of text."""
    return compact(read(spark, sf_dir, "page_files")).groupBy("bin").agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("text_bytes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_compacted(spark, sf_dir).select("file_id")
