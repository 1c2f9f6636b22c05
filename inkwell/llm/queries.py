"""Queries of the problems on training text, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import latest_delivery
from ..session import read
from . import denoise, encoding, leakage, mojibake, texttypes, unify


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, pos, text) of all cells and detections; ``pos`` counts null elements too."""
    cells = latest_delivery(read(spark, sf_dir, "cells"), "cell_id", "seen_at").select(F.lit("cells").alias("src"), F.col("cell_id").alias("row_id"), F.lit(0).alias("pos"), "text")
    pages = latest_delivery(read(spark, sf_dir, "layout_json"), "layout_id", "ingested_at")
    lines = pages.select("layout_id", F.posexplode("detections.content").alias("pos", "text")).select(F.lit("layout_json").alias("src"), F.col("layout_id").alias("row_id"), "pos", "text")
    return cells.unionByName(lines)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.matching_terms(labels(spark, sf_dir), read(spark, sf_dir, "term_list"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every cell and detection."""
    return unify.unify(labels(spark, sf_dir), "text")


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, cells and regions as of their latest delivery, and the lexicon."""
    cells = latest_delivery(read(spark, sf_dir, "cells"), "cell_id", "seen_at").select(F.lit("cells").alias("src"), F.col("cell_id").alias("row_id"), "text", F.lit(True).alias("whole_cell"))
    regions = latest_delivery(read(spark, sf_dir, "regions"), "region_id", "seen_at").select(F.lit("regions").alias("src"), F.col("region_id").alias("row_id"), "text", F.lit(False).alias("whole_cell"))
    return denoise.page_lines(latest_delivery(read(spark, sf_dir, "layout_json"), "layout_id", "ingested_at")), cells.unionByName(regions), read(spark, sf_dir, "lexicon")


def p4_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong where, and what it should be."""
    return denoise.noise(*scanned(spark, sf_dir)).distinct()


def p4_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every page, cell and region."""
    return denoise.readable(*scanned(spark, sf_dir)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.noise(*scanned(spark, sf_dir)).select("src", "row_id", "pos", "kind").distinct()


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texttypes.page_texts(read(spark, sf_dir, "layout_json")).select(F.lit("layout_json").alias("src"), F.col("layout_id").alias("row_id"), "order", "text")
    regions = read(spark, sf_dir, "regions").select(F.lit("regions").alias("src"), F.col("region_id").alias("row_id"), F.col("seen_at").alias("order"), "text")
    return pages.unionByName(regions)


def p5_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, type and posterior of every page and region."""
    common = read(spark, sf_dir, "lexicon").where("is_common")
    return texttypes.classify(typed_texts(spark, sf_dir), common, {"layout_json": ("formula",)})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_types(spark, sf_dir).where("kind <> 'prose'").select("src", "row_id", "kind")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(read(spark, sf_dir, "documents"))


def p6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many pieces the ids of each document are strung together."""
    return encoding.chunks_of(read(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document, decoded again from its ids; null texts come out empty."""
    return encoding.decode(p6_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document with its restored text."""
    return mojibake.affected(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lexicon"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p4_found": p4_found,
    "p4_noise": p4_noise,
    "p4_readable": p4_readable,
    "p5_found": p5_found,
    "p5_types": p5_types,
    "p6_ids": p6_ids,
    "p6_chunks": p6_chunks,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

SQL = {
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents",
}
