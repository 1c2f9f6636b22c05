"""Rows that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small, materialize


def latest_delivery(df: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """Keep one row per ``key``: the one with the greatest ``order`` (nulls count as earliest).

    Wide rows are not shuffled: a narrow count finds the keys that repeat and their greatest ``order``, and every other row
    passes by in the one scan of the result. Only rows that tie in ``order`` go through a window. Rows with a null key
    are each their own record. Ties are broken by ``tie`` if given, then by the hash of the whole row, so that the same rows
    give the same result every time; rows that tie there, too, are copies.
    """
    k, o = F.col(key), F.col(order)
    again = df.where(k.isNotNull()).groupBy(k.alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.max(o).alias("__most")).where("__n > 1").select("__key", "__most")
    again = materialize(again, "again")
    small = is_small(again)
    last = F.broadcast(again) if small else again
    at = df.select(k.alias("__k"), o.alias("__o")).join(last, F.col("__k") == F.col("__key")).where(F.col("__o").eqNullSafe(F.col("__most")))
    ties = materialize(at.groupBy(F.col("__k").alias("__tied")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__tied"), "ties")
    out = df.join(last, k == F.col("__key"), "left").where(F.col("__key").isNull() | o.eqNullSafe(F.col("__most"))).select(df["*"])
    if not ties.limit(1).count():
        return out
    ties = F.broadcast(ties) if small else ties
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    by = ([F.col(tie).asc_nulls_last()] if tie else []) + [F.xxhash64(*hashed)]
    many = out.join(ties, k == F.col("__tied"), "left_semi").withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("__r = 1").drop("__r")
    return out.join(ties, k == F.col("__tied"), "left_anti").unionByName(many)
