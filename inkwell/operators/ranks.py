"""Row numbers within groups of any size: no group has to be sorted by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``, the number (from 1) of each row within its ``group`` by ``order``.

    The rows are parted by ranges of group and order, so that a hot group spreads over many tasks. A row's number is its
    number within its group's rows of its part, and what the parts before hold of the group: a table of one row per
    group and part. Nulls in ``group`` are a group of their own; nulls in ``order`` come first; an empty table stays empty.
    ``df`` should be narrow: it is written once, because parts must not change between the two passes.
    """
    at = materialize(df.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], F.col("__p").alias("__q"), "__before")
    local = at.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "__p").orderBy(*order)))
    same = [local[c].eqNullSafe(parts[f"__g{k}"]) for k, c in enumerate(group)] + [local["__p"] == parts["__q"]]
    return local.join(parts, same).select(*df.columns, (F.col("__k") + F.col("__before")).cast("bigint").alias(out))
