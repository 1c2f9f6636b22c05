"""Session defaults, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: What a side of a join may have to be broadcast: rows, and bytes of all that is in them.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_RUN = uuid.uuid4().hex


def session(master: str = "local[*]", app: str = "inkwell", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of this machine in local mode
    (tests); on a cluster that is refused, for executors on other machines could not read it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "inkwell-shared")
        os.makedirs(d, exist_ok=True)
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. Survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/inkwell/run-{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this run. DataFrames made from it can't be read any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkwell/run-{_RUN}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _bytes_of(value: Column, t: DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(t, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(t, StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in t.fields), F.lit(16).cast("bigint"))
    if isinstance(t, ArrayType):
        return F.aggregate(F.coalesce(F.transform(value, lambda x: _bytes_of(x, t.elementType)), F.array().cast("array<bigint>")), F.lit(16).cast("bigint"), lambda a, x: a + x)
    if isinstance(t, MapType):
        return _bytes_of(F.map_entries(value), ArrayType(StructType().add("key", t.keyType).add("value", t.valueType)))
    return F.lit(16).cast("bigint")


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, by one distributed pass."""
    one = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: by its rows and by its bytes."""
    n, b = size_of(df)
    return n <= rows and b <= size


def small_or_not(df: DataFrame, name: str, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Write a narrow side once, measure it, and hint a broadcast only if it has at most ``limit`` rows and ``size`` bytes.

    Beyond these the plain table is returned and the join shuffles.
    """
    kept = materialize(df, name)
    return F.broadcast(kept) if is_small(kept, limit, size) else kept


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
