"""Problem 3: very many tiny page files into few well-sized ones.

The listing is frozen as a manifest (one narrow row per distinct record, with size and checksum), the manifest
is bin-packed by first-fit decreasing, every bin is rewritten as one file, the rewritten files are read back and
held against the manifest's row counts and checksums, and only then does one rename make them visible.

Records are hashed by ``file_id`` into groups, sized by bytes and by rows, so that neither many bytes nor many empty texts
meet in one task, and a folder or record that holds a third of all files is spread over all groups. Each group is packed on its
own: at most one bin a group stays less than half full. The texts are shuffled once, by the same hash, so that a group's
bins lie together; there they are sorted by bin, and each bin flows into a file of its own, all files in one folder, with
their names in a table beside it. A file that a lost or repeated task left behind is in no such table, and is deleted
before the rename.

Results for odd input:
  * rows without a path are each their own record; names without a page number are no page parts and are left out;
  * null and empty texts are kept as they are (and are different records); line ends (CRLF, CR, LF, and one or more at
    the very end) do not make a difference, and the row with the lowest ``file_id`` is the one that is kept, unchanged;
  * a record larger than the target gets a bin of its own;
  * a ``file_id`` that is listed more than once counts as one record, that of its shortest text, and one of its rows with that text is kept;
  * an empty listing gives an empty, committed result;
  * other columns are carried along, whatever their names (a column named like one of ours, ``bin`` or starting with
    ``__``, is not).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir

#: Fixed value: what the name of a page file looks like.
PAGE_NAME = r"^(?:.*_)?page_?([0-9]+)(?:_p([0-9]+))?\.md$"


def path_parts(path: Column) -> Column:
    """The parts of a path however it is spelled: back-slashes, schemes, drives, doubled slashes, ``.`` and ``..``."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    return F.aggregate(parts, none, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))


def same_text(text: Column) -> Column:
    """Text with all line ends alike and none at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+$", "")


def with_record(files: DataFrame) -> DataFrame:
    """Adds ``__folder``, ``__name`` and ``__record`` (a 128-bit key of the record); keeps page parts only."""
    named = files.withColumn("__parts", path_parts(F.col("path")))
    last = F.when(F.size("__parts") >= 1, F.element_at("__parts", -1))
    before = F.when(F.size("__parts") >= 2, F.element_at("__parts", -2))
    named = named.withColumn("__name", last).withColumn("__folder", before).drop("__parts")
    key = F.when(F.col("path").isNull(), F.concat(F.lit("id:"), F.col("file_id").cast("string"))).otherwise(
        F.md5(F.to_binary(F.concat_ws("/", F.coalesce("__folder", F.lit("")), "__name", F.when(F.col("text").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), same_text(F.col("text"))))), F.lit("utf-8")))
    )
    return named.where(F.col("path").isNull() | F.col("__name").rlike(PAGE_NAME)).withColumn("__record", key)


def text_sum(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def first_fit_decreasing(sizes: np.ndarray, target: int) -> np.ndarray:
    """The bin of each item: items by falling size, each into the first bin with room."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    free = np.empty(64, dtype=np.int64)
    n = 0
    for k in np.argsort(-sizes, kind="stable"):
        fits = free[:n] >= sizes[k]
        b = int(fits.argmax()) if n and fits.any() else n
        if b == n:
            if n == len(free):
                free = np.concatenate([free, np.empty(n, dtype=np.int64)])
            free[n] = max(target, sizes[k])
            n += 1
        free[b] -= sizes[k]
        bins[k] = b
    return bins


#: Bytes of the smallest and the largest target, and files that a listing becomes at least, if it is large enough.
SMALLEST, LARGEST, LEAST_FILES = 64 << 10, 64 << 20, 32


def target_for(total: int) -> int:
    """Bytes of text of a well-sized file: as large as ``LARGEST``, but enough files that they can be read in parallel."""
    return max(SMALLEST, min(LARGEST, total // LEAST_FILES))


def pack(manifest: DataFrame, target: int, bins_per_group: int = 4, rows_per_group: int = 100_000) -> tuple[DataFrame, int]:
    """Adds ``bin`` to a manifest of ``file_id``, ``bytes`` and ``sum``; and the number of groups."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-int(total["b"]) // (target * bins_per_group)), -(-total["n"] // rows_per_group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            table = table.sort_by("file_id")
            names = [f"{g:06d}-{b:05d}" for g, b in zip(table["group"].to_pylist(), first_fit_decreasing(table["bytes"].to_numpy(), target))]
            yield from table.drop_columns("group").append_column("bin", pa.array(names, pa.string())).combine_chunks().to_batches()

    grouped = manifest.select("file_id", "bytes", "sum").repartition(groups, "file_id").withColumn("group", F.spark_partition_id())
    return grouped.mapInArrow(run, "file_id bigint, bytes bigint, sum bigint, bin string"), groups


def manifest_of(files: DataFrame) -> DataFrame:
    """One narrow row per record: the lowest ``file_id``, the bytes and checksum of its text."""
    narrow = with_record(files).select("__record", "file_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), text_sum(F.col("text")).alias("sum"))
    return narrow.groupBy("__record").agg(F.min(F.struct("file_id", "bytes", "sum")).alias("f")).select("f.file_id", "f.bytes", "f.sum")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, src: str, dst: str) -> None:
    (p, fs), (q, _) = _fs(spark, src), _fs(spark, dst)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        raise RuntimeError(f"could not commit {dst}")


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def verify(written: DataFrame, manifest: DataFrame) -> int:
    """Row counts and checksums of every bin against the manifest. Gives the rows; raises where anything differs."""
    per = lambda d, s: d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("file_id", s).cast("bigint")).alias("s"))
    a, b = per(manifest, F.col("sum")).alias("a"), per(written, text_sum(F.col("text"))).alias("b")
    both = a.join(b, "bin", "full_outer").withColumn("off", ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.s").eqNullSafe(F.col("b.s"))))
    r = both.agg(F.coalesce(F.sum("a.n"), F.lit(0)).alias("rows"), F.min(F.when(F.col("off"), F.col("bin"))).alias("bad")).first()
    if r["bad"] is not None:
        raise ValueError(f"rewritten bins differ from the manifest: {r['bad']} and perhaps others")
    return r["rows"]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def write_bins(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows that come sorted by ``bin`` within their partitions, a file for each bin: (bin, file, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
        done: list[tuple[str, str, int]] = []
        writer, name, now, n = None, "", None, 0
        for b in batches:
            bins = b.column("bin")
            ends = [0, *(np.flatnonzero(np.asarray(pc.not_equal(bins.slice(1), bins.slice(0, len(bins) - 1)))) + 1).tolist(), len(bins)] if len(bins) else [0]
            for lo, hi in zip(ends, ends[1:]):
                this = bins[lo].as_py()
                if this != now:
                    if writer:
                        writer.close()
                        done.append((now, name, n))
                    now, n, name = this, 0, f"part-{this}-{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(f"{at}/{name}", b.schema, filesystem=fs)
                writer.write_batch(b.slice(lo, hi - lo))
                n += hi - lo
        if writer:
            writer.close()
            done.append((now, name, n))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["bin", "file", "rows"])

    return rows.mapInArrow(run, "bin string, file string, rows bigint")


def _drop_strays(spark: SparkSession, folder: str, files: DataFrame, n: int) -> None:
    """Delete files that no finished task reported; one look at their number tells whether there are any."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p) or fs.getContentSummary(p).getFileCount() == n:
        return
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    for r in there.join(files, "file", "left_anti").toLocalIterator():
        _delete(spark, f"{folder}/{r.file}")


def compact(files: DataFrame, out: str | None = None, target: int | None = None, bins_per_group: int = 4, rows_per_group: int = 100_000) -> DataFrame:
    """Rewrite the page files of a listing into files of about ``target`` bytes of text; gives the committed table.

    ``out`` is the folder that appears by one rename once all is verified (by default one in the shared folder): ``data``
    has the files, ``bins`` the bin, name and rows of each.
    """
    spark = files.sparkSession
    carried = [c for c in files.columns if not c.startswith("__") and c != "bin"]
    # the listing may grow while we work: what is in the manifest is what gets rewritten
    again = _repeats(files)
    listed = manifest_of(files)
    if again:
        listed = listed.groupBy("file_id").agg(F.min(F.struct("bytes", "sum")).alias("f")).select("file_id", "f.bytes", "f.sum")
    listed = materialize(listed, "listed")
    if target is None:
        target = target_for(int(listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]))
    packed, groups = pack(listed, target, bins_per_group, rows_per_group)
    manifest = materialize(packed, "manifest")
    staging = f"{shared_dir(spark)}/inkwell/staging-{uuid.uuid4().hex}"
    out = out or f"{shared_dir(spark)}/inkwell/compacted-{uuid.uuid4().hex}"
    # one shuffle of the texts, by what groups them; all that follows stays in place
    wide = files.select(carried).repartition(groups, "file_id")
    narrow = manifest.select(F.col("file_id").alias("__id"), F.col("sum").alias("__sum"), "bin").repartition(groups, "__id")
    kept = wide.join(narrow, wide["file_id"] == narrow["__id"]).where(text_sum(F.col("text")) == F.col("__sum"))
    if again:
        one = F.row_number().over(Window.partitionBy("file_id").orderBy(F.hash(*carried)))
        kept = kept.withColumn("__one", one).where("__one = 1")
    ready = kept.select(*carried, "bin").sortWithinPartitions("bin", "file_id")
    written = materialize(write_bins(ready, f"{staging}/data"), "written")
    n = written.count()
    _drop_strays(spark, f"{staging}/data", written, n)
    schema = ready.schema
    made = spark.read.schema(schema).parquet(f"{staging}/data") if n else spark.createDataFrame([], schema)
    try:
        rows = verify(made, manifest)
    except Exception:
        _delete(spark, staging)
        raise
    written.coalesce(max(1, n // 1_000_000)).write.parquet(f"{staging}/bins")
    facts = json.dumps({"rows": rows, "files": n, "target": target})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{staging}/facts")
    _rename(spark, staging, out)
    return spark.read.schema(schema).parquet(f"{out}/data") if n else spark.createDataFrame([], schema)


def _repeats(files: DataFrame) -> bool:
    """Whether a ``file_id`` occurs more than once (it should not); a narrow count."""
    return bool(files.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
