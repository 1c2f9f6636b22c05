"""Progress of jobs from their log lines, as a stream with state per job and as the same thing in batch.

A line's meaning does not depend on other lines; progress is the running maximum of what its lines say, and the time
left is the mean of the last five page times by the pages left. In the stream, lines count in the order of
arrival; repeated lines (job, seq) change nothing; late lines can't lower the progress. Lines without a time, and null
or empty lines, carry no page time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of log lines of the two writers, and how far a job is when recognition ends and at most.
RANGE = r"^処理範囲:\s*(\d+)\s*〜\s*(\d+)"
PAGE = r"^--- Page (\d+)/(\d+)|^reading page (\d+) of (\d+)"
DONE = r"^--- Done (\d+)/(\d+)|^layout done: (\d+)/(\d+)|^page (\d+)/(\d+) written"
RECOGNITION, MOST, WINDOW = 90.0, 99.0, 5


def _number(line: Column, pattern: str, *groups: int) -> Column:
    found = [F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in groups]
    return F.coalesce(*found).cast("int")


#: (mark, progress): a line that contains the mark enters a stage behind recognition. The first mark of the list counts.
Stages = Sequence[tuple[str, float]]


def events(log: DataFrame, line: str = "line", stages: Stages = ()) -> DataFrame:
    """STR-02: adds what a line says: ``event`` (range, page, done, stage or null), ``current``, ``total``, ``stage``.

    The marks of the ``stages`` are the caller's: the exact strings that the programs behind recognition write.
    """
    x = F.col(line)
    stage = F.lit(None).cast("double")
    for mark, value in reversed(list(stages)):
        stage = F.when(x.contains(mark), value).otherwise(stage)
    event = F.when(x.rlike(RANGE), "range").when(x.rlike(PAGE), "page").when(x.rlike(DONE), "done").when(stage.isNotNull(), "stage")
    current = F.coalesce(_number(x, RANGE, 1), _number(x, PAGE, 1, 3), _number(x, DONE, 1, 3, 5))
    total = F.coalesce(_number(x, RANGE, 2), _number(x, PAGE, 2, 4), _number(x, DONE, 2, 4, 6))
    return log.withColumn("event", event).withColumn("current", current).withColumn("total", total).withColumn("stage", stage)


def progress(log: DataFrame, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("seq",), ts: str = "ts", stages: Stages = ()) -> DataFrame:
    """TYP-10, AGG-17 in batch: per line that ends a page or enters a stage, the progress so far and the seconds left."""
    e = events(log, stages=stages).dropDuplicates([*keys, *order]).where("event in ('page', 'done', 'stage')")
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    started = F.when(F.lag("event").over(w) == "page", F.lag(F.col(ts)).over(w))
    secs = F.when(F.col("event") == "done", F.timestamp_diff("MICROSECOND", started, F.col(ts)) / 1e6)
    e = e.withColumn("__secs", F.when(secs > 0, secs)).where("event <> 'page'")
    reached = F.when(F.col("event") == "done", F.least(F.lit(MOST), RECOGNITION * F.least(F.col("current"), F.col("total")) / F.greatest(F.col("total"), F.lit(1)))).otherwise(F.col("stage"))
    e = e.withColumn("progress", F.max(reached).over(upto))
    # the mean of the last page times over a frame of that many rows, carried to the lines that have none
    timed = Window.partitionBy(*keys, F.col("__secs").isNotNull()).orderBy(*order).rowsBetween(1 - WINDOW, 0)
    e = e.withColumn("__mean", F.when(F.col("__secs").isNotNull(), F.avg("__secs").over(timed)))
    mean = F.last("__mean", ignorenulls=True).over(upto)
    left = F.greatest(F.col("total") - F.col("current"), F.lit(0))
    return e.select(*keys, *order, "event", "current", "total", "progress", F.when((F.col("event") == "done") & (left > 0), F.round(mean * left).cast("bigint")).alias("eta_seconds"))


STATE = "progress double, current int, total int, started double, secs array<double>, last_seq bigint"
OUTPUT = "job_id string, progress double, current int, total int, eta_seconds bigint, lines bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    prog, cur, tot, started, secs, last = state.get if state.exists else (0.0, None, None, None, [], -1)
    secs, n, eta = list(secs or []), 0, None
    for pdf in batches:
        for r in pdf.sort_values("seq", kind="stable").itertuples(index=False):
            if r.seq <= last:  # delivered before, or too late to matter
                continue
            last, n = int(r.seq), n + 1
            at = None if pd.isna(r.ts) else r.ts.timestamp()
            if r.event == "page":
                cur, tot, started, eta = int(r.current), int(r.total), at, None
            elif r.event == "done":
                if started is not None and at is not None and at > started:
                    secs = [*secs, at - started][-WINDOW:]
                cur, tot, started = int(r.current), int(r.total), None
                prog = max(prog, min(MOST, RECOGNITION * min(cur, tot) / max(tot, 1)))
                eta = round(sum(secs) / len(secs) * (tot - cur)) if secs and tot > cur else None
            elif r.event == "stage":
                prog, eta = max(prog, float(r.stage)), None
    state.update((prog, cur, tot, started, secs, last))
    yield pd.DataFrame({"job_id": [key[0]], "progress": [prog], "current": [cur], "total": [tot], "eta_seconds": [eta], "lines": [n]})


def progress_stream(log: DataFrame, stages: Stages = ()) -> DataFrame:
    """STR-01: the state of each job after each micro-batch, from a stream of ``job_id``, ``seq``, ``ts``, ``line``.

    State is a handful of values per job: the five last page times, not the log.
    """
    e = events(log, stages=stages).select("job_id", "seq", "ts", "event", "current", "total", "stage").where("job_id is not null and seq is not null")
    return e.groupBy("job_id").applyInPandasWithState(_advance, OUTPUT, STATE, "update", "NoTimeout")


def snapshot(states: DataFrame, keys: Sequence[str] = ("job_id",), version: str = "batch") -> DataFrame:
    """STR-06: the state of every job as of the last micro-batch that touched it, as one consistent table."""
    rest = [c for c in states.columns if c not in (*keys, version)]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__s")).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in rest])


def log_since(log: DataFrame, cursor: int, keys: Sequence[str] = ("job_id",), order: str = "seq") -> DataFrame:
    """STR-04: the lines behind a reader's cursor, and the cursor to ask with next time."""
    new = log.where(F.col(order) > cursor)
    return new.withColumn("next_cursor", F.max(order).over(Window.partitionBy(*keys)))


def merged_log(out: DataFrame, err: DataFrame) -> DataFrame:
    """STR-03: both outputs of a job as one log, errors marked."""
    return out.unionByName(err.withColumn("line", F.concat(F.lit("[err] "), "line")))


def last_lines(log: DataFrame, keys: Sequence[str] = ("job_id",), order: str = "seq", n: int = 200) -> DataFrame:
    """SRT-07: the last ``n`` lines of each job."""
    return log.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("__r") <= n).drop("__r")


def page_batches(reader, path: str, schema: str, pages: int = 10):  # noqa: ANN001, ANN201
    """STR-05: pages as a stream, a bounded number of files a batch."""
    return reader.schema(schema).option("maxFilesPerTrigger", pages).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding windows with a watermark (beyond what the jobs need)."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
