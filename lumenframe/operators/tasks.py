"""Work on single rows that may fail or hang, and the rollup of such attempts."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.loops import Follower


class OutOfTime(Exception):
    """Raised in a row's work when its seconds are over."""


def guarded(df: DataFrame, key: str, work: Callable[[dict], float | None], seconds: float) -> DataFrame:
    """key, value, error: a row for each row of df; an error or `timeout` takes the place of an exception.

    The work is Python by nature, one call a row; the alarm interrupts it after the given seconds.  A row gets all of
    them, unless it is in a loop that provably never ends, which is a timeout as soon as that is known.
    Rows are dealt by key to several tasks for each core, as a small table that is read by one task may hold hours of work.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ring(*_: object) -> None:
            raise OutOfTime

        before = signal.signal(signal.SIGALRM, ring)
        follower = Follower(OutOfTime)
        try:
            for batch in batches:
                values, errors = [], []
                with follower:
                    for row in batch.to_pylist():
                        value, error = None, None
                        try:
                            signal.setitimer(signal.ITIMER_REAL, seconds)
                            try:
                                follower.arm()
                                value = work(row)
                            finally:
                                signal.setitimer(signal.ITIMER_REAL, 0)
                                follower.disarm()
                        except OutOfTime:
                            error = "timeout"
                        except Exception as e:  # an attempt's failure is its result
                            error = type(e).__name__
                        values.append(value)
                        errors.append(error)
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(values, pa.float64()), pa.array(errors, pa.string())], names=[key, "value", "error"])
        finally:
            signal.signal(signal.SIGALRM, before)

    return df.repartition(tasks, F.xxhash64(key)).mapInArrow(run, f"{key} long, value double, error string")


def source_guard(sources: DataFrame, limit: int, reprocess: Column | None = None) -> DataFrame:
    """image_id, n, aborted: images with more than `limit` sources are aborted, but for those that are reprocessed."""
    again = F.lit(False) if reprocess is None else reprocess
    return sources.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("aborted", (F.col("n") > limit) & ~again)


def run_timing(attempts: DataFrame, by: str, every: int) -> DataFrame:
    """by, step, and over the first `every`, 2 `every`, ... attempts: their number, successes, mean seconds of each phase, and peak memory.

    attempts: by, rank (from 0), ok, compute_s, stage_s, write_s, rss_mb.  Means of staging and writing are over successes.
    Sums of a step are added up over steps, of which there are few.
    """
    from pyspark.sql import Window

    ok = F.col("ok")
    one = attempts.groupBy(by, F.floor(F.col("rank") / every).alias("step")).agg(F.count("*").alias("n"), F.count_if(ok).alias("good"), F.sum("compute_s").alias("c"), F.sum(F.when(ok, F.col("stage_s"))).alias("s"), F.sum(F.when(ok, F.col("write_s"))).alias("w"), F.max("rss_mb").alias("rss"))
    upto = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(upto)
    return one.select(by, "step", total("n").alias("attempts"), total("good").alias("successes"), (total("c") / total("n")).alias("compute_s"), F.try_divide(total("s"), total("good")).alias("stage_s"), F.try_divide(total("w"), total("good")).alias("write_s"), F.max("rss").over(upto).alias("rss_mb"))
