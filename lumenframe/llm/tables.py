"""Sessions, tables, shared folders and bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs on this machine alone, as in tests, a temporary folder is set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        known = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        shared_dir.own = known
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


_written: set[str] = set()


def _delete(context: SparkContext, path: str) -> None:
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _written.discard(path)


@atexit.register
def _delete_all() -> None:
    """Tables that results still read can only go when the program ends."""
    with contextlib.suppress(Py4JError, OSError):  # Spark may have ended first
        if (context := SparkContext._active_spark_context) is not None and context._jsc is not None:
            for path in list(_written):
                _delete(context, path)
    if own := getattr(shared_dir, "own", None):
        shutil.rmtree(own.removeprefix("file://"), ignore_errors=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lumenframe/{uuid.uuid4().hex}"
    _written.add(path)
    return path


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there: later jobs neither repeat its
    work nor depend on the executor that did it.

    Frames in `done` came from earlier cuts that nothing but this one reads any more; they are deleted.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*done: DataFrame) -> None:
    """Deletes what earlier cuts wrote for these frames."""
    for frame in done:
        if (path := frame.__dict__.pop("_cut_path", None)) is not None:
            _delete(frame.sparkSession.sparkContext, path)


def workers(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_sample(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """At most most_rows rows (k, t, ...) with at most most_bytes of text, written to the shared folder.

    Rows are taken in hash order of the key k; one whose text doesn't fit in what is left is passed over.
    Rows with equal key and text count once.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_t", F.xxhash64("t"))
    first = marked.select("k", "_t", F.coalesce(F.octet_length("t"), F.lit(0)).alias("_n")).orderBy(F.xxhash64("k"), "k", "_t").limit(most_rows).collect()  # most_rows numbers
    kept, total = set(), 0
    for r in first:
        if (r["k"], r["_t"]) not in kept and total + r["_n"] <= most_bytes:
            total += r["_n"]
            kept.add((r["k"], r["_t"]))
    kind = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("_t", T.LongType())])
    keys = spark.createDataFrame(sorted(kept, key=str), kind)
    mine = marked["k"].eqNullSafe(keys["k"]) & (marked["_t"] == keys["_t"])
    return cut(marked.join(F.broadcast(keys), mine, "left_semi").dropDuplicates(["k", "_t"]).drop("_t"))
