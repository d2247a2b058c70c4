"""Schemas, readers and sinks, and the checks that come before a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = (
    "injection_id BIGINT, ra DOUBLE, dec DOUBLE, source_type STRING, trail_length DOUBLE, mag DOUBLE, beta DOUBLE, visit BIGINT, detector BIGINT, "
    "integrated_mag DOUBLE, PSF_mag DOUBLE, SNR DOUBLE, physical_filter STRING, x BIGINT, y BIGINT, SNR_estimation DOUBLE, m5_local DOUBLE, m5_detector DOUBLE, "
    "stack_detection BOOLEAN, stack_mag DOUBLE, stack_mag_err DOUBLE, stack_snr DOUBLE, image_id BIGINT"
)
EPHEMERIS = "FieldID BIGINT, ObjID STRING, RA_deg DOUBLE, Dec_deg DOUBLE, RARateCosDec_deg_day DOUBLE, DecRate_deg_day DOUBLE, vsky_deg_day DOUBLE"
BAD_VISITS = "visit BIGINT, detector INT, reason STRING"


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; on one machine a temporary one will do."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='lumenframe-')}")
        known = _own[0]
    return f"{known.rstrip('/')}/{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; NaN becomes null."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows; nothing is written for an empty frame."""
    if not df.isEmpty():
        df.write.mode("append").csv(path, header=True)


def write_csv(df: DataFrame, path: str, schema: str) -> None:
    """Writes a CSV with a header; columns of the schema that df lacks are null, others are left out."""
    have = {c.lower(): c for c in df.columns}
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.csv(path, header=True)


def read_images(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """What write_images() wrote, of all splits or of one."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_images(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """Pixels or tiles by split; row groups take the place of chunks, and image_id keeps them narrow."""
    df.sortWithinPartitions("image_id").write.mode(mode).partitionBy("split").option("compression", compression).parquet(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_exposure(df: DataFrame) -> DataFrame:
    """exposure, which falls back to visit where it is null and where there is no such column."""
    return df.withColumn("exposure", F.coalesce("exposure", "visit") if "exposure" in df.columns else F.col("visit"))


def registry(df: DataFrame, where: str) -> DataFrame:
    """Rows by a predicate, the first of each (visit, detector) in collection order."""
    first = Window.partitionBy("visit", "detector").orderBy("collection_rank", "ref_id")
    return df.filter(where).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def with_attributes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(" and ".join(f"`{c}` is not null" for c in columns)) if columns else df


def bad_reasons(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows that fail a check, with the code of the first one: code -> column that must not be null."""
    reason = F.lit(None).cast("string")
    for code, column in reversed(list(checks.items())):
        reason = F.when(F.col(column).isNull(), code).otherwise(reason)
    return df.withColumn("reason", reason).filter("reason is not null")


def columns_by_prefix(df: DataFrame, always: list[str], prefixes: list[str]) -> DataFrame:
    return df.select(*always, *[c for c in df.columns if c not in always and c.startswith(tuple(prefixes))])
