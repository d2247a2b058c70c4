"""Mergeable pixel histograms over streams, and a reservoir in hash order.

Counts of bins add up, so a stream of pixels needs no state but the histogram itself; the same
windowed curve operators then read the sink's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators.pixels import count_if, sweep_bin


def pixel_histogram(stream: DataFrame, nbins: int = 4096) -> DataFrame:
    """bin, pos, neg so far (complete or update mode)."""
    return stream.groupBy(sweep_bin(nbins).alias("bin")).agg(count_if(F.col("gt")).alias("pos"), count_if(~F.col("gt")).alias("neg"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, key: str) -> DataFrame:
    """start, key, n for tumbling windows; rows later than the watermark are left out."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")


def write_histogram(hist: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rewrites the histogram's table after each batch; a repeated batch gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return hist.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()
