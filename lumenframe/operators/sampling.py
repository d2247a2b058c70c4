"""Deterministic shuffles, samples, splits, mixtures and slot filling.

An order column (a hash or an arithmetic key) takes the place of a random generator, so
results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, order: Column, key: str, k: int) -> DataFrame:
    """The first k rows of the shuffle."""
    return df.withColumn("_o", order).orderBy("_o", key).limit(k).drop("_o")


def numbered(df: DataFrame, order: Column, key: str, name: str, by: str | None = None) -> DataFrame:
    """Adds 0, 1, ... in order, within each value of `by` if there is one; no task sorts everything.

    The key space of order is cut into ranges; rows are numbered in their range and moved by the
    rows of all lower ranges.
    """
    width, group = 1 << 21, [by] if by else []
    rows = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / width))
    sizes = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_o", key)) - 1
    return rows.withColumn("_p", place).join(base, [*group, "_b"]).withColumn(name, F.col("_p") + F.col("_base")).drop("_o", "_b", "_p", "_base")


def filter_until(df: DataFrame, order: Column, key: str, valid: Column, k: int, max_checks: int | None = None) -> DataFrame:
    """The first k valid rows among the first max_checks of the shuffle."""
    rows = df.withColumn("_o", order)
    if max_checks is not None:
        rows = rows.orderBy("_o", key).limit(max_checks)
    return rows.filter(valid).orderBy("_o", key).limit(k).drop("_o")


def split(df: DataFrame, order: Column, key: str, train: float, rounding: str = "int") -> DataFrame:
    """Adds split: the first int((share) * n) rows of the shuffle are train (rint: half to even)."""
    n = df.count()
    cut = int(train * n) if rounding == "int" else round(train * n)
    return numbered(df, order, key, "_k").withColumn("split", F.when(F.col("_k") < cut, "train").otherwise("test")).drop("_k")


def fill_slots(df: DataFrame, order: Column, key: str, valid: Column, slots: int) -> DataFrame:
    """slot and the first valid candidate among those of rank slot, slot + slots, ..."""
    ranked = numbered(df, order, key, "_k").withColumn("slot", F.pmod("_k", F.lit(slots)).cast("int"))
    return ranked.filter(valid).groupBy("slot").agg(F.min_by(key, "_k").alias(key), F.min("_k").cast("long").alias("rank"))


def mixture_counts(sizes: dict[str, int], fractions: dict[str, float], total: int, rest: str) -> dict[str, int]:
    """Draws from each bucket: shares are normalised, and empty buckets' shares go to `rest`."""
    whole = sum(fractions.values())
    share = {k: f / whole for k, f in fractions.items()}
    for k in list(share):
        if k != rest and not sizes.get(k):
            share[rest] += share[k]
            share[k] = 0.0
    out = {k: round(total * f) for k, f in share.items()}
    out[rest] = total - sum(v for k, v in out.items() if k != rest)
    return out


def mixture(df: DataFrame, key: str, bucket: str, counts: dict[str, int], seed: int, epoch: int) -> DataFrame:
    """draw, bucket, key: draws with replacement; draw i of a bucket takes row hash(i) mod its size."""
    spark = df.sparkSession
    rows = numbered(df.select(key, F.col(bucket).alias("bucket")), F.col(key), key, "_k", "bucket")
    rows = rows.filter(F.col("bucket").cast("string").isin(list(counts)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n"))  # as many rows as counts
    draws = None
    for name, n in sorted(counts.items()):
        d = spark.range(n).select(F.col("id").alias("draw"), F.lit(name).alias("bucket"))
        draws = d if draws is None else draws.unionByName(d)
    at = ((F.col("draw") * 7919 + seed * 104729 + epoch * 1299709) * 2654435761) % 4294967296 % F.col("_n")
    return draws.join(F.broadcast(sizes), "bucket").withColumn("_k", at).join(rows, ["bucket", "_k"]).select("bucket", "draw", key)


def cycle(df: DataFrame, key: str, n: int) -> DataFrame:
    """i, key: n items in order of key, again from the first after the last."""
    rows = numbered(df.select(key), F.col(key), key, "_k")
    size = df.count()
    return df.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % max(1, size)).alias("_k")).join(rows, "_k").select("i", key)


def modal(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent combination; ties go to the smallest."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), *columns).limit(1)


def modal_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the most frequent value of each column on its own; ties go to the smallest."""
    n = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), F.col(c).cast("double").alias("number")) for c in columns])).alias("v")).select("v.*")
    best = n.groupBy("column", "text", "number").agg(F.count("*").alias("n")).groupBy("column").agg(F.max_by("number", F.struct("n", -F.col("number"))).alias("mode"))
    return best.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in columns])


def throughput(batches: DataFrame, worker: str, at: str, key: str, tiles: str, warm_up: int, most: int) -> DataFrame:
    """worker, batches, batches_per_s, tiles_per_s over at most `most` batches that follow `warm_up` others."""
    ranked = batches.withColumn("_n", F.row_number().over(Window.partitionBy(worker).orderBy(at, key))).filter(F.col("_n") <= warm_up + most)
    timed = F.col("_n") > warm_up
    sums = ranked.groupBy(worker).agg(F.min(F.when(F.col("_n") == warm_up, F.col(at))).alias("t0"), F.max(at).alias("t1"), F.count_if(timed).alias("batches"), F.sum(F.when(timed, F.col(tiles))).alias("tiles"))
    seconds = F.col("t1") - F.col("t0")
    return sums.select(worker, "batches", F.try_divide(F.col("batches"), seconds).alias("batches_per_s"), F.try_divide(F.col("tiles"), seconds).alias("tiles_per_s"))
