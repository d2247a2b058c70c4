"""Image relations derived from the driver's tables, in Spark and as DuckDB common table expressions.

The tables hold no images, so each scene states one: dense 8x8 images from embeddings, sparse
128x128 images from line items, an object catalog from parts, sky sources from customers and
suppliers, rates from events, and exposures from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edge of the dense and the sparse images.
DENSE, SPARSE = 8, 128


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c, flux, p, gt, real: every pixel of 8x8 images."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("pos", "flux"))
    r, c = F.floor(F.col("pos") / DENSE).cast("int"), (F.col("pos") % DENSE).cast("int")
    e = e.select("image_id", "label", r.alias("r"), c.alias("c"), F.col("flux").cast("double").alias("flux"))
    return e.select("image_id", "r", "c", "flux", (1 / (1 + F.exp(-8 * F.col("flux")))).alias("p"), ((F.col("label") + F.col("r") + F.col("c")) % 5 < 2).alias("gt"), F.when((F.col("image_id") + F.col("r") * 3 + F.col("c")) % 7 == 0, 1).otherwise(0).alias("real"))


DENSE_SQL = """px8 AS (
  SELECT image_id, r, c, flux, 1/(1+exp(-8*flux)) AS p, (label + r + c) % 5 < 2 AS gt,
         CASE WHEN (image_id + r*3 + c) % 7 = 0 THEN 1 ELSE 0 END AS real
  FROM (SELECT vec_id AS image_id, label, CAST(pos // 8 AS INT) AS r, CAST(pos % 8 AS INT) AS c, CAST(v AS DOUBLE) AS flux
        FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings)))"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c, p: the pixels with a probability in sparse 128x128 images."""
    li = table(spark, sf_dir, "lineitem")
    r, c = (F.col("l_orderkey") % SPARSE).cast("int"), (F.col("l_partkey") % SPARSE).cast("int")
    p = F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 6)
    return li.groupBy(F.col("l_suppkey").alias("image_id"), r.alias("r"), c.alias("c")).agg(F.max(p).alias("p"))


SPARSE_SQL = """pxs AS (
  SELECT l_suppkey AS image_id, CAST(l_orderkey % 128 AS INT) AS r, CAST(l_partkey % 128 AS INT) AS c,
         max(round(l_discount*5 + l_quantity/100, 6)) AS p
  FROM lineitem GROUP BY ALL)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object catalog: one row for each part, in the order of row_pos."""
    k, size = F.col("p_partkey"), F.col("p_size")
    found = k % 3 == 0
    return table(spark, sf_dir, "part").select(
        (k % 100 + 1).alias("image_id"), k.alias("row_pos"), ((k * 37) % SPARSE).alias("x"), ((k * 91) % SPARSE).alias("y"),
        ((k * 7) % 180).cast("double").alias("beta"), (6 + size).cast("double").alias("trail_length"),
        (2 + (F.col("p_retailprice") % 600) / 100).alias("SNR"), found.alias("stack_detection"),
        F.when(found, 20 + size / 10).alias("stack_mag"), ((k % 5) < 2).alias("nn_detected"),
    )


CATALOG_SQL = """cat AS (
  SELECT p_partkey % 100 + 1 AS image_id, p_partkey AS row_pos, (p_partkey*37) % 128 AS x, (p_partkey*91) % 128 AS y,
         CAST((p_partkey*7) % 180 AS DOUBLE) AS beta, CAST(6 + p_size AS DOUBLE) AS trail_length,
         2 + (p_retailprice % 600)/100 AS SNR, p_partkey % 3 = 0 AS stack_detection,
         CASE WHEN p_partkey % 3 = 0 THEN 20 + p_size/10.0 END AS stack_mag, (p_partkey % 5) < 2 AS nn_detected
  FROM part)"""


def stack_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c: pixels of the baseline detector's mask in the sparse images."""
    return sparse(spark, sf_dir).filter((F.col("r") + F.col("c")) % 11 == 0).select("image_id", "r", "c")


STACK_SQL = "stk AS (SELECT image_id, r, c FROM pxs WHERE (r + c) % 11 = 0)"


def sky(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources before (customers) and after (suppliers): src_id, ra, dec in degrees."""
    def place(name: str, key: str, step: int, up: int) -> DataFrame:
        k = F.col(key)
        return table(spark, sf_dir, name).select(k.alias("src_id"), (150 + ((k * step) % 61) * 0.0002).alias("ra"), (2 + ((k * up) % 53) * 0.0002).alias("dec"))

    return place("customer", "c_custkey", 17, 31), place("supplier", "s_suppkey", 23, 37)


SKY_SQL = """pre AS (SELECT c_custkey AS src_id, 150 + ((c_custkey*17) % 61)*0.0002::DOUBLE AS ra, 2 + ((c_custkey*31) % 53)*0.0002::DOUBLE AS dec FROM customer),
post AS (SELECT s_suppkey AS src_id, 150 + ((s_suppkey*23) % 61)*0.0002::DOUBLE AS ra, 2 + ((s_suppkey*37) % 53)*0.0002::DOUBLE AS dec FROM supplier)"""


def ephemerides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky positions and rates of moving objects."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("FieldID"), F.concat(F.lit("obj"), k.cast("string")).alias("ObjID"), k.alias("event_id"),
        ((k * 7) % 360).cast("double").alias("RA_deg"), ((k * 13) % 180 - 90).cast("double").alias("Dec_deg"),
        (F.col("value") / 100 - 0.4).alias("RARateCosDec_deg_day"), ((F.col("user_id") % 21 - 10) / 15).alias("DecRate_deg_day"),
    )


EPH_SQL = """eph AS (
  SELECT user_id % 50 AS FieldID, 'obj' || CAST(event_id AS VARCHAR) AS ObjID, event_id,
         CAST((event_id*7) % 360 AS DOUBLE) AS RA_deg, CAST((event_id*13) % 180 - 90 AS DOUBLE) AS Dec_deg,
         value/100 - 0.4 AS RARateCosDec_deg_day, (user_id % 21 - 10)/15.0 AS DecRate_deg_day FROM events)"""


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visit, detector, collection_rank, day_obs, band, valid: candidates for a dataset."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("visit"), (o % 189).alias("detector"), o.alias("ref_id"), (o % 3).alias("collection_rank"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("day_obs"), F.substring("o_orderpriority", 1, 1).alias("band"),
        (F.col("o_orderstatus") != "P").alias("valid"),
    )


EXP_SQL = """expo AS (
  SELECT o_custkey AS visit, o_orderkey % 189 AS detector, o_orderkey AS ref_id, o_orderkey % 3 AS collection_rank,
         CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day_obs, substr(o_orderpriority, 1, 1) AS band,
         o_orderstatus <> 'P' AS valid FROM orders)"""


def order_key(key: str = "ref_id", seed: int = 0):
    """An arithmetic shuffle order that any SQL engine can repeat."""
    return (((F.col(key) % 1048576) + seed) * 1103515245 + 12345) % 2147483648


def order_sql(key: str = "ref_id", seed: int = 0) -> str:
    return f"((({key} % 1048576) + {seed}) * 1103515245 + 12345) % 2147483648"
