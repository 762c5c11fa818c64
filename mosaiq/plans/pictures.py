"""Synthetic picture files from the driver's tables, through the whole way to thumbnails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import thumbnails
from mosaiq.plans.registry import query
from mosaiq.session import table


def _ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary PPM for each supplier, 4 to 10 pixels wide: pixel (x, y) is (31 id + 17 y + 5 x, 40 y, 60 x) modulo 256."""
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(i.alias("id"), (i % 7 + 4).cast("int").alias("w"), (i % 5 + 3).cast("int").alias("h"))
    n = F.col("w") * F.col("h")
    two = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")

    def pixel(k):
        y, x = F.floor(k / F.col("w")), k % F.col("w")
        return F.concat(two(F.col("id") * 31 + y * 17 + x * 5), two(y * 40), two(x * 60))

    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), pixel), ""))
    head = F.encode(F.concat(F.lit("P6\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n")), "UTF-8")
    return rows.select("id", F.concat(head, body).alias("content"))


@query(
    "ppm_decode",
    """
WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 7 + 4)::INT AS w, (s_suppkey % 5 + 3)::INT AS h FROM supplier)
SELECT id, y.range::INT AS y, x.range::INT AS x, ((id * 31 + y.range * 17 + x.range * 5) % 256)::INT AS r, (y.range * 40 % 256)::INT AS g, (x.range * 60 % 256)::INT AS b, 255 AS a
FROM s, range(7) y, range(10) x WHERE y.range < h AND x.range < w
""",
)
def ppm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thumbnails.pixels(thumbnails.decoded(_ppm(spark, sf_dir), "id"), "id")


@query(
    "thumbnail_files",
    "SELECT s_suppkey AS id, 'ppm' AS type, (s_suppkey % 7 + 4)::INT AS source_width, (s_suppkey % 5 + 3)::INT AS source_height, NULL::VARCHAR AS error, '89504E470D0A1A0A' AS magic FROM supplier",
)
def thumbnail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = thumbnails.thumbnails(_ppm(spark, sf_dir).withColumn("width", F.lit(32)).withColumn("height", F.lit(24)), "id")
    return done.select("id", "type", "source_width", "source_height", "error", F.hex(F.substring("png", 1, 8)).alias("magic"))


@query(
    "png_roundtrip",
    """
WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 7 + 4)::INT AS w, (s_suppkey % 5 + 3)::INT AS h FROM supplier)
SELECT id, y.range::INT AS y, x.range::INT AS x, ((id * 31 + y.range * 17 + x.range * 5) % 256)::INT AS r, (y.range * 40 % 256)::INT AS g, (x.range * 60 % 256)::INT AS b, 255 AS a
FROM s, range(7) y, range(10) x WHERE y.range < h AND x.range < w
""",
)
def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    # thumbnails of the pictures' own size are the pictures
    rows = _ppm(spark, sf_dir).withColumn("width", (i % 7 + 4).cast("int")).withColumn("height", (i % 5 + 3).cast("int"))
    done = thumbnails.thumbnails(rows, "id").select("id", F.col("png").alias("content"))
    return thumbnails.pixels(thumbnails.decoded(done, "id"), "id")


@query("detect_payloads", "SELECT 'ppm' AS type, count(*) AS n FROM supplier")
def detect_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.sources.files import with_type

    return with_type(_ppm(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("csv_thumbnails")
def csv_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each nation's customers, drawn."""
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("string"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    files = rows.select(F.col("c_nationkey").alias("id"), F.encode(F.concat(F.lit("key,name,segment,balance\n"), "t"), "UTF-8").alias("content"))
    return thumbnails.thumbnails(files, "id").select("id", "type", "source_width", "source_height", F.length("png").alias("bytes"), "error")
