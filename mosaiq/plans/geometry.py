"""Thumbnail geometry over rows: which source rectangle goes to which target rectangle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.resize import scaled_rect
from mosaiq.plans.registry import query
from mosaiq.session import table

# Image sizes are derived from part and order keys: width 1..997, height 1..641.
_SQL = """
WITH sizes AS (
  SELECT p_partkey AS id, CAST(p_partkey * 37 % 997 + 1 AS INT) AS w, CAST(p_size * 13 % 641 + 1 AS INT) AS h FROM part
), fits AS (SELECT * FROM sizes CROSS JOIN (VALUES ('cover'), ('contain'), ('fill')) t(fit)
), scaled AS (
  SELECT *, CASE fit WHEN 'cover' THEN greatest(256.0::DOUBLE / w, 192.0::DOUBLE / h) ELSE least(256.0::DOUBLE / w, 192.0::DOUBLE / h) END AS s FROM fits
), cut AS (
  SELECT *, CASE WHEN fit = 'cover' THEN floor(256 / s + 0.5) ELSE w END AS sw, CASE WHEN fit = 'cover' THEN floor(192 / s + 0.5) ELSE h END AS sh,
    CASE WHEN fit = 'contain' THEN floor(w * s + 0.5) ELSE 256 END AS dw, CASE WHEN fit = 'contain' THEN floor(h * s + 0.5) ELSE 192 END AS dh FROM scaled
)
SELECT id, fit, CAST(floor((w - sw) / 2 + 0.5) AS INT) AS src_x, CAST(floor((h - sh) / 2 + 0.5) AS INT) AS src_y, CAST(sw AS INT) AS src_w, CAST(sh AS INT) AS src_h,
  CAST(floor((256 - dw) / 2 + 0.5) AS INT) AS dst_x, CAST(floor((192 - dh) / 2 + 0.5) AS INT) AS dst_y, CAST(dw AS INT) AS dst_w, CAST(dh AS INT) AS dst_h
FROM cut
"""


@query("thumbnail_geometry", _SQL)
def thumbnail_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") * 37 % 997 + 1).cast("int").alias("w"),
        (F.col("p_size") * 13 % 641 + 1).cast("int").alias("h"),
    )
    fits = sizes.withColumn("fit", F.explode(F.array(*map(F.lit, ("cover", "contain", "fill")))))
    rect = scaled_rect(F.col("w"), F.col("h"), F.lit(256), F.lit(192), F.col("fit"))
    return fits.select("id", "fit", rect.alias("r")).select("id", "fit", "r.*")
