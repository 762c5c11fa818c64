"""Type detection, limits and options over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import detect, limits
from mosaiq.plans.registry import query
from mosaiq.session import table

_PREFIXES = ("", "BM", "GIF89a", "P6 ", "P2 ", "%PDF-", "qoif", "DDS ", "8BPS", "xxxxftypisom")
_SQL = """
WITH p AS (
  SELECT 'page' AS kind, page_id AS id, regexp_replace(regexp_replace(html, '[\\x{0080}-\\x{07FF}]', '~~', 'g'), '[\\x{0800}-\\x{FFFF}]', '~~~', 'g') AS body FROM pages
  UNION ALL SELECT 'csv', c_custkey, concat('id,name', chr(10), c_custkey, ',', c_name, chr(10)) FROM customer
  UNION ALL SELECT 'semi', s_suppkey, concat('id;', s_name, chr(10), s_suppkey, chr(10)) FROM supplier
  UNION ALL SELECT 'head', p_partkey, concat(list_extract(['', 'BM', 'GIF89a', 'P6 ', 'P2 ', '%PDF-', 'qoif', 'DDS ', '8BPS', 'xxxxftypisom'], (p_partkey % 10 + 1)::INT), p_name) FROM part
), t AS (
  SELECT *, list_filter(string_split_regex(left(body, 512), '\\r?\\n'), lambda x: x <> '') AS lines,
    NOT regexp_matches(left(body, 512), '[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]') AS plain, NOT regexp_matches(left(body, 1024), '[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]') AS plain2 FROM p
), c AS (
  SELECT *, list_transform([',', chr(9), ';', '|'], lambda d: [length(lines[1]) - length(replace(lines[1], d, '')), length(lines[2]) - length(replace(lines[2], d, ''))]) AS counts FROM t
)
SELECT kind, coalesce(CASE
    WHEN starts_with(body, 'BM') THEN 'bmp' WHEN starts_with(body, 'GIF89') OR starts_with(body, 'GIF87') THEN 'gif'
    WHEN substr(body, 9, 4) = 'WEBP' THEN 'webp' WHEN substr(body, 9, 4) = 'ACON' THEN 'ani'
    WHEN left(body, 2) IN ('P1', 'P4') THEN 'pbm' WHEN left(body, 2) IN ('P2', 'P5') THEN 'pgm' WHEN left(body, 2) IN ('P3', 'P6') THEN 'ppm'
    WHEN starts_with(body, 'qoif') THEN 'qoi' WHEN starts_with(body, 'DDS ') THEN 'dds' WHEN starts_with(body, '8BPS') THEN 'psd' WHEN starts_with(body, '%PDF') THEN 'pdf'
    WHEN plain2 AND regexp_matches(left(body, 1024), '(?i)<svg[ \\t-\\r>]') THEN 'svg'
    WHEN length(body) >= 4 AND plain AND regexp_matches(left(body, 512), '[,;|\\t]') AND contains(left(body, 512), chr(10)) AND len(lines) >= 2 AND len(list_filter(counts, lambda x: x[1] > 0 AND x[1] = x[2])) > 0 THEN 'csv'
    WHEN substr(body, 5, 4) = 'ftyp' THEN 'mp4' END, 'unknown') AS type, count(*) AS n
FROM c GROUP BY ALL
"""


@query("sniff_type", _SQL)
def sniff_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    prefix = F.element_at(F.array(*map(F.lit, _PREFIXES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    bodies = (
        table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("body"))
        .unionByName(table(spark, sf_dir, "customer").select(F.lit("csv").alias("kind"), F.concat(F.lit("id,name\n"), F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit("\n")).alias("body")))
        .unionByName(table(spark, sf_dir, "supplier").select(F.lit("semi").alias("kind"), F.concat(F.lit("id;"), "s_name", F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit("\n")).alias("body")))
        .unionByName(part.select(F.lit("head").alias("kind"), F.concat(prefix, "p_name").alias("body")))
    )
    found = bodies.select("kind", F.coalesce(detect.detect_type(F.encode("body", "UTF-8")), F.lit("unknown")).alias("type"))
    return found.groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "limits_filter",
    """
WITH d AS (SELECT p_partkey AS id, (p_size - 1) * 977 AS w, CAST(p_partkey * 131 % 4001 AS INT) AS h FROM part)
SELECT id, w, h, CASE WHEN w < 1 OR h < 1 THEN 'Invalid image dimensions' WHEN w::BIGINT * h > 100000000 THEN 'Image too large' END AS error FROM d
""",
)
def limits_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 1) * 977).alias("w"), (F.col("p_partkey") * 131 % 4001).cast("int").alias("h"))
    return sizes.withColumn("error", limits.dimension_error(F.col("w"), F.col("h")))


@query(
    "resolve_options",
    """
WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS w, CASE WHEN p_partkey % 5 > 0 THEN p_size * 2 END AS h, CASE WHEN p_partkey % 7 > 3 THEN 'contain' END AS f FROM part)
SELECT id, coalesce(w, 256) AS width, coalesce(h, 256) AS height, coalesce(f, 'cover') AS fit FROM o
""",
)
def resolve_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    given = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 3 > 0, F.col("p_size")).alias("width"), F.when(key % 5 > 0, F.col("p_size") * 2).alias("height"), F.when(key % 7 > 3, "contain").alias("fit"))
    return limits.with_defaults(given).drop("type")
