"""Smaller rules over the driver's tables: maps, boxes, free spans, joined records, base64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions import geometry, text
from mosaiq.operators.sheet import round6
from mosaiq.plans.registry import query
from mosaiq.session import table


@query(
    "matrix_compose",
    """
WITH RECURSIVE l AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 1 + o_orderkey % 3 * 0.0625::DOUBLE AS a, (o_orderkey % 5 - 2) * 0.03125::DOUBLE AS b, (o_orderkey % 7 - 3)::DOUBLE AS e, (o_orderkey % 11 - 5)::DOUBLE AS f FROM orders),
m AS (SELECT DISTINCT id, 0::BIGINT AS k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f FROM l
  UNION ALL SELECT m.id, l.k, m.a * l.a + m.b * -l.b, m.a * l.b + m.b * l.a, m.c * l.a + m.d * -l.b, m.c * l.b + m.d * l.a, m.e * l.a + m.f * -l.b + l.e, m.e * l.b + m.f * l.a + l.f FROM m JOIN l ON l.id = m.id AND l.k = m.k + 1),
z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)
SELECT id, floor(least(e, e + a * 10, e + c * 5, e + a * 10 + c * 5) * 1e6 + 0.5) / 1e6 AS x0, floor(least(f, f + b * 10, f + d * 5, f + b * 10 + d * 5) * 1e6 + 0.5) / 1e6 AS y0,
  floor(greatest(e, e + a * 10, e + c * 5, e + a * 10 + c * 5) * 1e6 + 0.5) / 1e6 AS x1, floor(greatest(f, f + b * 10, f + d * 5, f + b * 10 + d * 5) * 1e6 + 0.5) / 1e6 AS y1 FROM z
""",
)
def matrix_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    a, b = 1 + k % 3 * 0.0625, (k % 5 - 2) * 0.03125
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), nth.alias("n"), F.array(a, b, -b, a, (k % 7 - 3).cast("double"), (k % 11 - 5).cast("double")).alias("m"))
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("ms"))
    box = geometry.bounds(geometry.composed(F.transform("ms", lambda x: x["m"])), F.lit(10), F.lit(5))
    return per.select("id", box.alias("b")).select("id", *(round6(F.col("b." + c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(
    "free_spans",
    """
WITH p AS (SELECT p_partkey, 0.0::DOUBLE AS l, 100.0::DOUBLE AS r, (p_partkey % 140 - 20)::DOUBLE AS x, p_size::DOUBLE AS w FROM part),
s AS (SELECT p_partkey, CASE WHEN x + w <= l OR x >= r THEN [{'a': l, 'b': r}] ELSE list_filter([{'a': l, 'b': x}, {'a': x + w, 'b': r}], lambda s: s.b - s.a > 1) END AS f FROM p)
SELECT p_partkey, len(f)::INT AS n, f[1].a AS "from", f[1].b AS "to" FROM s
""",
)
def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = geometry.free_spans(F.lit(0), F.lit(100), F.col("p_partkey") % 140 - 20, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", spans.alias("f"))
    return rows.select("p_partkey", F.size("f").alias("n"), F.get("f", 0)["from"].alias("from"), F.get("f", 0)["to"].alias("to"))


@query(
    "joined_records",
    """
WITH r AS (SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_quantity::INT % 3 = 0 THEN 60 ELSE 252 END AS kind, l_quantity::INT AS size FROM lineitem),
g AS (SELECT *, sum((kind <> 60)::INT) OVER (PARTITION BY stream ORDER BY seq) AS record FROM r)
SELECT stream, record::BIGINT AS record, sum(size)::BIGINT AS size, count(*) - 1 AS continuations FROM g WHERE record > 0 GROUP BY ALL
""",
)
def joined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuation records joined to the record before them."""
    w = Window.partitionBy("stream").orderBy("seq")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    size = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream"), nth.alias("seq"), F.when(size % 3 == 0, 60).otherwise(252).alias("kind"), size.alias("size"))
    rows = rows.withColumn("record", F.sum((F.col("kind") != 60).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("record > 0").groupBy("stream", "record").agg(F.sum("size").alias("size"), (F.count(F.lit(1)) - 1).alias("continuations"))


@query("base64_payload", "SELECT page_id, to_base64(encode(html)) AS payload FROM pages")
def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.base64_line(F.encode("html", "UTF-8")).alias("payload"))


@query("page_rows", "SELECT o_custkey, count(*) AS rows, least(count(*) - 1, floor((555 - 20.6) / 20.6))::BIGINT AS shown FROM orders GROUP BY o_custkey")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many data rows of a delimited table its page shows."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("shown", F.least(F.col("rows") - 1, F.lit(int((595 - 40 - 20.6) // 20.6)).cast("long")))
