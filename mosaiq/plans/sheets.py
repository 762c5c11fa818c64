"""Delimited text and spreadsheets as relations, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import color, text
from mosaiq.operators import intervals, sheet
from mosaiq.plans.registry import query
from mosaiq.session import table

R6 = sheet.round6


@query(
    "csv_detect_delim",
    """
WITH l AS (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 1 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS line FROM documents),
c AS (SELECT doc_id, unnest([{'n': length(line) - length(replace(line, ',', '')), 'p': 4, 'd': ','}, {'n': length(line) - length(replace(line, chr(9), '')), 'p': 3, 'd': chr(9)},
  {'n': length(line) - length(replace(line, ';', '')), 'p': 2, 'd': ';'}, {'n': length(line) - length(replace(line, '|', '')), 'p': 1, 'd': '|'}]) AS x FROM l)
SELECT doc_id, CASE WHEN max(x.n) > 0 THEN arg_max(x.d, x.n * 10 + x.p) ELSE ',' END AS delimiter FROM c GROUP BY doc_id
""",
)
def csv_detect_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_delimiter(F.col("text")).alias("delimiter"))


def _customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("row"), line.alias("line"))
    return rows.select("file", "row", F.posexplode(F.split("line", ",", -1)).alias("col", "value"))


@query(
    "csv_cells",
    """
WITH r AS (SELECT c_nationkey AS file, c_custkey AS row, string_split(concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment), ',') AS f FROM customer)
SELECT file, row, (generate_subscripts(f, 1) - 1)::INT AS col, unnest(f) AS value FROM r
""",
)
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_cells(spark, sf_dir)


@query(
    "csv_col_widths",
    """
WITH r AS (SELECT c_nationkey AS file, string_split(concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment), ',') AS f FROM customer),
c AS (SELECT file, (generate_subscripts(f, 1) - 1)::INT AS col, unnest(f) AS value FROM r),
n AS (SELECT file, col, greatest(40.0::DOUBLE, max(length(value) * 9 * 0.5::DOUBLE + 12)) AS own FROM c GROUP BY ALL)
SELECT file, col, floor((CASE WHEN sum(own) OVER w <= 802 THEN own * (802 / sum(own) OVER w) ELSE greatest(40, own * (802 / sum(own) OVER w)) END) * 1000000 + 0.5) / 1000000 AS width
FROM n WINDOW w AS (PARTITION BY file)
""",
)
def csv_col_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = text.text_width(F.col("value"), F.lit(9)) + 12
    return sheet.column_widths(_customer_cells(spark, sf_dir), ["file"], width, 802.0).select("file", "col", R6(F.col("width")).alias("width"))


@query(
    "csv_truncate",
    """
SELECT p_partkey, CASE WHEN length(p_name) * 4.5 <= p_size + 20 THEN p_name ELSE substr(p_name, 1, greatest(floor((p_size + 20 - 4.5) / 4.5), 0)::INT) || '…' END AS shown FROM part
""",
)
def csv_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.truncate(F.col("p_name"), F.lit(9), F.col("p_size") + 20).alias("shown"))


@query(
    "row_banding",
    """
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT o_custkey, o_orderkey, n::INT AS n, (n % 2)::INT AS band FROM n WHERE n < 26
""",
)
def row_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 26 rows: the header and the 25 that a page holds
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return sheet.banded(rows, ["o_custkey"], "o_orderkey", 26).withColumn("band", F.col("band").cast("int"))


_CELLS = """
WITH c AS (SELECT l_orderkey, l_linenumber, ['s', 'b', 'n', 'str', '']::VARCHAR[] AS k, (l_partkey % 5 + 1)::INT AS t, l_quantity::BIGINT AS q FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, k[t] AS type, CASE k[t] WHEN 's' THEN (q % 9)::VARCHAR WHEN 'b' THEN (q % 2)::VARCHAR ELSE q::VARCHAR END AS value FROM c),
s AS (SELECT unnest(['alpha', 'beta', 'gamma', 'delta', 'epsilon']) AS text, generate_subscripts(['a', 'b', 'c', 'd', 'e'], 1) - 1 AS idx)
"""


@query(
    "cell_display",
    _CELLS + """
SELECT l_orderkey, l_linenumber, type, CASE type WHEN 's' THEN coalesce(text, '') WHEN 'b' THEN CASE WHEN value = '1' THEN 'TRUE' ELSE 'FALSE' END ELSE value END AS display
FROM v LEFT JOIN s ON type = 's' AND idx::VARCHAR = value
""",
)
def cell_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("s", "b", "n", "str", ""))), (F.col("l_partkey") % 5 + 1).cast("int"))
    q = F.col("l_quantity").cast("long")
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("type"), q.alias("q"))
    value = F.when(F.col("type") == "s", F.col("q") % 9).when(F.col("type") == "b", F.col("q") % 2).otherwise(F.col("q")).cast("string")
    # a range, as its size is known before the run: it is broadcast and no cell is shuffled
    names = F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta", "epsilon")))
    strings = spark.range(5).select(F.col("id").alias("idx"), F.get(names, F.col("id").cast("int")).alias("text"))
    return sheet.display_values(cells.select("l_orderkey", "l_linenumber", "type", value.alias("value")), strings).drop("value")


@query(
    "format_number",
    """
WITH v AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS cents, (l_partkey % 8)::INT AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k, CASE
  WHEN k = 0 THEN (cents // 100)::VARCHAR
  WHEN k IN (1, 6) THEN printf('%d.%02d', cents // 100, cents % 100)
  WHEN k = 2 THEN printf('%d.%02d0', cents // 100, cents % 100)
  WHEN k = 3 THEN printf('$%d.%02d', cents // 100, cents % 100)
  WHEN k = 4 THEN concat(cents, '%')
  WHEN k = 5 THEN concat(cents, '.00%')
  WHEN k = 7 THEN rtrim(rtrim(concat(format('{:,}', cents // 100), '.', printf('%02d', cents % 100)), '0'), '.') END AS shown FROM v
""",
)
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_partkey") % 8).cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    # exact decimals as text, as cells hold them
    value = F.when(k == 0, F.floor(cents / 100).cast("string")).otherwise((cents.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string"))
    number = F.element_at(F.array(*map(F.lit, (0, 2, 3, 5, 9, 10, 200, 37))), k + 1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), value.alias("value"), number.alias("id"), F.when(k == 6, "0.00").otherwise("").alias("code"))
    return rows.select("l_orderkey", "l_linenumber", "k", text.format_number(F.col("value"), F.col("id"), F.col("code")).alias("shown"))


@query(
    "a1_refs",
    """
WITH n AS (SELECT p_partkey AS id, (p_partkey * 7919 % 18278)::INT AS c, p_size AS r FROM part),
s AS (SELECT *, CASE WHEN c < 26 THEN chr(65 + c) WHEN c < 702 THEN chr(65 + (c - 26) // 26) || chr(65 + (c - 26) % 26) ELSE chr(65 + (c - 702) // 676) || chr(65 + (c - 702) // 26 % 26) || chr(65 + (c - 702) % 26) END AS l FROM n)
SELECT id, l || (r + 1)::VARCHAR AS ref, c AS col, r AS row FROM s
""",
)
def a1_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.cell_ref((F.col("p_partkey") * 7919 % 18278).cast("int"), F.col("p_size")).alias("ref"))
    return rows.select("id", "ref", text.column_of(F.col("ref")).alias("col"), text.row_of(F.col("ref")).alias("row"))


@query(
    "style_star_join",
    """
WITH x AS (SELECT range AS xf, range % 4 AS font, range % 3 AS fill, range % 5 AS num_fmt FROM range(6)), f AS (SELECT range AS font, 10 + range AS size, range = 1 AS bold FROM range(3)),
g AS (SELECT range AS fill, printf('%06x', range * 1118481) AS rgb FROM range(2))
SELECT l_orderkey, l_linenumber, coalesce(size, 11)::INT AS size, coalesce(bold, false) AS bold, coalesce(rgb, 'none') AS rgb, coalesce(num_fmt, 0)::INT AS num_fmt
FROM lineitem LEFT JOIN x ON l_partkey % 8 = xf LEFT JOIN f USING (font) LEFT JOIN g USING (fill)
""",
)
def style_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 8).alias("style"))
    n = F.col("id")
    xfs = spark.range(6).select(n.alias("xf"), (n % 4).alias("font"), (n % 3).alias("fill"), (n % 5).cast("int").alias("num_fmt"))
    fonts = spark.range(3).select(n.alias("font"), (n + 10).cast("int").alias("size"), (n == 1).alias("bold"))
    fills = spark.range(2).select(n.alias("fill"), F.lower(F.lpad(F.hex(n * 1118481), 6, "0")).alias("rgb"))
    return sheet.styled(cells, xfs, fonts, fills).drop("style")


@query(
    "merge_origin",
    """
WITH c AS (SELECT n_nationkey AS sheet, r.range AS row, k.range AS col FROM nation, range(12) r, range(8) k),
m AS (SELECT n_nationkey AS sheet, s.range AS seq, (n_nationkey + s.range * 3) % 10 AS r0, (n_nationkey + s.range * 3) % 10 + 1 AS r1, s.range % 5 AS c0, s.range % 5 + 2 AS c1 FROM nation, range(4) s),
j AS (SELECT c.sheet, c.row, c.col, max({'seq': seq, 'r0': r0, 'c0': c0}) AS m FROM c LEFT JOIN m ON c.sheet = m.sheet AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 GROUP BY ALL)
SELECT sheet, row::INT AS row, col::INT AS col, m.seq::INT AS merge, coalesce(row = m.r0 AND col = m.c0, true) AS drawn FROM j
""",
)
def merge_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet"))
    cells = sheets.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(7))))
    merges = sheets.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    top = (F.col("sheet") + F.col("seq") * 3) % 10
    merges = merges.select("sheet", "seq", top.alias("r0"), (top + 1).alias("r1"), (F.col("seq") % 5).alias("c0"), (F.col("seq") % 5 + 2).alias("c1"))
    return sheet.merge_owner(cells, merges, ["sheet"])


@query(
    "col_width_ranges",
    """
WITH c AS (SELECT n_nationkey AS sheet, k.range AS col FROM nation, range(30) k),
w AS (SELECT n_nationkey AS sheet, s.range AS seq, (n_nationkey * 5 + s.range * 7) % 25 AS lo, (n_nationkey * 5 + s.range * 7) % 25 + s.range * 2 AS hi, 4 + s.range AS chars, s.range = 3 AS hidden FROM nation, range(5) s),
j AS (SELECT c.sheet, col, arg_min({'chars': chars, 'hidden': hidden}, seq) AS hit FROM c LEFT JOIN w ON c.sheet = w.sheet AND col BETWEEN lo AND hi GROUP BY ALL)
SELECT sheet, col::INT AS col, CASE WHEN hit.hidden THEN 0.0::DOUBLE ELSE coalesce(hit.chars::DOUBLE, 8.43::DOUBLE) * 7 + 5 END AS width FROM j
""",
)
def col_width_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet"))
    cols = sheets.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(29))))
    ranges = sheets.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4))))
    low = (F.col("sheet") * 5 + F.col("seq") * 7) % 25
    ranges = ranges.select("sheet", "seq", low.alias("lo"), (low + F.col("seq") * 2 + 1).alias("past"), (F.col("seq") + 4).alias("chars"), (F.col("seq") == 3).alias("hidden"))
    found = intervals.interval_join(cols, ranges, ["sheet"], "col", "lo", "past", "seq", bucket=16)
    width = F.when(F.col("hidden"), 0.0).otherwise(F.coalesce(F.col("chars").cast("double"), F.lit(8.43)) * 7 + 5)
    return found.select("sheet", "col", width.alias("width"))


@query(
    "row_heights",
    """
WITH r AS (SELECT l_orderkey AS sheet, (l_linenumber % 4)::INT AS row, round(l_extendedprice * 100)::BIGINT * 100 + l_partkey % 97 AS seq, l_quantity::INT % 7 = 0 AS hidden, CASE WHEN l_partkey % 3 > 0 THEN l_quantity END AS height FROM lineitem)
SELECT sheet, row, CASE WHEN bool_or(hidden) THEN 0.0 ELSE coalesce(last(height ORDER BY seq), 15.0) END AS height FROM r GROUP BY sheet, row
""",
)
def row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sheet"), (F.col("l_linenumber") % 4).cast("int").alias("row"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 100 + F.col("l_partkey") % 97).alias("seq"),
        (F.col("l_quantity").cast("int") % 7 == 0).alias("hidden"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity")).alias("height"),
    )
    return sheet.row_heights(records, ["sheet"])


@query(
    "visible_count",
    """
WITH p AS (SELECT p_brand, p_partkey, p_size, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ends, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT p_brand, coalesce(min(i) FILTER (ends > 595), count(*))::BIGINT AS visible FROM p GROUP BY p_brand
""",
)
def visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.visible_count(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size", 595)


@query(
    "cum_positions",
    "SELECT p_brand, p_partkey, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM part",
)
def cum_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.prefix_positions(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_partkey", "p_size").drop("p_size")


@query(
    "text_overflow",
    """
WITH c AS (SELECT p_brand, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS col, CASE WHEN p_partkey % 4 = 1 THEN p_name ELSE '' END AS text FROM part),
w AS (SELECT *, min(col) FILTER (text <> '') OVER (PARTITION BY p_brand ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(col) OVER (PARTITION BY p_brand) AS last FROM c)
SELECT p_brand, col, least(coalesce(stop - 1, last), col + greatest(ceil(length(text) * 5.5 / 30) - 1, 0))::INT AS end_col FROM w WHERE text <> ''
""",
)
def text_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    numbered = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    cells = table(spark, sf_dir, "part").select("p_brand", numbered.alias("col"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_name")).otherwise("").alias("text"))
    return sheet.overflow(cells, ["p_brand"], F.lit(30), text.text_width(F.col("text"), F.lit(11))).drop("text")


@query(
    "rows_full_outer",
    """
WITH c AS (SELECT l_orderkey * 3 + l_partkey % 3 AS row, count(*) AS cells FROM lineitem GROUP BY 1), i AS (SELECT o_orderkey * 3 + o_custkey % 3 AS row, o_totalprice AS height FROM orders)
SELECT coalesce(c.row, i.row) AS row, coalesce(cells, 0) AS cells, coalesce(height, 15.0) AS height FROM c FULL OUTER JOIN i ON c.row = i.row
""",
)
def rows_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 3 + F.col("l_partkey") % 3).alias("row")).agg(F.count(F.lit(1)).alias("cells"))
    info = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3 + F.col("o_custkey") % 3).alias("row"), F.col("o_totalprice").alias("height"))
    return cells.join(info, "row", "full_outer").select("row", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("height", F.lit(15.0)).alias("height"))


@query(
    "apply_tint",
    """
WITH c AS (SELECT p_partkey, (p_partkey * 40503 % 256)::INT AS r, (p_partkey * 977 % 256)::INT AS g, (p_size * 5 % 256)::INT AS b, (p_partkey % 9 - 4) / 5.0::DOUBLE AS t FROM part),
f AS (SELECT *, lambda_t FROM (SELECT *, t AS lambda_t FROM c))
SELECT p_partkey, CASE WHEN t = 0 THEN printf('%02x%02x%02x', r, g, b) WHEN t > 0 THEN printf('%02x%02x%02x', least(255, floor(r + (255 - r) * t + 0.5))::INT, least(255, floor(g + (255 - g) * t + 0.5))::INT, least(255, floor(b + (255 - b) * t + 0.5))::INT)
  ELSE printf('%02x%02x%02x', greatest(0, floor(r * (1 + t) + 0.5))::INT, greatest(0, floor(g * (1 + t) + 0.5))::INT, greatest(0, floor(b * (1 + t) + 0.5))::INT) END AS rgb FROM f
""",
)
def apply_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    base = color.to_hex(key * 40503 % 256, key * 977 % 256, F.col("p_size") * 5 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", color.apply_tint(base, (key % 9 - 4) / F.lit(5.0)).alias("rgb"))


@query(
    "pie_shares",
    """
WITH s AS (SELECT l_linestatus AS chart, l_returnflag AS slice, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL)
SELECT chart, slice, floor(v / sum(v) OVER w * 2 * pi() * 1e6 + 0.5) / 1e6 AS sweep,
  floor((coalesce(sum(v) OVER (PARTITION BY chart ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(v) OVER w * 2 * pi() - pi() / 2) * 1e6 + 0.5) / 1e6 AS start
FROM s WINDOW w AS (PARTITION BY chart)
""",
)
def pie_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("chart"), F.col("l_returnflag").alias("slice")).agg(F.sum("l_quantity").cast("long").alias("v"))
    return sheet.pie(slices, ["chart"], "slice", "v").select("chart", "slice", R6(F.col("sweep")).alias("sweep"), R6(F.col("start")).alias("start"))


@query(
    "nice_axis",
    """
WITH s AS (SELECT o_orderpriority AS series, least(min(o_totalprice), 0.0) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
u AS (SELECT *, 10.0 ^ floor(log10(hi - lo)) AS p FROM s), n AS (SELECT *, p * CASE WHEN (hi - lo) / p <= 1 THEN 1 WHEN (hi - lo) / p <= 2 THEN 2 WHEN (hi - lo) / p <= 5 THEN 5 ELSE 10 END / 5 AS r FROM u),
q AS (SELECT *, 10.0 ^ floor(log10(r)) AS p2 FROM n), t AS (SELECT *, p2 * CASE WHEN r / p2 < 1.5 THEN 1 WHEN r / p2 < 3 THEN 2 WHEN r / p2 < 7 THEN 5 ELSE 10 END AS step FROM q)
SELECT series, floor(lo / step) * step AS lo, ceil(hi / step) * step AS hi, step FROM t
""",
)
def nice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    return per.select("series", sheet.nice_axis(F.col("a"), F.col("b")).alias("x")).select("series", "x.*")
