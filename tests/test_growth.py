"""What must not grow with the tables: recursion limits, quadratic windows, data in one task or at the driver."""

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import sheet, trees
from mosaiq.plans.registry import all_queries
from tests.oracle import SF, same


@pytest.fixture
def few_recursions(spark):
    """Spark's limit of 1,000,000 rows of a recursion, brought down to the size of the tests."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    yield
    spark.conf.set(key, before)


def test_style_chain_has_no_row_limit(spark, few_recursions):
    q = all_queries()["style_chain"]
    same(q.run(spark, SF), q.sql)


def test_style_chain_ends(spark):
    rows = [("a", 1, 2, None), ("a", 2, 3, 7), ("a", 3, 9, 8), ("b", 1, 1, 5), ("b", 2, None, 6), (None, 1, 1, 4), ("b", None, 2, 3)]
    styles = spark.createDataFrame(rows, "f string, id long, parent long, value int")
    got = {tuple(r) for r in trees.style_chain(styles, ["f"], 2).collect()}
    want = {("a", 1, 0, 1, None), ("a", 1, 1, 2, 7), ("a", 1, 2, 3, 8), ("a", 2, 0, 2, 7), ("a", 2, 1, 3, 8), ("a", 3, 0, 3, 8), ("b", 1, 0, 1, 5), ("b", 1, 1, 1, 5), ("b", 1, 2, 1, 5)}
    assert got == want | {("b", 2, 0, 2, 6), (None, 1, 0, 1, 4), ("b", None, 0, None, 3), ("b", None, 1, 2, 6)}
    assert [r["n"] for r in trees.style_chain(styles, ["f"], 0).groupBy().count().withColumnRenamed("count", "n").collect()] == [len(rows)]


def test_overflow_is_linear(spark):
    n = 4000
    long = {k: "x" * (k % 37) for k in range(0, n, 7)}
    cells = spark.createDataFrame([(f, k, long.get(k, "")) for f in ("a", "b") for k in range(n)], "f string, col int, text string")
    out = sheet.overflow(cells, ["f"], F.lit(2), F.length("text"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    texts = [k for k in long if long[k]]
    ends = dict(zip(texts, [*(k - 1 for k in texts[1:]), n - 1], strict=True))
    want = {(f, k, min(ends[k], k + max(0, -(-len(long[k]) // 2) - 1))) for f in ("a", "b") for k in texts}
    assert {(r["f"], r["col"], r["end_col"]) for r in out.collect()} == want


def _chains(links, starts, limit, end=-2):
    """Plain walk of every branch, as the SQL has it."""
    out = []
    for chain, sector in starts:
        now = [[sector]] if sector != end else []
        while now:
            out += [(chain, len(p) - 1, p[-1]) for p in now]
            now = [[*p, n] for p in now if len(p) <= limit for s, n in links if p[-1] is not None and s == p[-1] and n is not None and n != end and n not in p]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [100_000, 5, 4])
@pytest.mark.parametrize("forks", [[], [(1, 30), (4, 2)]])
def test_chain_order_ends(spark, forks, limit):
    # a line, a cycle with a tail, a loop on itself, an end, a sector that isn't there, no sector
    links = [(i, i + 1) for i in range(1, 20)] + [(20, -2), (30, 31), (31, 32), (32, 33), (33, 31), (40, 40), (41, 99), (42, None), (None, 1), *forks]
    starts = [(i, s) for i, s in enumerate((1, 1, 8, 30, 32, 40, 41, 42, 77, None, -2, 20))]
    got = trees.chain_order(spark.createDataFrame(links, "sector long, next long"), spark.createDataFrame(starts, "chain long, sector long"), limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _chains(links, starts, limit)


def test_fat_chain_has_no_row_limit(spark, few_recursions):
    q = all_queries()["fat_chain"]
    same(q.run(spark, SF), q.sql)


def test_cell_display_shuffles_no_cells(spark):
    q = all_queries()["cell_display"]
    assert "hashpartitioning" not in q.run(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_display_values_deals_cells_without_index(spark):
    values = [("s", " 3"), ("s", "12"), ("s", "x"), ("s", None), ("b", "1"), ("b", "0"), ("n", "3"), ("n", None), (None, "4")]
    cells = spark.range(4500).select("id", F.element_at(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in values)), (F.col("id") % 9 + 1).cast("int")).alias("c")).select("id", "c.*")
    strings = spark.createDataFrame([(3, "three"), (None, "none"), (9, "nine")], "idx long, text string")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = sheet.display_values(cells, strings).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shown = ["three", "", "", "", "TRUE", "FALSE", "3", "", "4"]
    assert sorted((r["id"], r["display"]) for r in got) == [(i, shown[i % 9]) for i in range(4500)]
    parts = [r["part"] for r in got]
    assert max(map(parts.count, set(parts))) < 0.6 * len(parts)
