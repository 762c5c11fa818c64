"""Mixing sources to target weights, by capped water-filling; DataFrame functions only.

A document's size is its number of words. Sources, by code point and null last, weigh 1, 2, 3, repeating; together
they are to take as many words as all documents have. A source's target stops at max_epochs times its size; what it
leaves goes to the others in proportion to their weights, until none is above.

A source is then read target / size times: whole repetitions of every document, and a last fractional repetition in
seeded order that stops where the target is met. One document of a source at most is taken in part. The seeded order is
the MD5 of seed and id, so reruns agree whatever the partitioning. Sums before a document come from sums over
(source, bucket of the MD5) and a window within the bucket only: a source with a third of all rows is never in one task.

Null text has size 0 and is taken 0 times; rows of equal id and MD5 are ordered by size; a source without words has target 0.
Texts of any length are counted whole. Empty tables give no rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.shared import WORDS, written

MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the MD5 that name a bucket: 4096 for each source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def text_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source.

    A source is capped if, with all that reach their cap sooner capped already, its share is above its cap: sources
    by cap / weight, in the order in which rising water fills them. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything, fill = Window.partitionBy(), Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # above its cap: left * weight / w_left > cap, in whole numbers
    per = per.withColumn("capped", F.col("left").cast("decimal(30,0)") * F.col("weight") > F.col("cap").cast("decimal(30,0)") * F.col("w_left"))
    free = lambda c, f: f(F.when(~F.col("capped"), F.col(c))).over(everything)
    level = free("left", F.max).cast("double") / free("w_left", F.max).cast("double")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: int = SEED, with_name: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted); with_name also `name`, the
    SHA-256 of the text, which with the id tells documents apart where ids are null or repeat."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("key"), *[text_name(F.col(text_col)).alias("name")] * with_name)
    rows = written(rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sizes")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    targets = source_targets(rows, max_epochs)
    plan = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(sums["source"].alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["bucket"] == plan["b"]))
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    rest = words - whole * F.col("source_size") - F.col("ahead") - F.col("inside")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return found.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *["name"] * with_name)
