"""Video sample tables: run-length times, step functions and offsets, all as windows over a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.intervals import as_of


def target_sample(stts: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """The sample (from 1) at `share` of the duration, from run-length entries (keys, i, count, delta).

    Within an entry samples are passed while the next one still begins at or before the target; a track stops in the
    first entry where the target is reached, and otherwise goes on in the next, from the time it has come to. That is an
    ordered fold over the entries of one track. The result is at most the number of samples.
    """
    entries = F.array_sort(F.collect_list(F.struct("i", "count", "delta")))
    goal = F.floor(F.sum(F.col("count") * F.col("delta")) * share)
    per = stts.groupBy(*keys).agg(entries.alias("_entries"), goal.alias("_goal"), F.sum("count").alias("total"))

    def step(state, e):
        free = F.when(e["delta"] > 0, F.floor((F.col("_goal") - state["time"]) / e["delta"])).otherwise(e["count"])
        k = F.when(state["time"] >= F.col("_goal"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(e["count"], free))).cast("long")
        return F.struct((state["time"] + k * e["delta"]).alias("time"), (state["passed"] + k).alias("passed"))

    start = F.struct(F.lit(0).cast("long").alias("time"), F.lit(0).cast("long").alias("passed"))
    return per.select(*keys, F.least(F.aggregate("_entries", start, step)["passed"] + 1, "total").alias("target"), "total")


def sync_sample(targets: DataFrame, stss: DataFrame, keys: list[str]) -> DataFrame:
    """The last sync sample at or before the target; 1 if there is none before it; the target itself for a track without sync table."""
    has = stss.groupBy(*keys).agg(F.lit(True).alias("_has"))
    found = as_of(targets.withColumnRenamed("target", "sample"), stss.withColumn("sync", F.col("sample")), keys, "sample", "sync")
    found = found.join(has, keys, "left")
    return found.select(*keys, F.col("sample").alias("target"), F.when(F.col("_has"), F.coalesce("sync", F.lit(1))).otherwise(F.col("sample")).alias("sync"))


def chunk_sizes(chunks: DataFrame, stsc: DataFrame, keys: list[str]) -> DataFrame:
    """Samples in each chunk: the step function of (keys, chunk, per) over all chunks."""
    return as_of(chunks, stsc, keys, "chunk", "per", 1)


def sample_offsets(chunks: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, offset, size): a sample's chunk by running sums of chunk sizes, then the sizes before it in that chunk.

    chunks (keys, chunk, per, offset) are enumerated to their samples, so nothing is joined by range.
    """
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = chunks.withColumn("first", F.coalesce(F.sum("per").over(w), F.lit(0)) + 1).where("per > 0")
    held = first.select(*keys, "chunk", "offset", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("per") - 1)).alias("sample"))
    ahead = Window.partitionBy(*keys, "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    both = held.join(sizes, [*keys, "sample"])
    return both.select(*keys, "sample", (F.col("offset") + F.coalesce(F.sum("size").over(ahead), F.lit(0))).alias("offset"), "size")
