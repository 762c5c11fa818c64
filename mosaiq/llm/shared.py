"""What the operators share: working folder, written intermediate tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.session import discard, new_path, work_dir, written  # noqa: F401

WORDS = r"[^\x20\x09-\x0D]+"


def forest(u, v):
    """Spanning forest of links (arrays of node ids): every node but the smallest of its part, with that smallest."""
    import numpy as np

    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return np.stack([nodes[far], nodes[label[far]]], 1)


def _forest(batches):
    import pandas as pd

    for pdf in batches:
        yield pd.DataFrame(forest(pdf["u"].to_numpy(), pdf["v"].to_numpy()), columns=["u", "v"])


#: A node of more edges than HOT, and than a HOT_SHARE-th of all, is joined by broadcast: fewer than 2 * HOT_SHARE nodes are.
HOT, HOT_SHARE = 200, 1 << 16


def _stars(edges: DataFrame, large: bool, hot: int) -> DataFrame:
    """One large-star or small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    many, few = least.where(F.col("n") > hot).select("u", "m"), least.where(F.col("n") <= hot)
    # the edges of a centre are dealt by their other end; the table of centres is small by its definition
    marked = both.join(F.broadcast(many), "u", "left").withColumn("at", F.when(F.col("m").isNull(), F.col("u")).otherwise(F.col("v")))
    moved = marked.join(few.select(F.col("u").alias("at"), F.col("m").alias("own")).hint("merge"), "at", "left").select("u", "v", F.coalesce("m", "own").alias("m"))
    if large:
        return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    kept = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): rows (u, v), every linked node but the smallest to the smallest.

    Alternating large-star and small-star steps until nothing moves. Each block of edges is first reduced to a
    spanning forest, so that duplicate links inside a group never travel. Each round is written to the shared
    folder. Loops and nulls are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = written(ends.mapInPandas(_forest, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if seen == mark or seen[0] == 0:
            return now
        mark = seen
        hot = max(HOT, seen[0] // HOT_SHARE)
        # Large stars keep the connection of every node; the smaller ends come from the small step.
        step = written(_stars(_stars(now, True, hot), False, hot), "edges")
        discard(now)
        now = step


#: Stand-ins for the ids of classes that have none; ids beyond it on one side are moved below it.
FAR = 1 << 62


class Nodes:
    """Nodes of a graph for classes of documents, in the order of their smallest ids, classes without any id last."""

    def __init__(self, move: int, bare: bool):
        self.move, self.bare = move, bare

    def of(self, least: Column, name: Column) -> Column:
        return F.coalesce(least + self.move, F.lit(FAR) + F.pmod(F.xxhash64(name), F.lit(FAR - 1)))

    def id(self, node: Column) -> Column:
        """The id that a node stands for, null for none."""
        return F.when(node < FAR, node - self.move) if self.bare else node


def with_nodes(classes: DataFrame, label: str) -> tuple[DataFrame, Nodes]:
    """classes (least, name, ...) written with `node` in place of least, the smallest id. Ids may be beyond 2^62 on one side, or on
    both if no class lacks one."""
    classes = written(classes, label)
    lo, hi, bare = classes.agg(F.min("least"), F.max("least"), F.count_if(F.col("least").isNull())).first()
    move = -FAR if bare and hi is not None and hi >= FAR else 0
    if move and lo < -FAR:
        raise ValueError("ids beyond 2^62 on both sides, and rows without id")
    nodes = Nodes(move, bool(bare))
    return classes.withColumn("node", nodes.of(F.col("least"), F.col("name"))).drop("least"), nodes
