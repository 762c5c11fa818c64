"""Exact overlap of shingle sets within candidate groups.

Words and shingles are those of mosaiq.llm.simhash, a set of hashes a text. Each candidate group's texts are gathered
once, and searched breadth-first by exact overlap (common over all shingles), which gives a spanning forest of its
links. Groups of more than BLOCK shingles are dealt into blocks, and each pair of blocks is searched on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import shared
from mosaiq.llm.shared import written

SEED, BLOCK = 42, 1 << 20
#: Least overlap of two sets: numerator, denominator.
SIMILAR = (4, 5)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one for a text without words."""
    raw = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw] or [1]) - 1
    n = max(1, len(raw) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[len(ends) - n :].tolist(), strict=True)], np.uint64))


def similar_links(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links among sets of hashes."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(codes.max() + 1, np.uint8)
    links, left, among = [], np.arange(len(sets)), np.arange(len(sets))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            if 2 * len(left) < len(among):
                codes, among = np.concatenate([own[i] for i in left]), left
            f = front.pop()
            mark[own[f]] = 1
            common = np.add.reduceat(mark[codes], np.cumsum(sizes[among]) - sizes[among], dtype=np.int64)[np.searchsorted(among, left)]
            mark[own[f]] = 0
            near = common * similar[1] >= (sizes[left] + sizes[f] - common) * similar[0]
            links += [(int(f), i) for i in left[near].tolist()]
            front += left[near].tolist()
            left = left[~near]
    return links


def _verify(words: int, similar: tuple[int, int]):
    """Streams members sorted by group and pair of blocks."""

    def run(batches):
        now, last, nodes, sets = None, None, [], []

        def links():
            found = np.array(similar_links(sets, similar) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
            ends = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[found[:, 0]]), pa.array(ends[found[:, 1]])], names=["u", "v"])

        for batch in batches:
            for group, pair, node, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, pair) != now:
                    if nodes:
                        yield links()
                    now, last, nodes, sets = (group, pair), None, [], []
                if name != last:  # rows of one id, or without, may stand there several times
                    last = name
                    nodes.append(node)
                    sets.append(shingles(text, words))
        if nodes:
            yield links()

    return run


def overlap_links(rows: DataFrame, classes: DataFrame, groups: DataFrame, words: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(u, v): links of similar texts within candidate groups.

    rows (node, name, text) has every document with the node of its own id, classes (name, node) each distinct text with that of
    the smallest id, groups (u, v) the nodes of a candidate group to its smallest.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = groups.unionByName(groups.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("group"))
    members = written(classes.join(both.hint("merge"), "node"), "members")
    texts = written(rows.join(members.hint("merge"), ["node", "name"]).select("group", "node", "name", "text"), "candidates")
    blocks = texts.groupBy("group").agg(F.ceil(F.sum(F.length("text") / 4 + 1) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    hot = max(shared.HOT, texts.count() // shared.HOT_SHARE)
    # the texts of a large group are dealt by their nodes; the table of such groups is small by its definition
    many, few = blocks.where(F.col("n") > hot).drop("n"), blocks.where(F.col("n") <= hot)
    marked = texts.join(F.broadcast(many), "group", "left").withColumn("at", F.when(F.col("blocks").isNull(), F.col("group")).otherwise(F.col("node")))
    few = few.select(F.col("group").alias("at"), F.col("blocks").alias("own_blocks"))
    sized = marked.join(few.hint("merge"), "at", "left").withColumn("blocks", F.coalesce("blocks", "own_blocks"))
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("block", block)
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    pair = F.explode(F.transform(others, lambda x: F.least(x, "block").cast("long") * F.col("blocks") + F.greatest(x, "block")))
    dealt = dealt.select("group", pair.alias("pair"), "node", "name", "text").repartition(parts, "group", "pair")
    return dealt.sortWithinPartitions("group", "pair", "node", "name").mapInArrow(_verify(words, similar), "u long, v long")
