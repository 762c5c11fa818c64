"""Embedding near-deduplication: random-hyperplane sign hashing in several tables, exact cosines, components.

Each of `tables` tables cuts a vector to `bits` signs of fixed random projections. Vectors that share a bucket of any table
are compared by cosine in double precision; cosine >= THRESHOLD links them. The bits grow with the logarithm of the
number of vectors, so that buckets of unrelated vectors keep their size, and the tables grow so that a pair at the
threshold shares a bucket with probability RECALL at least (closer pairs more often): their product is the cost.

A pair that shares several buckets is counted in the first table only, which both signatures tell, so no pair is ever
sent anywhere: a bucket gives each of its vectors the number of links found, and a spanning forest. Buckets of more than
BLOCK vectors are cut into blocks, and each pair of blocks is one unit of work, so a hot bucket is spread over tasks.
Units are streamed in sorted order, one in memory at a time. Identical vectors are one entry with a multiplicity.

Vectors that are null or zero or hold null or non-finite components link with nothing; vectors of different
lengths never link. Of repeated ids each row counts as a vector. A null id is never a component's name unless no other is
there. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.shared import components, discard, written

THRESHOLD, RECALL, SEED, BLOCK = 0.95, 0.9999, 7, 2048
#: Unrelated vectors to a bucket, about.
BUCKET = 256
_FAR = 1 << 62


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2) / BUCKET))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each unit vector in each table, int32, from the signs of its projections."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(2).astype(np.int32)


def units(raws: list[bytes], wide: int) -> np.ndarray:
    """Unit vectors in double precision of serialized ones; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raws), f"<f{wide}").reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _serialize(wide: int):
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if not v else np.array([np.nan if c is None else c for c in v], f"<f{wide}")
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return run


def _sign(wide: int, bits: int, tables: int):
    """The signatures of each vector."""

    def run(batches):
        for batch in batches:
            raws = batch.column(0).to_pylist()
            sizes = np.array([len(r) for r in raws], np.int64)
            out: list = [None] * len(raws)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i, row in zip(at, signatures(units([raws[i] for i in at], wide), bits, tables), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["raw", "node", "n", "sig"])

    return run


def _pairs(a, b, t: int, same: bool, threshold: float):
    """Links of block a with block b: (index in a, index in b)."""
    near = a["x"] @ b["x"].T >= threshold
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if t and len(i):
        first = (a["sig"][i, :t] != b["sig"][j, :t]).all(1)
        return i, j, first
    return i, j, np.ones(len(i), bool)


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each node of the links with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return np.stack([nodes[far], nodes[label[far]]], 1)


def _unit(rows: dict, tables: int, wide: int, threshold: float):
    """Counts and forest edges (u, v or None, n) of one unit of work: a bucket, or two blocks of a large one."""
    block = rows["block"]
    sides = [np.flatnonzero(block == rows["first"]), np.flatnonzero(block == rows["second"])]
    lone = rows["first"] == rows["second"]
    if not len(sides[0]) or not len(sides[1]) or lone and len(sides[0]) < 2:
        return None
    held = [{"x": units([rows["raw"][i] for i in s], wide), "sig": rows["sig"][s], "node": rows["node"][s], "n": rows["n"][s]} for s in (sides[:1] if lone else sides)]
    a, b = held[0], held[-1]
    i, j, first = _pairs(a, b, rows["t"], lone, threshold)
    if not len(i):
        return None
    nodes, counts = np.concatenate((a["node"][i[first]], b["node"][j[first]])), np.concatenate((b["n"][j[first]], a["n"][i[first]]))
    at, back = np.unique(nodes, return_inverse=True)
    tally = np.zeros(len(at), np.int64)
    np.add.at(tally, back, counts)
    edges = _forest(a["node"][i], b["node"][j])
    return at, tally, edges


def _compare(tables: int, wide: int, threshold: float):
    """Streams entries sorted by unit (t, bucket, size, first, second); only one unit is held."""
    key = ("t", "bucket", "size", "first", "second")

    def run(batches):
        held: list = []
        now = None

        def done():
            if len(held) < 2:
                return None
            unit = {"t": now[0], "first": now[3], "second": now[4], "block": np.array([h[0] for h in held]), "node": np.array([h[1] for h in held]), "n": np.array([h[2] for h in held]), "raw": [h[3] for h in held]}
            unit["sig"] = np.array([h[4] for h in held], np.int32).reshape(-1, tables)
            return _unit(unit, tables, wide, threshold)

        def batch_of(found):
            at, tally, edges = found
            u = np.concatenate((at, edges[:, 0]))
            v = pa.array([*[None] * len(at), *edges[:, 1].tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate((tally, np.zeros(len(edges), np.int64))))], names=["u", "v", "n"])

        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = np.stack([cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in key], 1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else []
            rows = list(zip(*(cols[c].to_pylist() for c in ("block", "node", "n", "raw")), cols["sig"].to_pylist(), strict=True))
            for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                own = tuple(keys[s].tolist())
                if own != now:
                    if (found := done()) is not None:
                        yield batch_of(found)
                    held, now = [], own
                held += rows[s:e]
        if (found := done()) is not None:
            yield batch_of(found)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    wide = 4 if dict(vectors.dtypes)[vector_col] == "array<float>" else 8
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if wide == 4 else 'double'}>").alias("v"))
    rows = written(rows.mapInArrow(_serialize(wide), "vec_id long, raw binary"), "vectors")
    stand_in = F.lit(_FAR) + F.pmod(F.xxhash64("raw"), F.lit(1 << 61))
    classes = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("node", F.coalesce("node", stand_in)), "classes")
    bits, tables = plan(classes.count(), threshold, recall)
    signed = written(classes.select("raw", "node", "n").mapInArrow(_sign(wide, bits, tables), "raw binary, node long, n long, sig array<int>"), "signed")
    buckets = signed.select("*", F.length("raw").alias("size"), F.posexplode("sig").alias("t", "bucket"))
    key = ["t", "bucket", "size"]
    large = buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK)
    large = written(large.select(*key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = buckets.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block b works with itself and with every other; a unit is (lower block, higher block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    dealt = dealt.select(*key, "first", "second", "block", "node", "n", "raw", "sig")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tables)
    unit = [*key, "first", "second"]
    found = dealt.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(_compare(tables, wide, threshold), "u long, v long, n long")
    found = written(found, "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    labels = components(found.where("v is not null").select("u", "v"))
    named = classes.join(counts, classes["node"] == counts["u"], "left").drop("u").join(labels.withColumnRenamed("v", "root"), F.col("node") == F.col("u"), "left")
    named = written(named.select("raw", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "roots")
    discard(signed)
    discard(found)
    linked = rows.where("raw is not null").join(named, "raw").select("vec_id", "n_links", F.when(F.col("root") < _FAR, F.col("root")).alias("component_id"))
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
