"""Exact deduplication by a minimal perfect hash over historical distinct digests.

The history (distinct digests that are known already, each with its winner and its count) is cut into shards by the
digest's leading bits. Each shard gets a minimal perfect hash function: n digests to n slots, by a pilot for each bucket of
about four digests. A slot holds the full 32-byte digest, the winner's id and the group's size. A lookup computes the
one possible slot and compares all 32 bytes, so a digest outside the history is never taken for a member. Rows that are
members repeat the slot's winner; nonmembers are grouped separately among themselves, in slots of their own.

Without a history of its own, a table is its own: the upper half of its id range is history (of equal texts the largest id
stays, so whatever repeats it goes), and the rest, rows without id too, is looked up in it.

Texts are equal when identical; null counts as the empty text. Rows that share the winning id of a group are all kept.
Any long is an id, negative ones too; a null id never wins while its group has another, and rows of a group
without any id are all kept. A digest that stands in a given history twice is merged. Texts of any length count by
their digest. Empty tables give empty results; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.shared import discard, written

#: Digests to a shard, about; and probing rows to a task, about.
SHARD_ROWS = 4096
KEYS_A_BUCKET = 4
INDEX = "shard int, own boolean, rows long, n long, pilots binary, digests binary, winners binary, named binary, sizes binary"
#: Shards of more rows than one of MOST_HOT-th of all are dealt to several tasks: there are fewer than MOST_HOT of them.
MOST_HOT = 1 << 16
_BLOCK = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a digest that choose its bucket and its slot; the leading word chooses the shard."""
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1], words[:, 2] ^ words[:, 3]


def _slots(own: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (_mix(own ^ _mix(pilots + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the buckets, and the slot of each of the n distinct 32-byte digests (uint8, n x 32)."""
    n = len(digests)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(np.unique(digests.view("<u8").reshape(-1, 4), axis=0)) < n:
        raise ValueError("a digest is there twice")
    m = n // KEYS_A_BUCKET + 1
    first, own = _parts(digests)
    bucket = (first % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=m)
    ends = np.cumsum(counts)
    pilots, taken, slots = np.zeros(m, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-counts, kind="stable"):
        if not counts[b]:
            break
        keys = order[ends[b] - counts[b] : ends[b]]
        start = 0
        while True:
            tries = np.arange(start, start + _BLOCK, dtype=np.uint64)
            at = _slots(own[keys][None, :], tries[:, None], n)
            good = ~taken[at].any(1)
            if len(keys) > 1:
                near = np.sort(at, axis=1)
                good &= (near[:, 1:] != near[:, :-1]).all(1)
            if good.any():
                k = int(good.argmax())
                pilots[b], slots[keys] = start + k, at[k]
                taken[at[k]] = True
                break
            start += _BLOCK
    return pilots, slots


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _entries(pdf: pd.DataFrame) -> dict:
    """The index columns of (digest, winner, named, size) rows, in slot order."""
    digests = _matrix(pdf["digest"])
    pilots, slots = build_mph(digests)
    back = np.argsort(slots)
    columns = {"winners": pdf["winner"].to_numpy(np.int64), "named": pdf["named"].to_numpy(bool), "sizes": pdf["size"].to_numpy(np.int64)}
    return {"n": len(pdf), "pilots": pilots, "digests": digests[back]} | {c: x[back] for c, x in columns.items()}


def lookup_mph(index: dict, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each digest: whether it is in the index, and its slot there."""
    if not index["n"]:
        return np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
    pilots, (first, own) = index["pilots"], _parts(digests)
    slot = _slots(own, pilots[(first % np.uint64(len(pilots))).astype(np.int64)].astype(np.uint64), index["n"])
    return (index["digests"][slot] == digests).all(1), slot


def _build_shard(key: tuple, history: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    """Index rows of a shard: the history's, whose sizes count the fresh digests found in it, and that of the nonmembers."""
    held, rows = _entries(history), int(history["size"].sum() + fresh["size"].sum())
    member, slot = lookup_mph(held, _matrix(fresh["digest"]))
    np.add.at(held["sizes"], slot[member], fresh["size"].to_numpy(np.int64)[member])
    both = [(own, x) for own, x in ((False, held), (True, _entries(fresh[~member]))) if x["n"]]
    return pd.DataFrame([{"shard": key[0], "own": own, "rows": rows} | {c: v if c == "n" else v.tobytes() for c, v in x.items()} for own, x in both], columns=[c.split()[0] for c in INDEX.split(", ")])


def _read(row) -> dict:
    kinds = {"pilots": np.uint32, "digests": np.uint8, "winners": np.int64, "named": bool, "sizes": np.int64}
    found = {"n": int(row.n)} | {c: np.frombuffer(getattr(row, c), kind) for c, kind in kinds.items()}
    return found | {"digests": found["digests"].reshape(-1, 32)}


def _probe(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Each row's group: from the history's slots, or else from those of the nonmembers."""
    out = probes[["row", "has_id", "digest"]].copy()
    digests, n = _matrix(probes["digest"]), len(probes)
    found = {"repeats": np.zeros(n, bool), "winner": np.zeros(n, np.int64), "named": np.zeros(n, bool), "size": np.zeros(n, np.int64)}
    for r in index.itertuples() if n else ():
        held = _read(r)
        member, slot = lookup_mph(held, digests)
        for c, values in (("winner", "winners"), ("named", "named"), ("size", "sizes")):
            found[c][member] = held[values][slot[member]]
        found["repeats"][member] = not r.own
    return out.assign(**found)


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, digest): the id and the 32 bytes of the text's SHA-256."""
    return docs.select(F.col(id_col).cast("long").alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def group_digests(digests: DataFrame) -> DataFrame:
    """(digest, winner, size) of each distinct digest; counted before the shuffle, so that no group meets in one task."""
    return digests.groupBy("digest").agg(F.max("row").alias("winner"), F.count(F.lit(1)).alias("size"))


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(history: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """Index rows of history and fresh (digest, winner, size), each of distinct digests."""
    sides = [
        x.select("digest", F.coalesce("winner", F.lit(0)).alias("winner"), F.col("winner").isNotNull().alias("named"), "size", _shard(shards).alias("shard")).groupBy("shard")
        for x in (history, fresh)
    ]
    return sides[0].cogroup(sides[1]).applyInPandas(_build_shard, INDEX)


def probe_index(digests: DataFrame, index: DataFrame, shards: int, n: int) -> DataFrame:
    """(row, has_id, digest, repeats, winner, named, size) of each of the n rows of digests (row, digest).

    A shard of many rows has salts: its rows are dealt to that many tasks, each with a copy of the index rows. A salt
    stands for more than a MOST_HOT-th of all rows, so the table of such shards is small by its definition.
    """
    most = max(4 * SHARD_ROWS, n // MOST_HOT)
    hot = index.groupBy("shard").agg(F.max("rows").alias("rows")).where(F.col("rows") > most)
    hot = hot.select("shard", F.ceil(F.col("rows") / most).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    rows = digests.select(F.coalesce("row", F.lit(0)).alias("row"), F.col("row").isNotNull().alias("has_id"), "digest", _shard(shards).alias("shard"))
    probes = rows.join(F.broadcast(hot), "shard", "left").withColumn("salt", F.pmod(F.xxhash64("row", "digest"), salts).cast("int")).drop("salts")
    copies = index.join(F.broadcast(hot), "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    both = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
    return both.applyInPandas(_probe, "row long, has_id boolean, digest binary, repeats boolean, winner long, named boolean, size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, repeats_history, text_sha256.

    history (digest, winner, size) holds digests known already; by default those of the upper half of docs' ids. Members
    have their slot's winner for keep_id; nonmembers are grouped separately, the largest id staying. group_size counts
    the rows of docs and those of the history.
    """
    digests = written(text_digests(docs, id_col, text_col), "digests")
    n, least, most = digests.agg(F.count(F.lit(1)), F.min("row"), F.max("row")).first()
    shards = max(1, -(-n // SHARD_ROWS))
    if history is None:
        old = F.lit(False) if most is None else F.coalesce(F.col("row") >= (least + most) // 2, F.lit(False))
        known, fresh = group_digests(digests.where(old)), group_digests(digests.where(~old))
    else:
        known, fresh = history.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("size").alias("size")), group_digests(digests)
    index = written(build_index(known, fresh, shards), "mph")
    found = written(probe_index(digests, index, shards, n), "probed")
    discard(digests)
    discard(index)
    keep, row = F.when(F.col("named"), F.col("winner")), F.when(F.col("has_id"), F.col("row"))
    return found.select(
        row.alias("doc_id"),
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        row.eqNullSafe(keep).alias("kept"),
        F.col("repeats").alias("repeats_history"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
