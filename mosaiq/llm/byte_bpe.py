"""Byte-level BPE: encoding and decoding by ranks, as the tiktoken library does it.

Pieces (matches of the split pattern) that are tokens themselves get their id. The others are encoded together, in
matrices of equal length: one row a piece, one column a part. In each round every row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table held in numpy arrays, and only the two pairs beside the
merge are looked up again. Rows lose one column a round, so the matrix stays rectangular; rows without a mergeable
pair leave it. A row of n bytes takes up to n rounds of n columns: pieces of more than LONG bytes, which words are not, are
merged with a heap by the same rule instead, in n log n (the README has the figures).

Text between single spaces is encoded once and kept, where the spaces around it are single and so cannot be part of
a longer match; what is longer than KEPT characters is dropped after its batch, so the maps hold MOST short strings at most.

Null text is empty and has no ids. Nothing is truncated. Rows are encoded singly: repeated rows and ids get the same result
each, a null id is carried along; a tie of ranks goes to the leftmost pair. Empty tables give no rows; columns not named in keep
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 512
NONE = np.int64(1 << 40)
#: Unicode's White_Space, as the Rust library reads \s; Python's also has the separators 1C-1F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MOST, KEPT = 200_000, 64


class PairTable:
    """(left id, right id) -> id of the joined token, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(4, int(len(left) * 2).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        at, todo, joined = self._home(keys), np.arange(len(keys)), joined.astype(np.int64)
        self.steps = 1
        while len(todo):
            free = self.keys[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], joined[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            if len(todo):
                at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
                self.steps += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        flat, want, at = out.ravel(), keys.ravel(), at.ravel()
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            held = self.keys[at[rest]]
            hit = held == want[rest]
            flat[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return flat.reshape(keys.shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array([p[i] for p in pairs], np.int64) for i in range(3)))
        exact = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(exact).findall
        self.unclean = re.compile(f"[{SPACE}] | [{SPACE}]").search
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.pairs(np.array(ids[:-1]), np.array(ids[1:]))) if r < NONE]
        heapq.heapify(heap)
        join = lambda i, j: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := join(i, after[i])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := join(before[i], i)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], "<u4")

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Serialized ids (u32) of pieces that are no tokens themselves."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n > LONG:
                for i in at:
                    out[i] = self._merge_long(pieces[i]).tobytes()
                continue
            m = self.single[np.frombuffer(b"".join(pieces[i] for i in at), np.uint8)].reshape(len(at), n)
            rank = self.pairs(m[:, :-1], m[:, 1:])
            while len(at):
                rows = np.arange(len(at))
                j = rank.argmin(1) if rank.shape[1] else np.zeros(len(at), np.int64)
                best = rank[rows, j] if rank.shape[1] else np.full(len(at), NONE)
                done = best >= NONE
                if done.any():
                    for i, ids in zip(at[done], m[done].astype("<u4"), strict=True):
                        out[i] = ids.tobytes()
                    m, rank, at, j, best = m[~done], rank[~done], at[~done], j[~done], best[~done]
                    rows = np.arange(len(at))
                    if not len(at):
                        break
                width = m.shape[1]
                m[rows, j] = best
                keep = np.ones(m.shape, bool)
                keep[rows, j + 1] = False
                m = m[keep].reshape(len(at), width - 1)
                keep = np.ones(rank.shape, bool)
                keep[rows, j] = False
                rank = rank[keep].reshape(len(at), width - 2)
                left, right = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
                if len(left):
                    rank[left, j[left] - 1] = self.pairs(m[left, j[left] - 1], m[left, j[left]])
                if len(right):
                    rank[right, j[right]] = self.pairs(m[right, j[right]], m[right, j[right] + 1])
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that aren't known, all their unknown pieces in one go."""
        split = [self.split(c) for c in chunks]
        missing: dict[str, None] = {}
        for ps in split:
            for p in ps:
                if p not in self.pieces:
                    missing[p] = None
        todo = []
        for p in missing:
            raw = p.encode("utf-8")
            if (r := self.ranks.get(raw)) is not None:
                self.pieces[p] = np.array([r], "<u4").tobytes()
            else:
                todo.append((p, raw))
        for (p, _), ids in zip(todo, self.merge([raw for _, raw in todo]), strict=True):
            self.pieces[p] = ids
        for c, ps in zip(chunks, split, strict=True):
            self.chunks[c] = b"".join(map(self.pieces.__getitem__, ps))
        for p in missing:
            if len(p) > KEPT:
                del self.pieces[p]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.unclean(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.pieces) > MOST or len(self.chunks) > MOST:
            self.pieces.clear()
            self.chunks.clear()
        parts = [self._chunks(t) if t else [] for t in texts]
        # a match of the pattern by itself may match otherwise than in its text: " " before a line break, say
        whole = [bool(t) and self.unclean(t) is not None for t in texts]
        missing: dict[str, None] = {}
        for chunks, w in zip(parts, whole, strict=True):
            if not w:
                for c in chunks:
                    if c not in self.chunks:
                        missing[c] = None
        self._learn(list(missing))
        # pieces of whole texts, long ones too, are there until the batch is done
        loose = list(dict.fromkeys(p for chunks, w in zip(parts, whole, strict=True) if w for p in chunks if p not in self.pieces))
        raws = [p.encode("utf-8") for p in loose]
        todo = [i for i, r in enumerate(raws) if r not in self.ranks]
        for i, r in enumerate(raws):
            if r in self.ranks:
                self.pieces[loose[i]] = np.array([self.ranks[r]], "<u4").tobytes()
        for i, ids in zip(todo, self.merge([raws[i] for i in todo]), strict=True):
            self.pieces[loose[i]] = ids
        out = [np.frombuffer(b"".join(map((self.pieces if w else self.chunks).__getitem__, chunks)), "<u4") for chunks, w in zip(parts, whole, strict=True)]
        for x in (*missing, *loose):
            if len(x) > KEPT:
                self.chunks.pop(x, None)
                self.pieces.pop(x, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def blocks(texts: list[str | None], most: int = 1 << 20):
    """The texts in runs of about a million characters, to bound what is split at one time."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns named in keep, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of each document; the last digest is of the bytes decoded from the ids."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(len(keep) + 1).to_pylist()):
                found = own.encode_batch(texts)
                listed = [ids.tolist() for ids in found]
                raws = [own.decode(ids) for ids in listed]
                columns = [c.slice(done, len(texts)) for c in batch.columns[: len(keep) + 1]]
                columns += [pa.array([len(ids) for ids in found], pa.int64())]
                columns += [pa.array([hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest() for ids in listed], pa.string())]
                columns += [pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string())]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))]
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
