"""Substring deduplication with difference-cover anchors.

A window is `window` consecutive words (runs of anything but ASCII white space, unchanged). Every word that is
covered by a window whose words also start anywhere else, in the same document or another, is removed; windows are
judged on the input.

Anchors are the sub-windows of window - PERIOD + 1 words that start at positions whose remainder modulo PERIOD is in a
perfect difference set. For any two positions i and j there is a shift below PERIOD that brings both into the
cover, so two equal windows share an equal anchor at the same shift: only anchors (5 of 21 positions) are counted over
the corpus. Where an anchor repeats, it is extended: all windows that contain it are counted over the corpus by 128-bit
hashes of their words, and those that occur twice are removed.

Counting moves packed arrays, not rows: each task sends a hash once for a block of its documents, to the bucket that
the hash names. What repeats within the block is known at once and isn't sent to the bucket, so neither copies nor a
passage in a third of all documents meet in one task. Answers are positions by text: a text is named by 96 bits of its
SHA-256, so copies share theirs, and the two joins back to texts split hot names. Where there are more than WIDE buckets,
a block's hashes go to groups of buckets first, whose tasks gather them into blocks again and cut those by
bucket: a packed array then has BLOCK / WIDE hashes or so at any size.

Null and empty texts have 0 words and the digest of nothing. Ids are carried along only: null and repeated ids are
fine. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.shared import discard, written

WINDOW, PERIOD = 35, 21
#: Hashes that a task holds before it sends them; characters of text to a bucket.
BLOCK_ANCHORS, BLOCK_WINDOWS, BUCKET_CHARS = 2_000_000, 1_000_000, 24_000_000
#: Buckets that a block is cut into at one time.
WIDE = 4096
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NAME = 12
_HEAD = struct.Struct("<IIII")


@lru_cache(8)
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues of which any two positions, shifted alike, can both be members: each difference is there. Smallest first found."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        chosen = _extend((0, 1) if period > 1 else (0,), size, period)
        if chosen:
            return chosen
        size += 1


def _extend(chosen: tuple[int, ...], size: int, period: int):
    differences = {(a - b) % period for a in chosen for b in chosen}
    if len(chosen) >= size or len(differences) == period:
        return chosen if len(differences) == period else None
    for x in range(chosen[-1] + 1, period):
        if found := _extend((*chosen, x), size, period):
            return found
    return None


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


_WORDS = _Words()


@lru_cache(2)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    b, inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    grow = lambda x: np.concatenate(([np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, x, np.uint64))))
    return grow(b), grow(inverse)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of the `length` words from each position on; polynomial modulo 2^64, mixed."""
    n = len(hashes) - length + 1
    up, down = _powers(int(_BASES[which]), max(16, len(hashes).bit_length()))
    own = hashes if which == 0 else _mix(hashes)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(own * up[: len(own)])))
    return _mix((sums[length:] - sums[:-length]) * down[:n])


def anchors(words: list[bytes], window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes n x 1) at the cover's positions."""
    length = window - period + 1
    if len(words) < window:
        return np.zeros(0, np.uint32), np.zeros((0, 1), np.uint64)
    n = len(words) - length + 1
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    at = np.flatnonzero(np.resize(cover, n))
    return at.astype(np.uint32), rolling(word_hashes(words), length, 0)[at][:, None]


def windows_at(words: list[bytes], found: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes n x 2) of the windows that contain a repeated anchor."""
    n = len(words) - window + 1
    if n < 1 or not len(found):
        return np.zeros(0, np.uint32), np.zeros((0, 2), np.uint64)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.maximum(found.astype(np.int64) - (period - 1), 0), 1)
    np.add.at(marks, found.astype(np.int64) + 1, -1)
    at = np.flatnonzero(np.cumsum(marks)[:n] > 0)
    own = word_hashes(words)
    return at.astype(np.uint32), np.stack([rolling(own, window, k)[at] for k in (0, 1)], 1)


def _pack(names: list[bytes], doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> bytes:
    """Entries ordered by (doc, pos): the names used, entries of each, steps between positions, hashes."""
    used, counts = np.unique(doc, return_counts=True)
    steps = np.diff(pos.astype(np.int64), prepend=0).astype("<i4")
    side = zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes() + steps.tobytes())
    return b"".join([_HEAD.pack(len(used), len(pos), hashes.shape[1], len(side)), *(names[i] for i in used), side, hashes.astype("<u8").tobytes()])


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    used, n, width, size = _HEAD.unpack_from(blob)
    at = _HEAD.size
    names = [blob[at + _NAME * i : at + _NAME * (i + 1)] for i in range(used)]
    at += _NAME * used
    side = zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=4 * (used + n))
    counts, steps = np.frombuffer(side, "<u4", used), np.frombuffer(side, "<i4", n, 4 * used)
    hashes = np.frombuffer(blob, "<u8", n * width, at + size).reshape(n, width)
    return names, np.repeat(np.arange(used), counts), np.cumsum(steps.astype(np.int64)), hashes


def _size(blob: bytes) -> int:
    return _HEAD.unpack_from(blob)[1]


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal hashes together, size of the group of each in that order)."""
    order = np.lexsort(hashes.T[::-1]) if hashes.shape[1] > 1 else np.argsort(hashes[:, 0], kind="stable")
    own = hashes[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]).any(1)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(own)))
    return order, np.repeat(sizes, sizes), new


def _distinct(names: list[bytes], doc: np.ndarray, pos: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(names, text, position): each position of each text once, in order."""
    distinct = sorted(set(names))
    index = {x: i for i, x in enumerate(distinct)}
    to = np.array([index[x] for x in names], np.int64)
    both = np.unique((to[doc] << 32) | pos.astype(np.int64))
    return distinct, both >> 32, both & 0xFFFFFFFF


def _answers(names: list[bytes], doc: np.ndarray, pos: np.ndarray):
    """(name, positions) of each text, each position once."""
    distinct, text, pos = _distinct(names, doc, pos)
    pos = pos.astype("<u4")
    cuts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    for s, e in zip(cuts, np.append(cuts[1:], len(text)), strict=True):
        yield distinct[text[s]], pos[s:e].tobytes()


_SENT = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("blob", pa.binary())])


def _cut(names: list[bytes], doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray, buckets: int, each: int):
    """Packed hashes of a block by bucket (each following buckets together); answers that the block itself gives have bucket -1."""
    order, sizes, new = _groups(hashes)
    many = order[sizes > 1]
    rows = [(-1, name, at) for name, at in _answers(names, doc[many], pos[many])] if len(many) else []
    once = np.sort(order[new])
    bucket = (hashes[once, 0] % np.uint64(buckets)).astype(np.int64) // each
    once = once[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for s, e in zip(cuts, np.append(cuts[1:], len(once)), strict=True):
        own = once[s:e]
        rows.append((int(bucket[s]), None, _pack(names, doc[own], pos[own], hashes[own])))
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(_SENT)], schema=_SENT)


def _count(extract, block: int, buckets: int, each: int):
    """Map side: the hashes of blocks of documents."""

    def run(batches):
        names, held, size = [], [], 0

        def flush():
            nonlocal names, held, size
            if size:
                doc = np.repeat(np.arange(len(held)), [len(p) for p, _ in held])
                pos, hashes = np.concatenate([p for p, _ in held]), np.concatenate([h for _, h in held])
                yield from _cut(names, doc, pos, hashes, buckets, each)
            names, held, size = [], [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, hashes = extract(*row[1:])
                if len(at):
                    names.append(row[0])
                    held.append((at, hashes))
                    size += len(at)
                    if size >= block:
                        yield from flush()
        yield from flush()

    return run


def _recount(block: int, buckets: int):
    """Blocks of a group of buckets, from rows (bucket, blob) sorted by group, cut by bucket."""

    def run(batches):
        now, held, size = None, [], 0

        def flush():
            nonlocal held, size
            if held:
                yield from _cut(*_gathered(held), buckets, 1)
            held, size = [], 0

        for batch in batches:
            for group, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now or size >= block:
                    yield from flush()
                now = group
                held.append(blob)
                size += _size(blob)
        yield from flush()

    return run


def _gathered(blobs: pd.Series) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    names, doc, pos, hashes = [], [], [], []
    for blob in blobs:
        own, d, p, h = _unpack(blob)
        doc.append(d + len(names))
        names += own
        pos.append(p)
        hashes.append(h)
    return names, *map(np.concatenate, (doc, pos, hashes))


def _resolve(parts: int):
    """Reduce side: answers of one bucket, from the hashes that more than one block sent, packed by part of the names."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, doc, pos, hashes = _gathered(pdf["blob"])
        order, sizes, _ = _groups(hashes)
        many = order[sizes > 1]
        rows = []
        if len(many):
            distinct, text, pos = _distinct(names, doc[many], pos[many])
            part = np.array([int.from_bytes(x[:6], "big") % parts for x in distinct])[text]
            for k in np.unique(part):
                own = part == k
                rows.append((int(k), _pack(distinct, text[own], pos[own], np.zeros((int(own.sum()), 0), np.uint64))))
        return pd.DataFrame(rows, columns=["part", "blob"])

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers of all buckets for one part of the names: a row for each text."""
    return pd.DataFrame(list(_answers(*_gathered(pdf["blob"])[:3])), columns=["name", "blob"])


def repeats(texts: DataFrame, extract, block: int, buckets: int) -> DataFrame:
    """(name, at): positions by text whose hashes occur more than once over all rows of texts (name, ...)."""
    kind = "bucket int, name binary, blob binary"
    each = 1 if buckets <= WIDE else -(-buckets // WIDE)
    sent = written(texts.mapInArrow(_count(extract, block, buckets, each), kind), "hashes")
    if each > 1:
        coarse, parts = sent, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = coarse.where("bucket >= 0").select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket")
        fine = dealt.mapInArrow(_recount(block, buckets), kind)
        sent = written(coarse.where("bucket < 0").unionByName(fine), "hashes")
        discard(coarse)
    there = sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_resolve(buckets), "part int, blob binary")
    there = there.groupBy("part").applyInPandas(_merge, "name binary, blob binary")
    found = written(sent.where("bucket < 0").select("name", "blob").unionByName(there), "answers")
    discard(sent)
    by_text = written(found.groupBy("name").agg(F.collect_set("blob").alias("at")), "positions")
    discard(found)
    return by_text


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _positions(blobs: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, "<u4") for b in blobs])) if blobs else np.zeros(0, np.uint32)


def removed_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words are covered by windows at starts."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts.astype(np.int64), 1)
    np.add.at(marks, starts.astype(np.int64) + window, -1)
    return np.cumsum(marks)[:n] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256[, kept_text]."""
    if not 1 <= period <= window:
        raise ValueError("the period must be from 1 to the window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 2 * _NAME)).alias("name"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)
    first = repeats(rows.select("name", "text"), lambda text: anchors(_split(text), window, period), BLOCK_ANCHORS, buckets)
    near = rows.select("name", "text").join(first.hint("merge"), "name").select("name", "text", "at")
    second = repeats(near, lambda text, at: windows_at(_split(text), _positions(at), window, period), BLOCK_WINDOWS, buckets)
    discard(first)

    def finish(batches):
        for batch in batches:
            out = []
            for doc, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _split(text)
                starts = _positions(at)
                gone = removed_words(len(words), starts, window) if len(starts) else None
                kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((doc, len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), *((kept.decode(),) if with_text else ())))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)

    joined = rows.join(second.hint("merge"), "name", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
