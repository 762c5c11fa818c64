"""Token ids to compressed binary shards and back.

Each document's ids are one zstandard frame, compressed with a dictionary that all documents share; the dictionary is
trained on serialized id arrays. A shard is one blob:

    b"MQTK" | version u8 | bytes per id u8 | reserved u16 | documents u64 | SHA-256 of the dictionary, 32 bytes
    | ids of each document, u64 each | end of each frame within the payload, u64 each | payload: the frames

so that one short document is read by decompressing its own frame only (read_document). Numbers are little-endian.
Blobs lie in a Parquet table, in ascending id order over (part, seq); any file system that Spark writes will do.

The dictionary's training set is bounded: at most TRAIN_DOCS documents, chosen by the hash of the id over the whole table
whatever their length; of a long one's ids, TRAIN_BYTES from a place that its hash names. It changes sizes only, never ids. Null text is empty and has the end id only. A
null id comes first; rows of equal id are ordered by their ids' checksum. Empty tables give no shards.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.shared import discard, written

MAGIC, VERSION = b"MQTK", 1
HEAD = struct.Struct("<4sBBHQ32s")
TRAIN_DOCS, TRAIN_BYTES, DICT_BYTES = 1000, 16384, 65536
SHARD_DOCS, SHARD_BYTES, PART_DOCS = 4096, 4 << 20, 1_000_000
LEVEL = 3
SHARDS = "part int, seq int, start_in_part long, tokens long, docs array<bigint>, blob binary"
_SPACE, _SEPARATORS = re.compile("[ \t\n\r]+"), re.compile("[\x1c-\x1f]").search


class Encoder(dict):
    """Ids of texts, as bytes. The tokenizer splits at white space before anything else, so pieces between white space
    are encoded once and kept; the maps are emptied when full. A text that may hold a special token goes to the
    library whole, as those are matched across white space and letters."""

    MOST_PIECES, MOST_WORDS = 500_000, 1_000_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.wide = np.dtype("<u2" if self.code == "H" else "<u4")
        self.words: dict[str, bytes] = {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        self.plain = '"ByteLevel"' in self.tokenizer.to_str() and '"Lowercase"' in self.tokenizer.to_str()
        self.tokenize = self.tokenizer.model.tokenize
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special), re.IGNORECASE).search if special else lambda text: None

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.wide).tobytes()

    def _word(self, word: str) -> bytes:
        # one run of letters is unchanged by normalisation but for its case
        ascii, letters = word.isascii(), self.plain and word.isalpha()
        if ascii and letters:
            word = word.lower()
        found = self.words.get(word)
        if found is None:
            if letters and (ascii or max(word) <= "\xff"):
                found = array(self.code, [t.id for t in self.tokenize(word if ascii else word.lower().translate(self.letters))]).tobytes()
            else:
                found = self._ids(word)
            if len(self.words) >= self.MOST_WORDS:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".,;:!?" and "a" <= piece[-2] <= "z":
            ids = self._word(piece[:-1]) + self._word(piece[-1])
        else:
            ids = self._word(piece)
        if len(self) >= self.MOST_PIECES:
            self.clear()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special(text):
            return self._ids(text)
        # Python alone takes the separators 1C-1F for white space
        return b"".join(map(self.__getitem__, _SPACE.split(text) if _SEPARATORS(text) else text.split()))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def _coders(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kind = {"dict_data": held} if held else {}
    return zstandard.ZstdCompressor(level=LEVEL, **kind), zstandard.ZstdDecompressor(**kind)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_shard(ids: list[bytes], frames: list[bytes], wide: int, dictionary_sha256: bytes) -> bytes:
    """One blob of already compressed documents; ids: their serialized lengths matter only."""
    counts = np.array(ids, "<u8")
    ends = np.cumsum([len(f) for f in frames], dtype="<u8") if frames else np.zeros(0, "<u8")
    return b"".join([HEAD.pack(MAGIC, VERSION, wide, 0, len(frames), dictionary_sha256), counts.tobytes(), ends.astype("<u8").tobytes(), *frames])


class Shard:
    """A blob opened for reading; its head and its dictionary's hash are checked once, not for each document."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.wide, _, n, digest = HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        self.counts, ends = np.frombuffer(blob, "<u8", n, at).tolist(), np.frombuffer(blob, "<u8", n, at + 8 * n).tolist()
        self.blob, self.cuts, self.base = blob, [0, *ends], at + 16 * n
        self.decompress = _coders(dictionary)[1].decompress

    def __getitem__(self, i: int) -> np.ndarray:
        """Ids of document i; only its own frame is decompressed."""
        frame = self.blob[self.base + self.cuts[i] : self.base + self.cuts[i + 1]]
        return np.frombuffer(self.decompress(frame, max_output_size=self.counts[i] * self.wide), f"<u{self.wide}")


def read_document(blob: bytes, i: int, dictionary: bytes) -> np.ndarray:
    return Shard(blob, dictionary)[i]


def _encode(path: str, end_id: int, dictionary: bytes):
    def run(batches):
        encoder = _encoder(path)
        tail = np.array([end_id], encoder.wide).tobytes()
        for batch in batches:
            ids = [encoder.encode(t.as_py()) + tail for t in batch.column(1)]
            cols = [batch.column(0), pa.array([len(x) // encoder.wide.itemsize for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            press = _coders(dictionary)[0].compress
            yield pa.RecordBatch.from_arrays([*cols, pa.array([press(x) for x in ids], pa.binary())], names=["doc_id", "n", "check", "frame"])

    return run


def _pack(wide: int, digest: bytes):
    def run(batches):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs, counts, frames, size = [], [], [], 0

        def shard():
            nonlocal seq, start, docs, counts, frames, size
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start_in_part": start, "tokens": sum(counts), "docs": docs, "blob": write_shard(counts, frames, wide, digest)}], schema=_ARROW)
            seq, start = seq + 1, start + sum(counts)
            docs, counts, frames, size = [], [], [], 0
            return row

        for batch in batches:
            for doc, n, frame in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                docs.append(doc)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if len(docs) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard()
        if docs:
            yield shard()

    return run


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("tokens", pa.int64()), ("docs", pa.list_(pa.int64())), ("blob", pa.binary())])


def _samples(path: str):
    """Serialized ids of each text; a long array is cut to TRAIN_BYTES at a place that its checksum names."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                spare = max(0, len(ids) - TRAIN_BYTES) // encoder.wide.itemsize
                start = zlib.crc32(ids) % (spare + 1) * encoder.wide.itemsize
                out.append(ids[start : start + TRAIN_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def shared_dictionary(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, int]:
    """The dictionary, trained on a bounded sample of docs (see the module), and the number of rows of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = rows.count()
    share = min(1.0, 3 * TRAIN_DOCS / max(1, n))
    some = rows.where((order < int(share * (1 << 30))) & (F.length("text") > 0)).orderBy(order, "doc_id", F.xxhash64("text")).limit(TRAIN_DOCS)
    return train_dictionary([bytes(r["ids"]) for r in some.mapInArrow(_samples(path), "ids binary").collect()]), n


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encodes docs with the tokenizer at path; returns the written shards and the one-row table of the dictionary."""
    spark = docs.sparkSession
    dictionary, n = shared_dictionary(docs, path, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frames = written(rows.mapInArrow(_encode(path, end_id, dictionary), "doc_id long, n long, check long, frame binary"), "frames")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_DOCS)
    # rows of one id, or of none, are spread by their checksum
    dealt = frames.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "check").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "check", "frame")
    digest = hashlib.sha256(dictionary).digest()
    shards = written(dealt.mapInArrow(_pack(_encoder(path).wide.itemsize, digest), SHARDS), "shards")
    discard(frames)
    held = written(spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary"), "dictionary")
    return shards, held


def _decode(dictionary: bytes):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n = len(r.docs)
                shard = Shard(r.blob, dictionary)
                ids = [shard[i] for i in range(n)]
                counts = np.array([len(x) for x in ids], np.int64)
                checks = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pd.DataFrame({"doc_id": pd.array(list(r.docs), "Int64"), "start": r.offset + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": checks})

    return run


def read_tokens(shards: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its decompressed ids.

    The driver sees one sum for each part (as many as there are shuffle partitions), not for each shard or document.
    """
    held = bytes(dictionary.first()["dictionary"])
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    ahead, total = [], 0
    for part, n in sums:
        ahead += [F.lit(part), F.lit(total).cast("long")]
        total += n
    offset = F.col("start_in_part") + (F.element_at(F.create_map(*ahead), F.col("part")) if ahead else F.lit(0))
    return shards.select("docs", "blob", offset.alias("offset")).mapInPandas(_decode(held), "doc_id long, start long, n_tokens long, ids_crc32 long")
