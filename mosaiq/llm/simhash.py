"""SimHash near-deduplication with an inverted index of byte positions and count filtering.

Fingerprint: A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are `words` consecutive
words (repeats included; the whole sequence where there are fewer), hashed with XXH64 (seed 42). A bit is set where more
than half of the hashes have it. Without words the fingerprint is zero, and is linked like any other.

The index posts each distinct fingerprint under combinations of its positional bytes. Within a posting list the equal
positional bytes of a pair are tallied; only pairs that reach the guaranteed minimum are verified by their differing bits.

near_groups: two fingerprints that differ in at most MAX_BITS = 4 bits differ in at most 4 of their 8 bytes, so at least 4
positional bytes are equal: that is the guaranteed minimum. The combinations are such that any 4 equal bytes contain
one of them: the 20 triples of a Turan system on 8 positions, or, from MANY distinct fingerprints on, all 70
quadruples, so that lists of unrelated fingerprints stay short. Both find every link.

near_texts (each shingle once): links are texts whose sets of shingles overlap by `similar` (0.8, the bound included) or more. Such
texts differ in many bits of one fingerprint, so each has several `prints` (of remixed hashes). The least number of
positional bytes, equal in at least one print with probability `recall` or more at the bound, is the guaranteed
minimum; pairs that reach it are verified by the bits of two prints, and then by their exact overlap (see overlap.py).

No list gives all its pairs: a list is searched breadth-first, every fingerprint being reached once (lists of up to SHORT
entries are compared together instead), so it gives a spanning forest of its links, which has the same components as all. A list of more than LIST
entries is dealt into blocks of LIST, and each pair of blocks is a unit of work of its own: no list is in one task.

Equal fingerprints (equal texts) are one entry of the index, however many documents have them; repeated rows and ids are fine.
Null texts are empty. A document without an id reaches others and is reached; a component of only such documents has a
null component_id. Empty tables give no rows; columns of docs other than the two named are not read. Whole texts count.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.overlap import SIMILAR, overlap_links
from mosaiq.llm.shared import components, discard, forest, with_nodes, written

WORDS, MAX_BITS, SEED = 4, 4, 42
#: From so many distinct fingerprints on, lists are of four bytes instead of three.
MANY = 50_000_000
#: Entries that a list may have to be one unit of work; and to be compared all with all instead of breadth-first.
LIST, SHORT = 4096, 16
#: near_texts: words to a shingle, least probability of a candidate at the bound, unrelated fingerprints to a list.
SHINGLE, RECALL, UNRELATED = 5, 0.985, 64
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def remixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Independent hashes of hashes; the 0th are the hashes themselves."""
    if not nth:
        return hashes
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int = WORDS, prints: int = 1, distinct: bool = False) -> list[int]:
    """The prints of a text; distinct takes each shingle once."""
    raw = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not raw:
        return [0] * prints
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    n = max(1, len(raw) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(raw) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros((prints, 64), np.int64)
    if distinct:
        hashes = np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], "<u8"))
        n, parts = len(hashes), (hashes[i : i + (1 << 16)] for i in range(0, len(hashes), 1 << 16))
    else:
        cuts = [slice(i, i + (1 << 16)) for i in range(0, n, 1 << 16)]
        parts = (np.array([digest(joined[s:e], SEED) for s, e in zip(starts[c], stops[c], strict=True)], "<u8") for c in cuts)
    for part in parts:
        for k in range(prints):
            total[k] += np.unpackbits(remixed(part, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [sum(1 << int(b) for b in np.flatnonzero(2 * t > n)) for t in total]


def fingerprints(docs: DataFrame, words: int = WORDS, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fps): the fingerprints as signed longs."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, prints) for t in batch.column(1)], np.uint64).view(np.int64).reshape(-1, prints)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, prints, dtype=np.int32)), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "fps"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fps array<bigint>")


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions of which any four positions of eight contain one."""
    if width == 4:
        return list(combinations(range(8), 4))
    found = [g for g in _GROUPS if len(g) == 3]
    for i, g in enumerate(_GROUPS):
        following = _GROUPS[(i + 1) % 3]
        found += [tuple(sorted((*pair, x))) for pair in combinations(g, 2) for x in following]
    return found


def tally(differ: np.ndarray) -> np.ndarray:
    """Equal bytes of two 64-bit fingerprints, from their exclusive or."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count((((differ & low) + low) | differ) & ~low).astype(np.int64)


class Index:
    """How fingerprints are posted (sets of byte positions of each print) and which pairs of a list are links: those with
    `least` equal positional bytes in the list's print, and at most `most` differing bits in the first `carried` prints from it on."""

    def __init__(self, sets: list[tuple[int, ...]], least: int, most: int, carried: int):
        self.sets, self.least, self.most, self.carried = sets, least, most, carried
        self.columns = [f"f{i}" for i in range(carried)]
        self.schema = ", ".join(["key long", "node long", *(f"{c} long" for c in self.columns)])

    def post(self, batches):
        """(node, fps) to postings."""
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            for nth in range(fps.shape[1] if len(node) else 0):
                octets = np.ascontiguousarray(fps[:, nth]).view(np.uint8).reshape(-1, 8).astype(np.int64)
                carried = [pa.array(np.ascontiguousarray(fps[:, (nth + i) % fps.shape[1]])) for i in range(self.carried)]
                for k, at in enumerate(self.sets):
                    key = np.full(len(node), nth * len(self.sets) + k, np.int64)
                    for p in at:
                        key = (key << 8) | octets[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), *carried], names=["key", "node", *self.columns])

    def near(self, differ: list[np.ndarray]) -> np.ndarray:
        """Which pairs are links, from the exclusive ors of their prints; bits are counted where the tally allows it only."""
        out = tally(differ[0]) >= self.least
        at = np.nonzero(out)
        out[at] = sum(np.bitwise_count(d[at]).astype(np.int64) for d in differ) <= self.most
        return out

    def list_links(self, fp: np.ndarray, block: int = 64) -> np.ndarray:
        """Spanning forest, as rows of two indices, of the links among the entries (prints in columns) of one list."""
        fp = np.asarray(fp).reshape(len(fp), -1).view(np.uint64)
        links, left = [], np.arange(len(fp))
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                take, front = np.array(front[:block]), front[block:]
                near = self.near([fp[take, i][:, None] ^ fp[left, i][None, :] for i in range(fp.shape[1])])
                hit = near.any(0)
                if hit.any():
                    links.append(np.stack([take[near[:, hit].argmax(0)], left[hit]], 1))
                    front += left[hit].tolist()
                    left = left[~hit]
        return np.concatenate(links) if links else np.zeros((0, 2), np.int64)

    def _lists(self, rows: np.ndarray):
        """Links of whole lists, rows sorted by key; and the rows of those that are too long, with their blocks."""
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        sizes = np.diff(np.append(starts, len(rows)))
        found, long = [], []
        short = np.repeat(np.where(sizes <= SHORT, sizes, 0), sizes)
        fp = rows[:, 2:].view(np.uint64)
        for d in range(1, min(SHORT, int(sizes.max()))):
            i = np.flatnonzero(short[:-d] > d)
            i = i[rows[i, 0] == rows[i + d, 0]]
            i = i[self.near([fp[i, c] ^ fp[i + d, c] for c in range(self.carried)])]
            found.append(rows[np.stack([i, i + d], 1), 1])
        found = [forest(*np.concatenate(found).T)] if found else []
        for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            if n > LIST:
                long.append((rows[s : s + n], np.arange(n) // LIST))
            else:
                found.append(rows[s : s + n, 1][self.list_links(rows[s : s + n, 2:])])
        return np.concatenate([np.zeros((0, 2), np.int64), *found]), long

    def _batch(self, links: np.ndarray, long: list):
        """Links as (u, v); rows of long lists as (u = node, key, block, prints)."""
        rows = np.concatenate([np.zeros((0, 2 + self.carried), np.int64), *(r for r, _ in long)])
        block = np.concatenate([np.zeros(0, np.int64), *(b for _, b in long)])
        n, m = len(links), len(rows)
        pad = lambda x: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(x), pa.int64())])
        columns = [pa.array(np.concatenate((links.max(1) if n else links[:, 0], rows[:, 1]))), pa.concat_arrays([pa.array(links.min(1) if n else links[:, 0]), pa.nulls(m, pa.int64())])]
        return pa.RecordBatch.from_arrays([*columns, pad(rows[:, 0]), pad(block), *(pad(rows[:, 2 + i]) for i in range(self.carried))], names=["u", "v", "key", "block", *self.columns])

    def link(self, batches):
        """Streams postings sorted by key. What is held is a list's first LIST entries at most."""
        tail, long_key, count = np.zeros((0, 2 + self.carried), np.int64), None, 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if long_key is not None and len(rows):
                more = int(np.searchsorted(rows[:, 0], long_key, "right"))
                if more:
                    yield self._batch(tail[:0, :2], [(rows[:more], (count + np.arange(more)) // LIST)])
                    count, rows = count + more, rows[more:]
            if not len(rows):
                continue
            long_key = None
            rows = np.concatenate((tail, rows)) if len(tail) else rows
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield self._batch(*self._lists(rows[:last]))
            tail = rows[last:]
            if len(tail) > LIST:
                yield self._batch(tail[:0, :2], [(tail, np.arange(len(tail)) // LIST)])
                long_key, count, tail = tail[0, 0], len(tail), tail[:0]
        if len(tail):
            yield self._batch(*self._lists(tail))

    def link_units(self, batches):
        """Streams entries sorted by unit (key, first, second): a block, or two, of a long list."""
        held: list = []
        now = None

        def done():
            rows = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, 3][self.list_links(rows[:, 4:])].T], names=["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1)))).tolist() if len(rows) else []
            for s, e in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                own = tuple(rows[s, :3].tolist())
                if own != now and held:
                    yield done()
                    held = []
                now = own
                held.append(rows[s:e])
        if held:
            yield done()

    def links(self, entries: DataFrame) -> DataFrame:
        """(u, v): links that connect what all links among entries (node, fps) connect."""
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        postings = entries.select("node", "fps").mapInArrow(self.post, self.schema)
        prints = ", ".join(f"{c} long" for c in self.columns)
        found = written(postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(self.link, f"u long, v long, key long, block long, {prints}"), "listed")
        links = found.where("block is null").select("u", "v")
        long = found.where("block is not null").select("key", "block", F.col("u").alias("node"), *self.columns)
        blocks = long.groupBy("key").agg((F.max("block") + 1).alias("n"))
        if blocks.isEmpty():
            return links
        # block b works with itself and every other; a block's rows are met by no more than its list's blocks
        blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        dealt = long.join(blocks.hint("merge"), ["key", "block"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("n = 1 or other <> block")
        unit = ["key", "first", "second"]
        dealt = dealt.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", *self.columns)
        return links.unionByName(dealt.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(self.link_units, "u long, v long"))


def near_groups(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    found = written(fingerprints(docs, words, 1, id_col, text_col), "fp")
    classes, nodes = with_nodes(found.groupBy("fps").agg(F.min("doc_id").alias("least"), F.get("fps", 0).alias("name")), "classes")
    index = Index(position_sets(3 if classes.count() < MANY else 4), 8 - MAX_BITS, MAX_BITS, 1)
    labels = components(index.links(classes))
    roots = classes.join(labels, classes["node"] == labels["u"], "left").select("fps", F.coalesce("v", "node").alias("root"))
    roots = written(roots, "roots")
    discard(classes)
    named = found.join(roots, "fps")
    return named.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", 0)), 16, "0")).alias("fingerprint"), nodes.id(F.col("root")).alias("component_id"))


def share_equal(similar: float, least: int) -> float:
    """Probability that a print of two sets of this overlap has `least` equal bytes of 8 or more."""
    differ = math.acos(min(1.0, 2 * similar / (1 + similar))) / math.pi
    equal = (1 - differ) ** 8
    return sum(math.comb(8, k) * equal**k * (1 - equal) ** (8 - k) for k in range(least, 9))


def plan(n: int, similar: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bytes of a posting, prints, most differing bits of two prints) for n distinct texts."""
    least = next((w for w in (2, 3) if n < UNRELATED << (8 * w)), 4)
    prints = max(2, round(math.log(1 - recall) / math.log(1 - share_equal(similar, least)) + 0.49))
    differ = math.acos(2 * similar / (1 + similar)) / math.pi
    return least, prints, math.ceil(128 * differ + 3 * math.sqrt(128 * differ * (1 - differ)))


def near_texts(docs: DataFrame, words: int = SHINGLE, similar: tuple[int, int] = SIMILAR, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (smallest id reachable by links). Texts are linked where their sets of shingles
    overlap by similar[0] / similar[1] or more; every link is verified by the shingles themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("name"), text.alias("text"))
    share = similar[0] / similar[1]
    # an upper bound of the distinct texts is enough for the plan
    least, prints, most = plan(rows.count(), share, recall)
    index = Index(list(combinations(range(8), least)), least, most, 2)

    def sketch(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, prints, True) for t in batch.column(2)], np.uint64).view(np.int64).reshape(-1, prints)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, prints, dtype=np.int32)), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "name", "fps"])

    found = written(rows.mapInArrow(sketch, "doc_id long, name binary, fps array<bigint>"), "sketches")
    classes, nodes = with_nodes(found.groupBy("name", "fps").agg(F.min("doc_id").alias("least")), "classes")
    near = components(index.links(classes))
    labels = components(overlap_links(rows.withColumn("node", nodes.of(F.col("doc_id"), F.col("name"))), classes.select("name", "node"), near, words, similar))
    roots = written(classes.join(labels, classes["node"] == labels["u"], "left").select("name", F.coalesce("v", "node").alias("root")), "roots")
    discard(classes)
    return found.select("doc_id", "name").join(roots.hint("merge"), "name").select("doc_id", nodes.id(F.col("root")).alias("component_id"))
