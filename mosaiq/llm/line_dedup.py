"""Line deduplication by content-defined chunks of lines; DataFrame functions only.

Lines (split at line feeds) are hashed by 28 bits of their MD5; a rolling polynomial over the hashes of each line and
the one before it marks a line where its remainder modulo CHUNK is 0. A chunk ends at a marked line, but not right after
another marked line, after the text's first line or before its last: so a chunk has two lines at least, unless the text has one.
Boundaries depend on three lines only, so an insertion shifts none that is further away. A chunk of two lines or more,
not all blank, that occurs more than once over all documents stays at its first place (smallest id, then place) and is
removed elsewhere.

Chunks are counted by hash first; only those whose hash repeats are gathered with their text, and are grouped by the text
itself, so equality is of bytes and a hash collision removes nothing. Counts are summed before each shuffle: a
line of every document meets in no task. Joins are by sorting at every size: what repeats grows with the documents.

A document is known by its id and its text's digest: rows equal in both are one document and get the same result.
Null texts are empty; null ids come last, any long being an id. Empty tables give no rows; other columns, whatever their
names, are carried in the struct `row` only. A text's work is in proportion to its length, however many chunks go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.shared import discard, written

CHUNK = 3
BASE, MODULUS = 1_000_003, 2_147_483_647


def _let(value: Column, body) -> Column:
    """body(value), value being computed once: inlined columns would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column, chunk: int = CHUNK) -> Column:
    """array<struct<text, lines>> of a text's chunks, in order."""

    def cut(s: Column) -> Column:
        lines, codes = s["lines"], s["codes"]
        before = lambda i: F.when(i > 0, F.get(codes, i - 1)).otherwise(F.lit(0).cast("long"))
        marked = lambda i: (before(i) * BASE + F.get(codes, i)) % MODULUS % chunk == 0
        last = F.size(lines) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & (i < last - 1) & marked(i) & ((i == 1) | ~marked(i - 1))))

        def texts(e: Column) -> Column:
            start = lambda k: F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0))
            return F.transform(
                e,
                lambda end, k: F.struct(F.array_join(F.slice(lines, start(k) + 1, end - start(k) + 1), "\n").alias("text"), (end - start(k) + 1).alias("lines")),
            )

        return _let(ends, texts)

    codes = lambda lines: F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))
    return _let(F.split(text, "\n", -1), lambda lines: _let(F.struct(lines.alias("lines"), codes(lines).alias("codes")), cut))


def _without(c: Column, gone: Column) -> Column:
    """The elements of c but for those at the ascending places gone: what lies between them."""
    start = lambda j: F.when(j > 0, F.get(gone, j - 1) + 1).otherwise(F.lit(0))
    end = lambda j: F.when(j < F.size(gone), F.get(gone, j)).otherwise(F.size(c))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(c, start(j) + 1, end(j) - start(j))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_chunks, n_removed (lines), kept_text; with keep also `row`, a struct of
    all columns of docs but the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("name"), *others)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.col("name"), F.col("k"))
    parts = rows.select("doc_id", "name", F.posexplode(chunks(F.col("text"), chunk)).alias("k", "c")).where("c.lines > 1")
    parts = parts.where(F.col("c.text").rlike("\\S")).select(place.alias("place"), F.col("c.text").alias("chunk"), F.xxhash64("c.text").alias("h"))
    # a document that stands there twice counts once
    twice = parts.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("h")
    twice = written(twice, "hashes")
    found = written(parts.join(twice.hint("merge"), "h", "left_semi"), "chunks")
    first = written(found.groupBy("h", "chunk").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last"), "first")
    gone = found.join(first.hint("merge"), ["h", "chunk"]).where("place <> first").groupBy("place.id", "place.name").agg(F.array_sort(F.collect_set("place.k")).alias("gone"))
    gone = written(gone.withColumnsRenamed({"id": "gone_id", "name": "gone_name"}), "gone")
    discard(twice)
    discard(found)
    discard(first)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col("name") == F.col("gone_name"))
    joined = rows.join(gone.hint("merge"), match, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    every = _let(chunks(F.col("text"), chunk), lambda c: F.struct(c.alias("all"), _without(c, F.col("gone")).alias("kept")))
    lines = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["lines"])
    report = _let(
        every,
        lambda s: F.struct(
            lines(s["all"]).alias("n_lines"),
            F.size(s["all"]).alias("n_chunks"),
            (lines(s["all"]) - lines(s["kept"])).alias("n_removed"),
            F.array_join(F.transform(s["kept"], lambda x: x["text"]), "\n").alias("kept_text"),
        ),
    )
    out = joined.select("doc_id", report.alias("r"), *["row"] * keep)
    return out.select("doc_id", *(F.col("r." + n).cast("long").alias(n) for n in ("n_lines", "n_chunks", "n_removed")), "r.kept_text", *["row"] * keep)
