"""Files to thumbnails: decoding, resampling and encoding in one pass over Arrow batches, so pixels never leave the worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.limits import MAX_INPUT_BYTES, input_error, with_defaults

_RESULT = pa.schema([("type", pa.string()), ("source_width", pa.int32()), ("source_height", pa.int32()), ("png", pa.binary()), ("error", pa.string())])
_PIXELS = pa.schema([("type", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
RESULT = "type string, source_width int, source_height int, png binary, error string"

#: Results go back to the JVM once they hold this many bytes, so a task holds little more than one picture beyond them.
GATHER_BYTES = 8 << 20


def _error(e: Exception) -> str:
    return str(e) or type(e).__name__


def _one(content: bytes | None, width, height, fit, kind) -> tuple:
    from mosaiq.codecs.registry import thumbnail

    if content is None:
        return kind, None, None, None, "Input file too large"
    try:
        found, w, h, data = thumbnail(content, width, height, fit, kind)
        return found, w, h, data, None
    except Exception as e:  # a damaged file is a row with an error, not a failed job
        return kind, None, None, None, _error(e)


def _gathered(keys: pa.Array, results: Iterator[tuple], schema: pa.Schema, key: str, payload: int) -> Iterator[pa.RecordBatch]:
    """Results of a batch's rows in order, in record batches cut by the bytes in the field `payload`."""

    def batch(begin: int, held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(column, f.type) for column, f in zip(zip(*held, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays([keys.slice(begin, len(held)), *columns], names=[key, *schema.names])

    held: list[tuple] = []
    size = begin = 0
    for result in results:
        held.append(result)
        size += len(result[payload] or b"")
        if size >= GATHER_BYTES:
            yield batch(begin, held)
            begin, size, held = begin + len(held), 0, []
    if held:
        yield batch(begin, held)


def thumbnails(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """files (key, content[, width, height, fit, type]) to (key, type, source_width, source_height, png, error).

    Options may be columns; nulls take the defaults. A content over the size limit is not sent to Python at all.
    """
    rows = with_defaults(files)
    size = F.length(F.col(content))
    body = F.when(size <= MAX_INPUT_BYTES, F.col(content))
    rows = rows.select(F.col(key).alias(key), body.alias("content"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "fit", "type")

    def run(batches):
        for batch in batches:
            keys, *columns = batch.columns
            results = (_one(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows))
            yield from _gathered(keys, results, _RESULT, key, 3)

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def decoded(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """files to (key, type, width, height, data, error): RGBA bytes in rows, for relational work on pixels."""
    rows = files.select(F.col(key).alias(key), F.when(input_error(F.length(content)).isNull(), F.col(content)).alias("content"), (F.col("type") if "type" in files.columns else F.lit(None).cast("string")).alias("type"))

    def one(body: bytes | None, kind: str | None) -> tuple:
        from mosaiq.codecs.registry import decode

        try:
            if body is None:
                raise ValueError("Input file too large")
            kind, grid = decode(body, kind)
        except Exception as e:
            return kind, None, None, None, _error(e)
        return kind, grid.width, grid.height, grid.rgba.tobytes(), None

    def run(batches):
        for batch in batches:
            keys, *columns = batch.columns
            results = (one(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows))
            yield from _gathered(keys, results, _PIXELS, key, 3)

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, type string, width int, height int, data binary, error string")


def pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, y, x, r, g, b, a) of decoded images, by expressions only: the inverse of packing them."""
    n = F.col("width") * F.col("height")
    at = images.where("data is not null").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    channel = lambda c: F.conv(F.hex(F.substring("data", F.col("i") * 4 + c + 1, F.lit(1))), 16, 10).cast("int")
    return at.select(key, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), *(channel(c).alias(n) for c, n in enumerate("rgba")))
