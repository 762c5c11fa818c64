"""Collections of files as rows, and thumbnails back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.text import base64_line
from mosaiq.operators.detect import detect_type
from mosaiq.operators.limits import MAX_INPUT_BYTES


def scan(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, error): files of any file system that Spark reads; content is null above the size limit."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    fits = F.col("length") <= MAX_INPUT_BYTES
    # both branches are filters on the length, which the source applies before it reads a file
    small = reader.load(path).where(fits).withColumn("error", F.lit(None).cast("string"))
    large = reader.load(path).where(~fits).drop("content").withColumn("content", F.lit(None).cast("binary")).withColumn("error", F.lit("Input file too large"))
    return small.unionByName(large)


def with_type(files: DataFrame, strict: bool = False) -> DataFrame:
    """files with the type that their content shows; null where none is found."""
    return files.withColumn("type", detect_type(F.col("content"), strict))


def as_base64(thumbs: DataFrame) -> DataFrame:
    return thumbs.withColumn("png_base64", base64_line(F.col("png")))


def write_pngs(thumbs: DataFrame, path: str, key: str = "path") -> DataFrame:
    """Writes the thumbnails as a Parquet table of PNG bytes with a file name for each; returns what was written.

    One file per thumbnail doesn't scale on object stores; save_files() does that for a folder that all executors share.
    """
    name = F.concat(F.regexp_replace(F.element_at(F.split(F.col(key).cast("string"), "/"), -1), "[^A-Za-z0-9._-]", "_"), F.lit(".png"))
    thumbs.withColumn("file_name", name).write.mode("overwrite").parquet(path)
    return thumbs.sparkSession.read.parquet(path)


def save_files(thumbs: DataFrame, folder: str, key: str = "path") -> int:
    """One PNG file a row, named by the SHA-256 of its key; folder must be mounted by every executor. Returns how many.

    Each file is written under another name and then renamed, so a task that runs again leaves whole files.
    """

    def put(batches):
        import hashlib
        import os

        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            n = 0
            for k, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = os.path.join(folder, hashlib.sha256(str(k).encode()).hexdigest() + ".png")
                part = f"{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(png)
                os.replace(part, name)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return thumbs.where("png is not null").select(key, "png").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
