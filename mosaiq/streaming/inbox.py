"""A folder that files arrive in, as a stream of thumbnails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mosaiq.operators.thumbnails import thumbnails

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """New files of folder as a stream; each file is read once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)


def stream_thumbnails(spark: SparkSession, folder: str, to: str, checkpoint: str, width: int = 256, height: int = 256, fit: str = "cover", once: bool = False) -> StreamingQuery:
    """Appends thumbnails of arriving files to a Parquet table; with `once` what is there now, and then it stops.

    Files are stateless rows, so there is no watermark; the checkpoint remembers which were read, and the sink commits whole batches.
    """
    from pyspark.sql import functions as F

    files = watch(spark, folder).withColumns({"width": F.lit(width), "height": F.lit(height), "fit": F.lit(fit)})
    out = thumbnails(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start(to)
