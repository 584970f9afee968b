"""A folder watched as a stream: each new file becomes element rows once, by the same plans as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import ELEMENTS
from ..sources.documents import elements

FILES = "path string, modificationTime timestamp, length long, content binary"


def parse(spark: SparkSession, folder: str, out: str, state: str, pattern: str = "*", files_at_once: int = 100, once: bool = False) -> StreamingQuery:
    """Write the elements (``schema.ELEMENTS`` and ``arrived``) of office files that arrive in ``folder`` to Parquet in ``out``, a
    damaged one as a row with ``error``. A batch writes a folder of its own, so one that is run again replaces what it
    wrote. ``once``: end when all that is there has been read; else go on."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        elements(batch.select("path", "content")).withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch(spark: SparkSession, out: str) -> DataFrame:
    """What ``parse`` writes, as a stream of rows."""
    return spark.readStream.schema(f"{ELEMENTS}, arrived timestamp, batch int").parquet(out)


def totals(found: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Elements by format and type in windows of arrival; what is later than ``late`` no longer changes a window."""
    return found.withWatermark("arrived", late).groupBy(F.window("arrived", every), "format", "type").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))
