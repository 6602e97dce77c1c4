"""Files that land in a folder, as a stream of assets and of hourly counts (an extension).

A file that lands again is indexed again; the later row wins by path.  Counts tolerate
files that are late by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import scan_assets

FILE = "path string, modificationTime timestamp, length long, content binary"


def landed(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_a_trigger).load(folder)


def landed_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Assets of every file that lands."""
    return scan_assets(landed(spark, folder))


def landed_counts(files: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Files and bytes by hour of modification; an hour is final once the watermark has passed it."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
