"""Inventory of files by path and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.sources import capture_source as cs


def inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified of all files below ``path``. The content column is not
    selected, so no file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def packed(spark: SparkSession, path: str) -> DataFrame:
    """file, length of all capture files in the packs below ``path``. Read off the tables beside
    the packs, so no pack is opened and no file has to be listed by itself."""
    return cs.runs(spark, path).where("block_seq = 0").select("file", "length")
