"""Incremental ingestion: files that arrive in a folder, parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.native import route_format

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, format, length, content) of new PDF and OFD files; quire.operators.documents takes it as it takes a table."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("format", route_format(F.col("path"))).where("format is not null").select("path", "format", "length", "content")
