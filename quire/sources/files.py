"""Scans of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.native import route_format


def documents(spark: SparkSession, path: str | list[str], largest: int | None = None) -> DataFrame:
    """(path, format, length, content) of PDF and OFD files below path; largest: a limit on bytes, which reaches the scan. Other files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if largest is not None:
        files = files.where(F.col("length") <= largest)
    return files.withColumn("format", route_format(F.col("path"))).where("format is not null").select("path", "format", "length", "content")
