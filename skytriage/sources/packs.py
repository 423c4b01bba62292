"""Small documents, many to a file.

A folder with one file per document costs a listing, an open and a commit for each, most of
it in the driver and whatever the documents hold. A pack is a folder of JSON lines, each with
the name a document goes by (``path``), its length in bytes and its text; the number of files
follows the bytes. A line is read alone, so a large document weighs on nobody but itself.
Formats made of lines are packed line by line. Readers take a pack wherever they take files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Last part of the name of a folder that is a pack.
SUFFIX = ".packed"

_SHAPE = "path string, length bigint, value string"


def is_packed(path: str) -> bool:
    return path.rstrip("/").endswith(SUFFIX)


def write_packed(documents: DataFrame, path: str) -> None:
    """``documents`` has ``path, value``."""
    if not is_packed(path):
        raise ValueError(f"a pack is named *{SUFFIX}; got {path!r}")
    documents.select("path", F.octet_length("value").cast("bigint").alias("length"), F.coalesce("value", F.lit("")).alias("value")).write.mode("errorifexists").json(path)


def packed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``path, length, value`` of a pack; a line that is none of its documents stops the job."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(_SHAPE).option("mode", "FAILFAST").json(path)


def documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``path, value``: the documents of a pack, or files read whole."""
    if is_packed(path):
        return packed(spark, path, stream).select("path", "value")
    reader = spark.readStream if stream else spark.read
    return reader.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
