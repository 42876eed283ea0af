"""Record files: typed JSON lines that fail on a malformed row, and source files registered by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Media types by file ending.
MEDIA_TYPES = {"avi": "video/x-msvideo", "flac": "audio/flac", "json": "application/json", "m4a": "audio/mp4", "mkv": "video/x-matroska", "mov": "video/quicktime", "mp3": "audio/mpeg", "mp4": "video/mp4", "txt": "text/plain", "wav": "audio/x-wav"}


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a declared schema; a line that doesn't parse, or has a value of another type, ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds rows; nulls are written, so that every line has every field."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def register(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, media_type) of the files under `path`. Spark reads a file as one value, of 2 GB at most, and leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.try_element_at(kinds, ending), F.lit("application/octet-stream")).alias("media_type"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing or unrecorded, of two registrations."""
    a = recorded.select("path", F.col("sha256").alias("a"))
    b = found.select("path", F.col("sha256").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unrecorded").when(F.col("a") == F.col("b"), "ok").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))
