"""Listings of folders by file metadata; contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of images.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "gif", "bmp", "svg", "heic", "tiff"]
#: Files longer than this are listed without their text.
INLINE_BYTES = 256 * 1024


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = found.withColumns({"name": name, "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))})
    return out.where(~F.col("name").startswith("."))


def list_images(spark: SparkSession, folder: str, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """(path, name, ext, length, modificationTime) of the images of a folder, not of its trash; a limit takes the first by path."""
    out = _files(spark, folder, recursive).where(F.col("ext").isin(IMAGE_EXTENSIONS) & ~F.col("path").contains("/trash/"))
    out = out.select("path", "name", "ext", "length", "modificationTime")
    return out if limit is None else out.orderBy("path").limit(limit)


def list_inbox(spark: SparkSession, folder: str, guide: str = "README.md") -> DataFrame:
    """(path, name, ext, length) of waiting files, by name; the guide is left out."""
    return _files(spark, folder, False).where(F.lower("name") != guide.lower()).select("path", "name", "ext", "length").orderBy("name")


def read_inbox(spark: SparkSession, folder: str, guide: str = "README.md") -> DataFrame:
    """(name, length, text, is_binary, truncated); files over 256 KB and files that are not UTF-8 have no text."""
    files = _files(spark, folder, False).where(F.lower("name") != guide.lower())
    small = F.col("length") <= INLINE_BYTES
    text = F.when(small & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("name", "length", text.alias("text"), (small & text.isNull()).alias("is_binary"), (~small).alias("truncated"))
