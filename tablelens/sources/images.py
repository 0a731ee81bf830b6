"""Image folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.text import file_name, image_uri

# File endings taken as images.
IMAGE_ENDINGS = ("png", "jpg", "jpeg")


def image_rows(files: DataFrame, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(name, content) of the files (path, content) with an image ending in any case."""
    wanted = F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$")
    return files.filter(wanted).select(file_name(F.col("path")).alias("name"), "content")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a folder; files with another ending are listed but not read."""
    # The glob is resolved while listing, so the bytes of other files are never loaded.
    glob = "*.{" + ",".join("".join(f"[{ch}{ch.upper()}]" for ch in e) for e in IMAGE_ENDINGS) + "}"
    return image_rows(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))


def image_data_uris(images: DataFrame) -> DataFrame:
    """(name, data_uri) of the png images."""
    return images.filter(F.col("name").endswith(".png")).select("name", image_uri(F.col("content")).alias("data_uri"))
