"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_uri(content: Column, mime: str = "image/png") -> Column:
    """A data URI of the bytes; null stays null. Spark wraps base64 lines, so breaks are removed."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
