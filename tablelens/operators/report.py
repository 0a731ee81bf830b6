"""The report as a table: overview, image insights with their images, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Section titles in order, and the text for an absent image.
SECTION_TITLES = {"overview": "EDA Overview", "image": "Image Insights", "summary": "Summary Insights"}
NO_IMAGE = "Image not available"


def attach_images(insights: DataFrame, images: DataFrame) -> DataFrame:
    """Add `image` by file name; an insight without its image keeps its row and gets a fixed text.

    Rows of other sections get no image. Images are whole files, so the join is left to the
    optimizer: it broadcasts the image side only below its size limit, else both sides are shuffled
    on the name. Rows without a name get a join key of their own, so that they spread evenly
    instead of meeting in one task.
    """
    is_image = (F.col("section") == "image") & F.col("key").isNotNull()
    own_key = F.concat(F.lit("\u0000"), F.xxhash64("response_id", "section", "item").cast("string"))
    keyed = insights.withColumn("_key", F.when(is_image, F.col("key")).otherwise(own_key))
    named = images.select(F.col("name").alias("_key"), F.col("data_uri").alias("_uri"))
    image = F.when(F.col("section") == "image", F.coalesce("_uri", F.lit(NO_IMAGE)))
    return keyed.join(named, "_key", "left").select(*insights.columns, image.alias("image"))


def report_table(insights: DataFrame, images: DataFrame) -> DataFrame:
    """(response_id, section_no, section, item, key, text, image) with sections in report order."""
    order = F.array(*[F.lit(s) for s in SECTION_TITLES])
    titles = F.create_map(*[F.lit(v) for pair in SECTION_TITLES.items() for v in pair])
    return attach_images(insights, images).select(
        "response_id",
        F.array_position(order, F.col("section")).cast("int").alias("section_no"),
        titles[F.col("section")].alias("section"),
        "item",
        "key",
        "text",
        "image",
    )
