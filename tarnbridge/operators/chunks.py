"""Chunks of riders: the structured one and those of the key items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbridge.functions.text import MAX_CHUNK, blank, labelled, packed, phrases, python_bool, rough_tokens, strip

#: The attributes in the structured chunk, in order.
ATTRIBUTES = ("frame_type", "frame_material", "wheel_size", "tyre_width", "electronic_shifting")


def bike_text(row: DataFrame) -> Column:
    value = lambda c: python_bool(F.col(c)) if dict(row.dtypes)[c] == "boolean" else F.col(c).cast("string")
    bits = labelled([(c, value(c)) for c in ATTRIBUTES if c in row.columns], ", ")
    return F.concat(F.lit("Bike: "), strip(F.col("bike")), F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(""))


def rider_chunks(riders: DataFrame, key: str, most: int = MAX_CHUNK) -> DataFrame:
    """key, chunk_kind, chunk_ix, chunk_text, chunk_tokens: a bike chunk at 0, key items from 0 on.

    riders has bike, key_items and any of ATTRIBUTES; a blank bike or key items give no chunk.
    """
    bike = riders.filter(~blank(F.col("bike"))).select(key, F.lit("bike").alias("chunk_kind"), F.lit(0).alias("chunk_ix"), bike_text(riders).alias("chunk_text"))
    items = riders.select(key, F.posexplode(packed(phrases(F.col("key_items")), most)).alias("chunk_ix", "t"))
    items = items.select(key, F.lit("key_items").alias("chunk_kind"), "chunk_ix", F.concat(F.lit("Key items: "), "t").alias("chunk_text"))
    return bike.unionByName(items).withColumn("chunk_tokens", rough_tokens(F.col("chunk_text")))


def without_bullet(line: Column) -> Column:
    return F.regexp_replace(line, r"^[:\-–—•\s]+", "")
