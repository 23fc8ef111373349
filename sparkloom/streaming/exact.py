"""Exact deduplication of a stream: the first row of each key within the watermark passes.

An extension of the batch operator: state is bounded by the watermark, so a copy that comes later than it passes again; ``against`` takes out what a
table of known keys already holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.normalize import dedup_key


def first_seen(stream: DataFrame, text_col: str, time_col: str, delay: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    keyed = stream.withColumn("hash", F.sha2(dedup_key(F.col(text_col)), 256)).withWatermark(time_col, delay)
    if known is not None:
        keyed = keyed.join(known.select("hash").distinct(), "hash", "left_anti")
    return keyed.dropDuplicatesWithinWatermark(["hash"])
