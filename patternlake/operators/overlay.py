"""Favourites and uses as events beside the catalog.

A toggle or a read appends one row to an event table (id, toggles, uses); the catalog isn't written.
At a read the events of each id are summed: an odd number of toggles turns a favourite, uses add up.
Sums are events too, so a table is compacted by summing it, at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id long, toggles long, uses long"


def record(spark: SparkSession, folder: str, pattern_id: int, toggles: int = 0, uses: int = 0) -> None:
    """Append one event."""
    append(spark.createDataFrame([(pattern_id, toggles, uses)], EVENTS).coalesce(1), folder)


def append(events: DataFrame, folder: str) -> None:
    events.select("id", "toggles", "uses").write.mode("append").parquet(folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(folder)


def summed(events: DataFrame) -> DataFrame:
    """One event for each id; an even number of toggles is none."""
    return events.groupBy("id").agg((F.sum("toggles") % 2).alias("toggles"), F.sum("uses").alias("uses"))


def compact(spark: SparkSession, folder: str) -> str:
    """A new folder with the sums of the events; who reads goes there next, and the old folder can be removed."""
    new = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    append(summed(events(spark, folder)), new)
    return new


def merged(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """`catalog` as its events leave it; events of unknown ids are ignored."""
    sums = summed(events).select(F.col("id").alias("id_"), F.col("toggles").alias("toggles_"), F.col("uses").alias("uses_"))
    turned = F.coalesce(F.col("toggles_"), F.lit(0)) == 1
    new = {"favorited": F.col("favorited") != turned, "use_count": F.col("use_count") + F.coalesce("uses_", F.lit(0))}
    joined = catalog.join(sums, F.col("id") == F.col("id_"), "left")
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in catalog.columns])
