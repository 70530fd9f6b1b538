"""Ingest of metadata files as they arrive in a folder.

A UI component is a bundle of files, any of which may come late or change. The stream is keyed
by bundle folder and keeps each bundle's latest files as state; when one of them arrives, the
whole bundle goes on, so that its component is extracted anew from all that is known. Other files
go on as they are.

What a batch finds is appended to a log, under the batch's number, so that a repeated batch
replaces its own part: the patterns first, then the paths that it has seen. A path's patterns are
those of its latest batch (`current`), so a changed file replaces its patterns and one without
any takes them away. `ingested` merges them into a catalog.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import catalog as C
from ..operators.extract import ROW, extract
from ..sources.filetree import SETTLE, watch_tree
from ..sources.metadata import described
from ..sources.store import scratch, written

_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_bundle(path: Column) -> Column:
    """Whether a file is a component's script, page or settings."""
    return path.contains("/lwc/") & path.rlike(r"\.(js|html|js-meta\.xml)$")


class Bundle(StatefulProcessor):
    """Keeps the latest content of each file of a folder; hands on all of them when some arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "content string, modified timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for part in rows:
            for path, content, modified in zip(part["path"], part["content"], part["modified"]):
                # a batch may hold several versions of a file
                if not self.files.containsKey((path,)) or self.files.getValue((path,))[1] <= modified:
                    self.files.updateValue((path,), (content, modified))
        held = [(path[0], value[0]) for path, value in self.files.iterator()]
        yield pd.DataFrame(held, columns=["path", "content"])

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, folder: str, source_name: str, settle: float = SETTLE) -> DataFrame:
    """A stream with the columns of metadata.scan: new and changed files, with those of their bundles."""
    texts = watch_tree(spark, folder, settle).select("path", "content", "modified")
    key = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    bundles = texts.where(in_bundle(F.col("path"))).select(key, "path", "content", "modified")
    whole = bundles.groupBy("folder").transformWithStateInPandas(Bundle(), "path string, content string", "Append", "None")
    return described(texts.where(~in_bundle(F.col("path"))).select("path", "content").unionByName(whole), source_name)


def watch(spark: SparkSession, folder: str, source_name: str, out: str, state: str, labels: dict[str, str] | None = None, settle: float = SETTLE) -> StreamingQuery:
    """Starts a stream that logs the patterns of what is in `folder` and not yet seen, and ends.

    State needs the store that Spark has for it (RocksDB), which is set for this stream alone.
    """

    def store(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            # the batch is read once: state must not be advanced twice
            files = written(batch, "batch")
            own = {"mode": "overwrite", "partitionOverwriteMode": "dynamic"}
            for rows, kind in ((extract(files, labels), "patterns"), (files.select("path").distinct(), "files")):
                rows.withColumn("batch", F.lit(number)).write.options(**own).mode("overwrite").partitionBy("batch").parquet(f"{out}/{kind}")

    before = spark.conf.get(_STATE)
    spark.conf.set(_STATE, _ROCKS)
    try:
        stream = arrivals(spark, folder, source_name, settle).writeStream.foreachBatch(store).option("checkpointLocation", state)
        return stream.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STATE, before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The patterns of every path as its latest batch found them.

    Paths shrink so well when stored that Spark would take all of them for a small table and send it to the driver.
    """
    latest = spark.read.schema("path string, batch int").parquet(f"{out}/files").groupBy("path").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(f"{ROW}, content_hash string, batch int").parquet(f"{out}/patterns")
    return rows.join(latest.hint("merge"), ["path", "batch"], "left_semi").drop("batch")


def compacted(spark: SparkSession, out: str, to: str) -> None:
    """The log as one batch, in a new folder: the latest of all its batches, so that a stream can go on there."""
    files = spark.read.schema("path string, batch int").parquet(f"{out}/files")
    latest = files.groupBy("path").agg(F.max("batch").alias("batch"))
    number = F.lit(latest.agg(F.max("batch")).first()[0])
    for rows, kind in ((current(spark, out), "patterns"), (latest.select("path"), "files")):
        rows.withColumn("batch", number).write.mode("errorifexists").partitionBy("batch").parquet(f"{to}/{kind}")


def ingested(spark: SparkSession, out: str, catalog: DataFrame, source_hash: str, at: Column) -> DataFrame:
    """`catalog` with the source's rows replaced by the current ones; content that other sources have is noted there."""
    rows = current(spark, out).where(F.col("source_hash") == source_hash)
    fresh = rows.select("*", F.lit(0).cast("long").alias("id"), at.alias("created_at"), F.lit(False).alias("favorited"), F.lit(0).cast("long").alias("use_count"), F.array("source_hash").alias("seen_in_sources"))
    return C.ingest(C.evolved(fresh).select(*C.columns()), catalog, source_hash)
