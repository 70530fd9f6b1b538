"""Tables that are written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Held = TypeVar("Held")
_held: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; where it names none, the warehouse, or with a local master a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        local = spark.sparkContext.master.startswith("local")
        shared = tempfile.mkdtemp(prefix="patternlake-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end, so what is computed from them must be stored before."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            remove(spark, folder)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """`df`, written to a new folder and read again."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if _scratch:
        _scratch[-1].append(folder)
    writer.parquet(folder)
    kinds = {f.name: f for f in df.schema.fields}
    order = [c for c in df.columns if c not in partition_by] + list(partition_by)
    schema = type(df.schema)([kinds[c] for c in order])
    return spark.read.schema(schema).parquet(folder).select(*df.columns)


def numbered(rows: DataFrame, order: list[str], column: str = "place") -> DataFrame:
    """`rows` with their place in `order`, from 1, without one task that sees them all.

    Ranges of rows are sorted each on its own and written; then each needs just the number of rows in those before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot_", F.monotonically_increasing_id())
    kept = written(ranged, "numbered")
    part, inside = F.shiftright("spot_", 33), F.col("spot_").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each range: a window over these is small
    sizes = kept.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    placed = kept.withColumn("part_", part).join(before, "part_")
    return placed.withColumn(column, F.col("before_") + inside + 1).drop("part_", "before_", "spot_")


def stored(spark: SparkSession, key: tuple, make: Callable[[], Held]) -> Held:
    """The table (or tables) of `key`, made at its first use in the application and then read; see `forget`."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _held:
        _held[whole] = make()
    return _held[whole]


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a file or folder, on whatever file system it is: other ones mean other contents."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = system.getContentSummary(path)
    return size.getLength(), size.getFileCount(), system.getFileStatus(path).getModificationTime()


def pieces(stored_table: DataFrame, mb: int = 8) -> int:
    """How many partitions what is derived from a stored table is dealt to, so that a task sorts it in memory at any size: one for each `mb` stored."""
    spark = stored_table.sparkSession
    held = sum(fingerprint(spark, folder)[0] for folder in {f.rpartition("/")[0] for f in stored_table.inputFiles()})
    return max(spark.sparkContext.defaultParallelism, -(-held // (mb << 20)))


def forget(*key: str) -> None:
    """Let tables whose key starts so be made anew, for when what they were made from has changed."""
    for held in [k for k in _held if k[1 : 1 + len(key)] == key]:
        del _held[held]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is, that no table still to be read needs."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
