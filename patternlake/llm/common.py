"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: A word is a run of characters other than these blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a lambda variable.

    Inside higher-order functions a plain column expression would be evaluated
    anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The same for several names, which also differ from one another."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], list[tuple]]], columns: str) -> DataFrame:
    """The id, as it is, and for each text (null: empty) the values of `columns`.

    `make` runs once per task and gives a function from texts to rows.
    """
    given = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    names = [c.split()[0] for c in columns.split(", ")]
    kind = given.schema["i"].dataType.simpleString()
    session = docs.sparkSession
    wanted = pa.schema([(f.name, _ARROW.get(f.dataType.simpleString(), pa.int64())) for f in session.createDataFrame([], columns).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            rows = rows_of(batch["t"].to_pylist())
            made = [pa.array([r[k] for r in rows], wanted.field(k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch["i"], *made], ["i", *names])

    return given.mapInArrow(run, f"i {kind}, {columns}").withColumnRenamed("i", id_col)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
