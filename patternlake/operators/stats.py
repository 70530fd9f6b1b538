"""Counts and distinct values of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(catalog: DataFrame, column: str, most: int | None = None) -> DataFrame:
    out = catalog.groupBy(column).agg(F.count("*").alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), column).limit(most)


def overview(catalog: DataFrame, columns: tuple[str, ...] = ("category", "pattern_type", "complexity_score")) -> DataFrame:
    """Counts by each of `columns`, and in all, in one pass: (facet, value, n)."""
    rows = catalog.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns], F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")))).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def filter_values(catalog: DataFrame, columns: tuple[str, ...] = ("category", "pattern_type", "source_object")) -> DataFrame:
    """(facet, value) of the values that occur."""
    return overview(catalog, columns).where("facet <> 'all'").select("facet", "value")


def mode_first(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the first met."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def label(n: Column) -> Column:
    """Generic labels: Brand_A to Brand_Z, then Brand_27 and on."""
    return F.concat(F.lit("Brand_"), F.when(n <= 26, F.char(F.lit(64) + n)).otherwise(n.cast("string")))


def labelled(terms: DataFrame, order: list[Column], partition: list[str]) -> DataFrame:
    """Labels in order, inside each of the (bounded) groups of `partition`."""
    return terms.withColumn("label", label(F.row_number().over(Window.partitionBy(*partition).orderBy(*order))))
