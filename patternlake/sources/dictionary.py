"""Company names from lists, as DataFrames with the column name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines and those from # on don't count."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))


def from_ranking(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a column company or name; names of three characters or more, with and without their ending."""
    rows = spark.read.csv(path, header=True)
    column = next(c for c in rows.columns if c.lower() in ("company", "name"))
    names = rows.select(F.trim(F.col(column)).alias("raw")).where(F.length("raw") >= 3)
    return names.select(F.explode(F.array(T.normalized(T.company_core(F.col("raw"))), T.normalized(F.col("raw")))).alias("name")).distinct()


def from_tickers(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of {title, ticker}; tickers of four letters or more count as names too."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.map_values(F.from_json("value", "map<string,struct<title:string,ticker:string>>"))).alias("x")).select("x.*")
    ticker = F.when(F.length("ticker") >= 4, F.lower("ticker"))
    names = F.array_compact(F.array(T.normalized(T.company_core(F.col("title"))), T.normalized(F.col("title")), ticker))
    return rows.select(F.explode(names).alias("name")).where("name <> ''").distinct()


def from_agencies(spark: SparkSession, path: str) -> DataFrame:
    """CSV of organisations and their parts; names of four characters or more, and acronyms."""
    rows = spark.read.csv(path, header=True)
    org, sub = F.trim(F.col("Organization name")), F.trim(F.col("Suborganization name"))
    fine = lambda c: F.when(F.length(c) >= 4, T.normalized(c))
    names = F.array_compact(F.array(fine(org), F.when(F.length(org) >= 4, T.acronym(org)), fine(sub)))
    return rows.select(F.explode(names).alias("name")).where("name <> ''").distinct()


def build(lists: list[DataFrame], generic: list[str]) -> DataFrame:
    """All names, and their distinctive words, without generic ones and those under four characters."""
    names = lists[0]
    for more in lists[1:]:
        names = names.unionByName(more)
    words = names.select(F.explode(T.distinctive_words(F.col("name"), generic)).alias("name"))
    every = names.unionByName(words).distinct().where(F.length("name") >= 4)
    return every.where(~F.col("name").isin(*generic)) if generic else every


def write_names(names: DataFrame, path: str, header: list[str]) -> None:
    """Sorted text, one name a line, after header lines from #; dictionaries are small."""
    top = names.sparkSession.createDataFrame([(k, f"# {line}") for k, line in enumerate(header)], "k int, value string")
    body = names.select(F.lit(len(header)).alias("k"), F.col("name").alias("value"))
    top.unionByName(body).coalesce(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)
