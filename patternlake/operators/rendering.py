"""Catalog rows as text for editors, and the bookkeeping of paid rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def for_editor(file_name: Column, name: Column, category: Column, score: Column, references: Column, description: Column, structure: Column) -> Column:
    """A row as it is inserted into a file: comments in class and markup files, else the bare structure."""
    in_class = F.concat(
        F.lit("// Pattern: "), name, F.lit("\n// Category: "), category, F.lit(" | Complexity: "), score.cast("string"), F.lit("/5\n// Fields: "), F.array_join(references, ", "), F.lit("\n/*\n"), structure, F.lit("\n*/\n")
    )
    in_markup = F.concat(F.lit("<!-- Pattern: "), name, F.lit(" -->\n<!-- "), description, F.lit(" -->\n<!-- Structure:\n"), structure, F.lit("\n-->\n"))
    return F.when(file_name.rlike(r"\.(cls|trigger)$"), in_class).when(file_name.endswith(".xml"), in_markup).otherwise(structure)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Of a ranking, at prices for a million tokens."""
    return tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out


def daily_costs(calls: DataFrame, at: str, spent: str, most: float) -> DataFrame:
    """day, cost and over_cap (the day's calls cost more than `most`)."""
    days = calls.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(spent), 6).alias("cost"))
    return days.withColumn("over_cap", F.col("cost") > most)


def cache_key(query: Column, patterns: Column) -> Column:
    return F.md5(F.concat(query, F.lit(":"), patterns.cast("string")))


def fresh(entries: DataFrame, at: str, hours: int, now: Column) -> DataFrame:
    """Entries of a cache that are not older than `hours`."""
    return entries.where(F.col(at) > now - F.expr(f"interval {int(hours)} hours"))


def cached(entries: DataFrame, at: str, body: str, hours: int, now: Column) -> DataFrame:
    """Fresh entries with their `ids`; an entry whose body isn't JSON, or has no list of ids, is a miss."""
    ids = F.try_variant_get(F.try_parse_json(body), "$.ids", "array<bigint>")
    return fresh(entries, at, hours, now).withColumn("ids", ids).where("ids IS NOT NULL")


def store_call(ledger: DataFrame, day: Column, spent: Column, calls: DataFrame) -> DataFrame:
    """The ledger (day, calls, cost) with further calls added to their days."""
    new = calls.groupBy(day.alias("day")).agg(F.count("*").alias("calls"), F.sum(spent).alias("cost"))
    return ledger.select("day", "calls", "cost").unionByName(new).groupBy("day").agg(F.sum("calls").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def blueprint(rows: DataFrame, requirement: str, target_object: str) -> DataFrame:
    """line and text: a Markdown document of composed rows (category, place, id, name, source_object, complexity_score, description, tags_text)."""
    item = F.concat(F.lit("- **["), "id", F.lit("] "), "name", F.lit("** ("), "source_object", F.lit(", complexity "), "complexity_score", F.lit("/5)\n  "), F.coalesce("description", F.lit("")), F.lit("\n  Tags: "), F.coalesce("tags_text", F.lit("")))
    items = rows.select("category", F.col("place").cast("long").alias("place"), item.alias("text"))
    heads = rows.select("category").distinct().select("category", F.lit(0).cast("long").alias("place"), F.concat(F.lit("### "), "category").alias("text"))
    top = rows.agg(F.concat(F.lit(f"# Solution Blueprint\n## Requirement: {requirement}\n## Target Object: {target_object}\n\nFound "), F.count("*"), F.lit(" relevant patterns:")).alias("text"))
    return top.select(F.lit("").alias("category"), F.lit(-1).cast("long").alias("place"), "text").unionByName(heads).unionByName(items)
