"""The pattern catalog: ingest, provenance, duplicates, mutations.

A catalog is a DataFrame with the columns of SCHEMA. Mutations return the new
catalog; `write_source` stores one by dynamic overwrite of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import numbered
from .extract import hashed

SCHEMA = (
    "id long, pattern_type string, category string, name string, description string, source_object string, structure string, "
    "field_references array<string>, api_version string, complexity_score int, tags array<string>, source_hash string, source_file string, "
    "created_at timestamp, favorited boolean, use_count long, content_hash string, seen_in_sources array<string>"
)
SOURCES = "id long, source_hash string, display_name string, project_path string, ingested_at timestamp, pattern_count int, metadata_counts map<string,int>"
SUMMARY = ("id", "pattern_type", "category", "name", "description", "source_object", "complexity_score", "tags", "favorited", "use_count", "seen_in_sources")


def columns() -> list[str]:
    return [f.split()[0] for f in SCHEMA.split(", ")]


def new_rows(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose content no other source has; repeats inside a source stay."""
    known = catalog.select(F.col("content_hash").alias("known_hash"), F.col("source_hash").alias("known_source")).distinct()
    met = (found["content_hash"] == known["known_hash"]) & (found["source_hash"] != known["known_source"])
    return found.join(known, met, "left_anti")


def seen_again(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog, where rows whose content `found` has from another source list that source too."""
    new = found.select("content_hash", F.col("source_hash").alias("from")).distinct()
    more = (
        catalog.select("content_hash", "source_hash")
        .distinct()
        .join(new, "content_hash")
        .where(F.col("from") != F.col("source_hash"))
        .groupBy("content_hash", "source_hash")
        .agg(F.array_sort(F.collect_set("from")).alias("more"))
    )
    joined = catalog.join(more, ["content_hash", "source_hash"], "left")
    seen = F.array_union("seen_in_sources", F.coalesce("more", F.array().cast("array<string>")))
    return joined.withColumn("seen_in_sources", seen).select(*catalog.columns)


def ingest(found: DataFrame, catalog: DataFrame, source_hash: str) -> DataFrame:
    """Replace a source's rows: its old rows go, known content is noted, new rows get ids after the largest."""
    rest = catalog.where(F.col("source_hash") != source_hash)
    fresh = numbered(new_rows(found, rest).drop("id"), ["source_file", "pattern_type", "name", "content_hash"])
    top = rest.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    given = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place"))
    return seen_again(found, rest).unionByName(given.select(*catalog.columns))


def delete_source(catalog: DataFrame, source_hash: str) -> DataFrame:
    return catalog.where(F.col("source_hash") != source_hash)


def evolved(catalog: DataFrame) -> DataFrame:
    """An older catalog with the columns of SCHEMA that it lacks, empty, and in its order; columns of its own come last."""
    known = {f.name: f.dataType for f in catalog.sparkSession.createDataFrame([], SCHEMA).schema}
    held = {c.lower(): c for c in catalog.columns}
    columns = [F.col(held[n]).cast(kind).alias(n) if n in held else F.lit(None).cast(kind).alias(n) for n, kind in known.items()]
    return catalog.select(*columns, *[c for low, c in held.items() if low not in known])


def upsert_source(sources: DataFrame, source_hash: str, display_name: str, path: str, at: Column, counts: DataFrame) -> DataFrame:
    """`counts` (file_type, n) of the scan; pattern_count is filled from the catalog by `count_patterns`."""
    total = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", F.col("n").cast("int"))))).alias("metadata_counts"))
    row = total.select(
        F.xxhash64(F.lit(source_hash)).alias("id"),
        F.lit(source_hash).alias("source_hash"),
        F.lit(display_name).alias("display_name"),
        F.lit(path).alias("project_path"),
        at.alias("ingested_at"),
        F.lit(0).alias("pattern_count"),
        "metadata_counts",
    )
    return sources.where(F.col("source_hash") != source_hash).unionByName(row)


def with_source(rows: DataFrame, sources: DataFrame, key: str = "source_hash") -> DataFrame:
    """Rows with the columns of their source; rows of unknown sources go."""
    return rows.join(sources, key)


def count_patterns(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    n = catalog.groupBy("source_hash").agg(F.count("*").cast("int").alias("n"))
    return sources.join(n, "source_hash", "left").withColumn("pattern_count", F.coalesce("n", F.lit(0))).select(*sources.columns)


def with_hash(catalog: DataFrame) -> DataFrame:
    """Content hashes for rows without: the same that extraction gives."""
    missing = F.col("content_hash").isNull() | (F.col("content_hash") == "")
    found = F.pandas_udf(hashed, "string")("pattern_type", "source_object", "structure")
    return catalog.withColumn("content_hash", F.when(missing, found).otherwise(F.col("content_hash")))


def duplicate_groups(catalog: DataFrame, key: str = "content_hash") -> DataFrame:
    return catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_duplicates(catalog: DataFrame, key: str = "content_hash", age: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """One row per content: the oldest, with all sources, uses summed and favourites kept. Rows without hash stay.

    Only ids and flags are grouped; whole rows, of which ids tell them apart, are joined to the ones that stay.
    """
    order = F.struct(*[a for a in age if a != "id"], "id")
    own = F.array_append(F.coalesce("seen_in_sources", F.array().cast("array<string>")), F.col("source_hash"))
    grouped = (
        catalog.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(order).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("seen"), F.bool_or("favorited").alias("fav"), F.sum("use_count").alias("uses"))
        .select(F.col("first.id").alias("id"), "seen", "fav", "uses")
    )
    new = {"seen_in_sources": F.col("seen"), "favorited": F.col("fav"), "use_count": F.col("uses")}
    joined = catalog.where(F.col(key).isNotNull()).join(grouped, "id")
    merged = joined.select(*[new.get(c, F.col(c)).alias(c) for c in catalog.columns])
    return merged.unionByName(catalog.where(F.col(key).isNull()))


def toggle_favorite(catalog: DataFrame, pattern_id: int) -> DataFrame:
    return catalog.withColumn("favorited", F.when(F.col("id") == pattern_id, ~F.col("favorited")).otherwise(F.col("favorited")))


def favorite_state(catalog: DataFrame, pattern_id: int) -> DataFrame:
    """id, found and favorited (after the toggle; null where no pattern has the id): one row."""
    state = catalog.where(F.col("id") == pattern_id).agg(F.bool_or(~F.col("favorited")).alias("favorited"))
    return state.select(F.lit(pattern_id).cast("long").alias("id"), F.col("favorited").isNotNull().alias("found"), "favorited")


def tags_of(text: Column) -> Column:
    """Tags that are stored as JSON text; an empty list where it isn't a list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def document(catalog: DataFrame) -> DataFrame:
    """id and document: a row's 18 keys as JSON, with structure and lists as values and the time in ISO form."""
    d = {c: F.col(c) for c in columns()}
    d["structure"] = F.coalesce(F.try_parse_json("structure"), F.parse_json(F.lit("{}")))
    d["created_at"] = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return catalog.select("id", F.to_json(F.struct(*[c.alias(n) for n, c in d.items()]), {"ignoreNullFields": "false"}).alias("document"))


def summary(catalog: DataFrame) -> DataFrame:
    """id and document: the 11 keys of grids and lists."""
    return catalog.select("id", F.to_json(F.struct(*SUMMARY), {"ignoreNullFields": "false"}).alias("document"))


def with_uses(catalog: DataFrame, reads: DataFrame) -> DataFrame:
    """use_count plus the reads (id, one row each) since."""
    n = reads.groupBy("id").agg(F.count("*").alias("n"))
    return catalog.join(n, "id", "left").withColumn("use_count", F.col("use_count") + F.coalesce("n", F.lit(0))).select(*catalog.columns)


def write_source(catalog: DataFrame, path: str) -> None:
    """Overwrite just the sources that `catalog` has."""
    catalog.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_hash").parquet(path)
