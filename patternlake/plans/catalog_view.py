"""The catalog roles over the fixture tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranking import Impacts, write_impacts
from ..operators.search import as_index, write_places, write_postings
from ..operators.substring import Grams, write_grams
from ..sources.store import fingerprint, stored, written


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(spark: SparkSession, sf_dir: str, what: str, make):
    """Made anew when the tables that it is made of have changed."""
    return stored(spark, (sf_dir, what, *[fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]), make)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalog, in the order of ids: scores and hashes are computed when it is made, at its first use, as at an ingest."""
    return _kept(spark, sf_dir, "catalog", lambda: written(made(spark, sf_dir, True), "catalog"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings of the catalog's tokens."""
    return _kept(spark, sf_dir, "tokens", lambda: write_postings(catalog(spark, sf_dir)))


def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of the catalog, as its postings tell it."""
    return as_index(postings(spark, sf_dir))


def grams(spark: SparkSession, sf_dir: str) -> Grams:
    """The stored trigrams of the catalog."""
    return _kept(spark, sf_dir, "grams", lambda: write_grams(catalog(spark, sf_dir)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored order of the catalog's pages."""
    return _kept(spark, sf_dir, "places", lambda: write_places(catalog(spark, sf_dir)))


def impacts(spark: SparkSession, sf_dir: str) -> Impacts:
    """The stored postings of the catalog by falling counts."""
    return _kept(spark, sf_dir, "impacts", lambda: write_impacts(token_index(spark, sf_dir), catalog(spark, sf_dir).count(), postings(spark, sf_dir)))


def made(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """documents and labels in the roles of patterns."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    text = F.col("text")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.join(labels, "doc_id", "left")
    # ranges are sampled from what is below them, so all that costs comes above
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id") if in_order else rows
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("_", "lang", "source").alias("pattern_type"),
        F.col("lang").alias("category"),
        F.substring(text, 1, 60).alias("name"),
        text.alias("description"),
        F.col("source").alias("source_object"),
        F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]')).alias("tags_text"),
        F.lit("").alias("api_version"),
        T.complexity({"fields": F.floor(F.col("n_chars") / 200), "elements": newlines}).alias("complexity_score"),
        T.short_hash(text, 16).alias("content_hash"),
        T.short_hash(F.col("source"), 12).alias("source_hash"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("favorited"),
        F.coalesce("toxic", F.lit(0)).cast("long").alias("use_count"),
        F.array(F.col("source")).alias("seen_in_sources"),
    )


CATALOG_SQL = r"""
cat AS (
  SELECT d.doc_id AS id, concat_ws('_', lang, source) AS pattern_type, lang AS category, substring(text, 1, 60) AS name,
         text AS description, source AS source_object, '["' || lang || '", "' || source || '"]' AS tags_text,
         CASE WHEN sc <= 3 THEN 1 WHEN sc <= 8 THEN 2 WHEN sc <= 18 THEN 3 WHEN sc <= 35 THEN 4 ELSE 5 END AS complexity_score,
         substring(sha256(text), 1, 16) AS content_hash, substring(sha256(source), 1, 12) AS source_hash,
         coalesce(quality, 0) = 1 AS favorited, CAST(coalesce(toxic, 0) AS BIGINT) AS use_count
  FROM (SELECT *, CAST(n_chars // 200 AS DOUBLE) * 0.5::DOUBLE
                  + CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) * 0.3::DOUBLE AS sc FROM documents) d
  LEFT JOIN labels l USING (doc_id))
"""
