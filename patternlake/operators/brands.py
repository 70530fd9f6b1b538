"""Detection and scrubbing of brand terms in field names."""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab
from ..functions import terms
from ..functions.terms import scrubbed as scrub  # noqa: F401  (of one project; by source: scrub_by_source)
from ..sources.store import numbered, written
from .stats import label


def _all_common(parts: Column) -> Column:
    names = [*vocab.STANDARD_OBJECTS, *vocab.STANDARD_FIELDS]
    return F.forall(parts, lambda p: F.lower(p).isin(*vocab.COMMON_FIELD_WORDS) | p.isin(*names))


def looks_like_brand(term: Column) -> Column:
    """Inner capitals, capitals before small letters, or letters with digits; not if three or more parts are all common words."""
    camel = term.rlike("[a-z][A-Z]")
    caps = term.rlike("[A-Z]{2,}[a-z]") & (F.length(term) >= 6)
    mixed = term.rlike("[a-zA-Z]") & term.rlike("[0-9]")
    parts = F.regexp_extract_all(term, F.lit("[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]*|[a-z]+"), F.lit(0))
    return (camel | caps | mixed) & ~((camel | caps) & (F.size(parts) >= 3) & _all_common(parts))


def is_ecosystem(term: Column) -> Column:
    long = [p for p in vocab.ECOSYSTEM_PRODUCTS if len(p) >= 4]
    low = F.lower(term)
    return low.isin(*vocab.ECOSYSTEM_PRODUCTS) | F.exists(F.array(*map(F.lit, long)), lambda p: F.contains(low, p))


def _eligible(term: Column, structural: list[str]) -> Column:
    fine = looks_like_brand(term) & ~is_ecosystem(term) & ~term.isin(*vocab.STANDARD_OBJECTS, *vocab.STANDARD_FIELDS)
    return fine & ~F.lower(term).isin(*structural) if structural else fine


def prefix_terms(fields: DataFrame, structural: list[str]) -> DataFrame:
    """Terms in fields (object, field) that look like brands and occur on two objects or more: (term, n_objects)."""
    custom = fields.where(F.col("field").rlike("__[cr]$") & ~F.col("field").rlike(r"^\w+__\w+__[cr]$"))
    parts = F.split(F.replace(F.replace("field", F.lit("__c"), F.lit("")), F.lit("__r"), F.lit("")), "_")
    found = custom.select("object", F.posexplode(parts).alias("pos", "term"))
    found = found.where((F.length("term") >= F.when(F.col("pos") == 0, 4).otherwise(5)) & _eligible(F.col("term"), structural))
    return found.groupBy("term").agg(F.countDistinct("object").alias("n_objects")).where("n_objects >= 2")


def namespace_terms(fields: DataFrame, structural: list[str]) -> DataFrame:
    """Namespaces of managed fields that look like brands."""
    ns = F.regexp_extract("field", r"^(\w+)__(\w+)__[cr]$", 1).alias("term")
    found = fields.select(ns).where(F.col("term") != "").distinct()
    fine = looks_like_brand(F.col("term")) & ~is_ecosystem(F.col("term"))
    return found.where(fine & ~F.lower("term").isin(*structural) if structural else fine)


def company_terms(fields: DataFrame, companies: DataFrame, structural: list[str]) -> DataFrame:
    """One-, two- and three-part stretches of field names that are company names."""
    custom = fields.where(F.col("field").rlike("__[cr]$") & ~F.col("field").rlike(r"^\w+__\w+__[cr]$"))
    parts = custom.select(F.split(F.replace(F.replace("field", F.lit("__c"), F.lit("")), F.lit("__r"), F.lit("")), "_").alias("p"))
    grams = ngrams(parts, "p", "_")
    low = F.replace(F.lower("gram"), F.lit("_"), F.lit(" "))
    fine = (F.length("gram") >= 4) & ~low.isin(*vocab.TOO_COMMON_ALONE) & ~is_ecosystem(F.col("gram"))
    fine = fine & ~F.lower("gram").isin(*structural) if structural else fine
    keyed = grams.where(fine).withColumn("key", low)
    return keyed.join(companies.select(F.col("name").alias("key")).distinct(), "key", "left_semi").select(F.col("gram").alias("term")).distinct()


def ngrams(df: DataFrame, column: str, joint: str, longest: int = 3) -> DataFrame:
    p = F.col(column)

    def stretches(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.when(i + n - 1 <= F.size(p), F.array_join(F.slice(p, i, n), joint)))

    several = [stretches(n) for n in range(1, longest + 1)]
    return df.withColumn("gram", F.explode(F.array_compact(F.flatten(F.array(*several)))))


def brand_terms(fields: DataFrame, companies: DataFrame | None = None, custom: list[str] = (), structural: list[str] = ()) -> DataFrame:
    """(term, label): custom terms, then by objects, namespaces and companies; terms equal but for case count once."""
    spark = fields.sparkSession
    structural = list(structural)
    rows = [(t.strip(), 0, k) for k, t in enumerate(custom) if t.strip()]
    every = spark.createDataFrame(rows, "term string, kind int, place long")
    every = every.unionByName(prefix_terms(fields, structural).select("term", F.lit(1).alias("kind"), (-F.col("n_objects")).alias("place")))
    every = every.unionByName(namespace_terms(fields, structural).select("term", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("place")))
    if companies is not None:
        every = every.unionByName(company_terms(fields, companies, structural).select("term", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("place")))
    first = every.groupBy(F.lower("term").alias("low")).agg(F.min(F.struct("kind", "place", "term")).alias("x")).select("x.*")
    return numbered(first, ["kind", "place", "term"], "n").select("term", label(F.col("n")).alias("label"))


#: Rows that get their terms together, at most, and characters from which a row gets its own.
BATCH_ROWS, LARGE = 1024, 32_768


def scrub_by_source(rows: DataFrame, columns: list[str], labels: DataFrame, source: str = "source_hash", ascii_only: bool = False) -> DataFrame:
    """`rows` with the terms of labels (source, term, label) scrubbed from `columns`, each row by its own source's.

    Rows are written in batches, as far as may be of one source. A batch sends each word once to the terms of its
    source and gets back those that it may have (`terms.key`), so no source's terms come together in one place.
    Rows of sources without terms, and of null sources, stay as they are. Of many terms that share their
    longest word, each batch with that word gets all. `ascii_only`: see `terms.replacer`.
    """
    once = labels.groupBy(F.col(source).alias("s"), terms.lowered(F.col("term"), ascii_only).alias("t")).agg(F.min(F.struct("term", "label"))["label"].alias("l")).where("t <> ''")
    keyed = once.select("s", "t", F.coalesce("l", F.lit(terms.UNKNOWN)).alias("l"), _key("t", F.lit(ascii_only)).alias("k"))
    length = reduce(operator.add, [F.coalesce(F.length(rows[c]), F.lit(0)) for c in columns], F.lit(0))
    spot = F.monotonically_increasing_id()
    kept = written(rows.sortWithinPartitions(rows[source]).select("*", spot.alias("spot_"), (length > LARGE).alias("large_")), "scrub")
    batch = F.when(F.col("large_"), -1 - F.col("spot_")).otherwise(F.expr(f"spot_ div {BATCH_ROWS}")).alias("batch_")
    kept = kept.select(*rows.columns, batch)
    sought = kept.select("batch_", F.col(source).alias("s_"), *[F.col(c).alias(f"text{i}_") for i, c in enumerate(columns)])
    found = sought.where("s_ IS NOT NULL").mapInArrow(partial(_batch_keys, ascii_only=ascii_only), f"batch_ long, s_ {rows.schema[source].dataType.simpleString()}, k_ string")
    own = found.join(keyed, (F.col("s_") == F.col("s")) & (F.col("k_") == F.col("k"))).select("batch_", "s_", "t", "l")

    def scrubbed(batch: pa.Table, own: pa.Table) -> pa.Table:
        replace = terms.replacer(dict(zip(own["t"].to_pylist(), own["l"].to_pylist())), ascii_only) if own.num_rows else None
        out = batch.select(rows_columns)
        for c in columns if replace else []:
            new = [x if x is None else replace(x) for x in out[c].to_pylist()]
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(new, out[c].type))
        return out

    rows_columns = rows.columns
    return kept.groupBy("batch_", source).cogroup(own.groupBy("batch_", "s_")).applyInArrow(scrubbed, rows.schema)


@F.pandas_udf(StringType())
def _key(term: pd.Series, ascii_only: pd.Series) -> pd.Series:
    return pd.Series([*map(terms.key, term, ascii_only)], dtype=object)


def _batch_keys(batches: Iterator[pa.RecordBatch], ascii_only: bool) -> Iterator[pa.RecordBatch]:
    """(batch, source, key) of each stretch of rows that have one batch and source."""
    for rows in batches:
        spot, source = rows["batch_"].to_pylist(), rows["s_"].to_pylist()
        texts = list(zip(*[c.to_pylist() for c in rows.columns[2:]]))
        starts = [i for i in range(len(spot)) if i == 0 or spot[i] != spot[i - 1] or source[i] != source[i - 1]]
        for start, end in zip(starts, [*starts[1:], len(spot)]):
            found = list(terms.keys(itertools.chain.from_iterable(texts[start:end]), ascii_only))
            at = pa.array([start] * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([rows["batch_"].take(at), rows["s_"].take(at), pa.array(found, pa.string())], ["batch_", "s_", "k_"])
