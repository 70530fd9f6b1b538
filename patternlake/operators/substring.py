"""Substring search by trigrams.

The posting table has a row (gram, id) for each row of a catalog and each three characters that
follow one another in its lower-case text columns, sorted by gram and id. A pattern's rarest
trigrams are looked up there, which reads their pages only; rows that have all of them are
candidates, and ILIKE decides over these. Few candidates are fetched by ranges of ids, which
in a catalog stored by id again reads their pages only.

A pattern without three characters in a row between its wildcards has no trigrams: it is answered
by a scan, as are patterns whose candidates are a good part of the catalog.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import pieces, written

TEXT_COLUMNS = ("name", "description", "source_object", "tags_text")
#: Trigrams of a pattern that are looked up at most, and candidates that are fetched by id at most.
LOOKED_UP, FETCHED = 4, 2000
#: Parts that the rows of one trigram go over, by id.
SPREAD = 32


def like(column: Column, part: str) -> Column:
    """Substring without case; % and _ stay wildcards, a backslash is itself."""
    return column.ilike("%" + part.replace("\\", "\\\\") + "%")


def trigrams(text: Column) -> Column:
    """Every three characters in a row of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1))


@dataclass(frozen=True)
class Grams:
    """postings (gram, id) and counts (gram, n), both stored by gram, of some columns of a catalog."""

    postings: DataFrame
    counts: DataFrame
    columns: tuple[str, ...] = TEXT_COLUMNS


def _every(columns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.concat(*[trigrams(F.coalesce(c, F.lit(""))) for c in columns]))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grams) to (gram, ids): a row for each trigram of a batch of texts."""
    for batch in batches:
        lists = batch.column("grams")
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        told = lists.flatten().dictionary_encode()
        gram = told.indices.to_numpy()
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.diff(gram[order], prepend=-1))
        ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype("int32")), batch.column("id").take(pa.array(row[order])))
        yield pa.RecordBatch.from_arrays([told.dictionary.take(pa.array(gram[order][first])), ids], ["gram", "ids"])


def write_grams(catalog: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> Grams:
    """The table stored; a frequent trigram's rows go over several tasks. A batch of texts sends each trigram once, with its ids. Rows are dealt by hash, as ranges would be sampled, for which every text would be cut twice."""
    kind = catalog.schema["id"].dataType.simpleString()
    rows = catalog.select("id", _every(columns).alias("grams")).mapInArrow(_met, f"gram string, ids array<{kind}>")
    dealt = rows.repartition(pieces(catalog), "gram", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD)))
    postings = written(dealt.select("gram", F.explode("ids").alias("id")).sortWithinPartitions("gram", "id"), "grams")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    return Grams(postings, written(counts.repartitionByRange("gram").sortWithinPartitions("gram"), "gramcounts"), columns)


def _grams_of(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams that every match has; lower case is Spark's own, as in the table."""
    low = pattern.lower() if pattern.isascii() else spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    return sorted({piece[k : k + 3] for piece in re.split("[%_]", low) for k in range(len(piece) - 2)})


def candidates(grams: Grams, pattern: str) -> DataFrame | None:
    """id of the rows that have the rarest trigrams of the pattern; None where it has no trigrams."""
    every = _grams_of(grams.postings.sparkSession, pattern)
    if not every:
        return None
    rarest = every
    if len(every) > LOOKED_UP:
        found = {r.gram: r.n for r in grams.counts.where(F.col("gram").isin(every)).collect()}  # a row for each of the pattern's own
        if len(found) < len(every):
            return grams.postings.where("false").select("id")
        rarest = sorted(every, key=lambda g: (found[g], g))[:LOOKED_UP]
    rows = grams.postings.where(F.col("gram").isin(rarest))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("id")


def id_ranges(ids: list[int], most: int = 32) -> Column:
    """Whether `id` is in the list, with the ranges around it that a scan can skip by: split at the widest gaps."""
    ids = sorted(ids)
    cuts = sorted(sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: most - 1])
    parts = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]
    near = " OR ".join(f"id BETWEEN {p[0]} AND {p[-1]}" for p in parts)
    # as text, since a call for each literal would take longer than the search
    return F.expr(f"({near}) AND id IN ({', '.join(map(str, ids))})")


def any_like(pattern: str, columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (like(F.col(c), pattern) for c in columns))


def containing(catalog: DataFrame, pattern: str, grams: Grams | None = None, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """The catalog's rows with the pattern in one of `columns`, which must be of those that `grams` has."""
    verified = any_like(pattern, columns)
    ids = None
    if grams is not None:
        if not set(columns) <= set(grams.columns):
            raise ValueError(f"the trigrams are of {', '.join(grams.columns)}")
        ids = candidates(grams, pattern)
    if ids is None:
        return catalog.where(verified)
    few = [r.id for r in ids.limit(FETCHED + 1).collect()]
    if not few:
        return catalog.where("false")
    if len(few) <= FETCHED:
        return catalog.where(id_ranges(few)).where(verified)
    return catalog.where(verified)
