"""Filters, full-text search, paging, ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import numbered, pieces, written
from . import expression, substring
from .substring import SPREAD, like

TEXT_COLUMNS = ("name", "description", "source_object", "pattern_type", "tags_text")


def filters(
    category: str = "", pattern_type: str = "", source_object: str = "", exact_object: str = "", min_complexity: int | None = None, max_complexity: int | None = None, favorited: bool | None = None
) -> Column:
    """All given conditions; empty strings and None don't filter."""
    conditions = [F.lit(True)]
    if category:
        conditions.append(F.col("category") == category)
    if pattern_type:
        conditions.append(F.col("pattern_type") == pattern_type)
    if source_object:
        conditions.append(like(F.col("source_object"), source_object))
    if exact_object:
        conditions.append(F.col("source_object") == exact_object)
    if min_complexity is not None:
        conditions.append(F.col("complexity_score") >= min_complexity)
    if max_complexity is not None:
        conditions.append(F.col("complexity_score") <= max_complexity)
    if favorited is not None:
        conditions.append(F.col("favorited") == favorited)
    return reduce(lambda a, b: a & b, conditions)


def matches(query: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> Column:
    """For catalogs without a token table. Every blank-separated term occurs, as a phrase, in some column; terms
    without letters or digits count only alone."""
    terms = _terms(query)
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (T.has_term(F.coalesce(c, F.lit("")), " ".join(t)) for c in columns)) for t in terms))


def _terms(query: str) -> list[list[str]]:
    return [t for t in map(T._plain_tokens, query.split()) if t]


# The token table --------------------------------------------------------------------


def _token_lists(catalog: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(c).alias("column"), T.tokens(F.coalesce(c, F.lit(""))).alias("tokens")) for c in columns])
    return catalog.select("id", F.explode(parts).alias("x")).select("id", "x.column", "x.tokens")


def token_table(catalog: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(id, column, pos, token): the inverted index as a table."""
    return _token_lists(catalog, columns).select("id", "column", F.posexplode("tokens").alias("pos", "token"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, column, tokens) to (token, column, ids, places): a row for each token in a column of a batch of texts, with the texts' ids and its places in each."""
    for batch in batches:
        lists = batch.column("tokens")
        counts = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        told = lists.flatten().dictionary_encode()
        token = told.indices.to_numpy().astype("int64")
        kinds = batch.column("column").dictionary_encode()
        kind, several = kinds.indices.to_numpy()[row].astype("int64"), max(1, len(kinds.dictionary))
        key = token * several + kind
        order = np.argsort(key, kind="stable")  # rows and places stay in order
        key, row = key[order], row[order]
        text = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        group = np.flatnonzero(np.diff(key[text], prepend=-1))
        places = pa.ListArray.from_arrays(_ends(text, len(order)), pa.array(pos[order].astype("int32")))
        ends = _ends(group, len(text))
        ids, spots = pa.ListArray.from_arrays(ends, batch.column("id").take(pa.array(row[text]))), pa.ListArray.from_arrays(ends, places)
        of = key[text][group]
        yield pa.RecordBatch.from_arrays([told.dictionary.take(pa.array(of // several)), kinds.dictionary.take(pa.array(of % several)), ids, spots], ["token", "column", "ids", "places"])


def _ends(starts: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.append(starts, n).astype("int32"))


def write_postings(catalog: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(token, column, id, places): a row for each token of a text, stored in order of tokens, so that a search reads the
    pages of its tokens in each file. A batch of texts sends each token once. Rows are dealt by hash, a frequent token's to several parts: ranges would be sampled,
    for which all texts would be split twice."""
    kind = catalog.schema["id"].dataType.simpleString()
    rows = _token_lists(catalog, columns).mapInArrow(_placed, f"token string, column string, ids array<{kind}>, places array<array<int>>")
    dealt = rows.repartition(pieces(catalog), "token", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD)))
    dealt = dealt.select("token", "column", F.explode(F.arrays_zip("ids", "places")).alias("x")).select("token", "column", F.col("x.ids").alias("id"), "x.places")
    return written(dealt.sortWithinPartitions("token", "id", "column"), "tokens")


def as_index(postings: DataFrame) -> DataFrame:
    """The token table (id, column, pos, token) of stored postings."""
    return postings.select("id", "column", F.explode("places").alias("pos"), "token")


def write_index(catalog: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """The token table, stored as postings."""
    return as_index(write_postings(catalog, columns))


def occurrences(index: DataFrame, phrases: list[list[str]], columns: tuple[str, ...] | None = None) -> DataFrame:
    """(id, column, term, start) of each place where the tokens of phrase number `term` follow one another."""
    spots = [F.struct(F.lit(t).alias("token"), F.lit(n).alias("term"), F.lit(k).alias("k"), F.lit(len(p)).alias("size")) for n, p in enumerate(phrases) for k, t in enumerate(p)]
    rows = index.where(F.col("token").isin(sorted({t for p in phrases for t in p})))
    rows = rows if columns is None else rows.where(F.col("column").isin(*columns))
    rows = rows.select("id", "column", "pos", F.explode(F.filter(F.array(*spots), lambda s: s["token"] == F.col("token"))).alias("s"))
    rows = rows.select("id", "column", "s.term", "s.size", (F.col("pos") - F.col("s.k")).alias("start"))
    if all(len(p) == 1 for p in phrases):
        return rows.drop("size")
    whole = rows.groupBy("id", "column", "term", "start").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return whole.where("n = size").select("id", "column", "term", "start")


def ids_with_all(index: DataFrame, query: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """id of the rows that have every term of `query` as a phrase in some column."""
    terms = [list(t) for t in dict.fromkeys(map(tuple, _terms(query)))]
    if not terms:
        return index.where("false").select("id")
    if len(terms) == 1:
        return occurrences(index, terms, columns).select("id").distinct()
    found = occurrences(index, terms, columns).groupBy("id").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(terms)).select("id")


def ids_with_prefix(index: DataFrame, start: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """id of the rows with a token that begins like `start` (one token)."""
    (token,) = T._plain_tokens(start) or ("",)
    rows = index.where(F.col("token").startswith(token) & F.lit(token != ""))
    return (rows if columns is None else rows.where(F.col("column").isin(*columns))).select("id").distinct()


def ids_near(index: DataFrame, first: str, second: str, most: int = 10, columns: tuple[str, ...] | None = None) -> DataFrame:
    """id of the rows where two phrases lie in one column with `most` tokens between them at most, in any order."""
    phrases = [T._plain_tokens(first), T._plain_tokens(second)]
    if not all(phrases):
        return index.where("false").select("id")
    # phrase number 1 joins number 0 inside a row's column; a place needs to see just the last of the others before it
    spots = occurrences(index, phrases, columns).withColumn("end", F.col("start") + F.when(F.col("term") == 0, len(phrases[0])).otherwise(len(phrases[1])))
    before = Window.partitionBy("id", "column").orderBy("start", "term").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("term") == 0, F.max(F.when(F.col("term") == 1, F.col("end"))).over(before)).otherwise(F.max(F.when(F.col("term") == 0, F.col("end"))).over(before))
    return spots.withColumn("gap", F.col("start") - other).where(F.col("gap") <= most).select("id").distinct()


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "id", "left_semi")


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "id", "left_anti")


def search(
    catalog: DataFrame,
    query: str,
    index: DataFrame | None = None,
    substring_columns: tuple[str, ...] = substring.TEXT_COLUMNS,
    grams: substring.Grams | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows that have all terms, in `columns` if these are given; where no row of the whole catalog does, or a term is
    malformed (has a quote), rows that have the query as a substring.

    Whether there is a hit is asked at once, of the token table (the catalog's own where none is given); substrings
    are looked up in the trigrams, where these are given.
    """
    index = token_table(catalog) if index is None else index
    hits = index.where("false").select("id") if '"' in query else ids_with_all(index, query, columns)
    return _found(catalog, hits, query, substring_columns, grams)


def search_expression(
    catalog: DataFrame, query: str, index: DataFrame, substring_columns: tuple[str, ...] = substring.TEXT_COLUMNS, grams: substring.Grams | None = None
) -> DataFrame:
    """Rows that a raw expression matches, or where there are none those with its text as a substring; an
    expression that doesn't parse raises."""
    return _found(catalog, expression.ids_matching(index, query), query, substring_columns, grams)


def _found(catalog: DataFrame, hits: DataFrame, query: str, columns: tuple[str, ...], grams: substring.Grams | None) -> DataFrame:
    if not hits.isEmpty():
        return catalog.join(hits, "id", "left_semi")
    return substring.containing(catalog, query, grams, columns)


def ordered(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("complexity_score"), "name", "id")


def page(catalog: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size from 1 to 200")
    return ordered(catalog).offset((number - 1) * size).limit(size)


def write_places(catalog: DataFrame) -> DataFrame:
    """(place, id): the order of pages, stored, so that a page far down is as near as the first."""
    keyed = catalog.select((-F.col("complexity_score")).alias("high"), "name", "id")
    placed = numbered(keyed, ["high", "name", "id"]).select("place", "id")
    return written(placed.repartitionByRange("place").sortWithinPartitions("place"), "places")


def page_at(catalog: DataFrame, places: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """The rows of `page`, of a catalog that `places` was made of: a range of places is read, then the ids there."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size from 1 to 200")
    ids = [r.id for r in places.where(F.col("place").between((number - 1) * size + 1, number * size)).collect()]
    return ordered(catalog.where(substring.id_ranges(ids))) if ids else catalog.where("false")


def page_counts(catalog: DataFrame, size: int = 50) -> DataFrame:
    return catalog.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def semi_search(catalog: DataFrame, index: DataFrame, token: str) -> DataFrame:
    return catalog.join(index.where(F.col("token") == token).select("id").distinct(), "id", "left_semi")


def in_order(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """`ids` (pos, id) joined to the catalog: unknown ids go, the order stays in pos."""
    return ids.join(catalog, "id")


def rank(index: DataFrame, rows: int | DataFrame, query: str, column: str = "description", most: int = 10) -> DataFrame:
    """id, score: rows by summed tf * ln(n / df) of the query's words; `rows` is the catalog or its number of rows."""
    words = list(dict.fromkeys(T._plain_tokens(query)))
    tf = index.where(F.col("token").isin(words) & (F.col("column") == column)).groupBy("id", "token").agg(F.count("*").alias("tf"))
    n = rows if isinstance(rows, int) else rows.count()
    # a row for each word of the query
    weights = tf.groupBy("token").agg(F.log(F.lit(n) / F.count("*")).alias("w"))
    score = tf.join(F.broadcast(weights), "token").groupBy("id").agg(F.round(F.sum(F.col("tf") * F.col("w")), 6).alias("score"))
    return score.orderBy(F.desc("score"), "id").limit(most)


def compose(catalog: DataFrame, requirement: str, target_object: str = "", categories: tuple[str, ...] = (), per_keyword: int = 5, per_category: int = 5) -> DataFrame:
    """Per category, the most complex of the target object's rows and of each keyword's first rows."""
    words = catalog.sparkSession.createDataFrame([(requirement,)], "t string").select(T.keywords(F.col("t"))).first()[0]
    pool = catalog.where(F.col("category").isin(*categories)) if categories else catalog
    texts = ("name", "description", "tags_text")
    low = pool.select("category", "id", "complexity_score", "source_object", *[F.lower(c).alias(c) for c in texts])
    hit = [reduce(lambda a, b: a | b, (F.coalesce(F.col(c).like(f"%{_escaped(w)}%"), F.lit(False)) for c in texts)) for w in words]
    ks = [F.when(h, k) for k, h in enumerate(hit, 1)]
    ks += [F.when(like(F.col("source_object"), target_object), 0)] if target_object else []
    origins = low.select("category", "id", "complexity_score", F.explode(F.array_compact(F.array(*ks, F.lit(None).cast("int")))).alias("origin"))
    first = Window.partitionBy("category", "origin").orderBy("id")
    picked = origins.withColumn("n", F.row_number().over(first)).where((F.col("n") <= per_keyword) | (F.col("origin") == 0))
    seen = picked.groupBy("category", "id").agg(F.min("origin").alias("origin"), F.first("complexity_score").alias("complexity_score"))
    top = Window.partitionBy("category").orderBy(F.desc("complexity_score"), "origin", "id")
    best = seen.withColumn("place", F.row_number().over(top)).where(F.col("place") <= per_category)
    return best.select("id", "origin", "place").join(pool, "id")


def _escaped(part: str) -> str:
    return part.replace("\\", "\\\\")


def compose_client(catalog: DataFrame, requirement: str, target_object: str, per_category: int = 5, by_object: int = 10, index: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The other composition: per category the first matches of the whole requirement (in `columns`, if given), then the object's rows not yet there."""
    own = Window.partitionBy("category").orderBy(F.desc("complexity_score"), "name", "id")
    first = search(catalog, requirement, index, columns=columns).withColumn("place", F.row_number().over(own)).where(F.col("place") <= per_category).select("id", F.lit(0).alias("origin"))
    object_rows = ordered(catalog.where(like(F.col("source_object"), target_object))).limit(by_object).select("id", F.lit(1).alias("origin"))
    return first.unionByName(object_rows).groupBy("id").agg(F.min("origin").alias("origin")).join(catalog, "id")
