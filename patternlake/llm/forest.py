"""Nearest neighbours by cosine with hash-prefix forests (LSH forest).

A tree gives each vector a string of BITS bits, the sides of BITS random orthogonal
hyperplanes on which it lies, and is kept as a sorted array of these strings. A query
descends in each tree to its longest matching prefix, by binary search; then all trees
ascend together, one bit at a time, until the rows that share a prefix, counted once a
tree, are as many as the rows of the forest (or 8 * `fewest`). Of the rows met, the share
`scored` that most trees met, at least `fewest`, are scored in double precision; the others
are counted only. Counting isn't free: among random vectors two thirds of a forest's rows
are met. With `scored` = 1 every row of a forest is scored without a descent, and
the result is exact.

Rows are dealt by hash into shards with a forest each, and every query of the stated set
is searched in each shard, a batch at a time; the best of a shard are merged. A shard has
SHARD rows at most on average, fewer where the table is small, so that all cores have one.
As both numbers are shares of a shard's rows, recall doesn't fall as tables grow. Of vectors
that are equal only the 1 + k with the smallest ids can be among any k nearest, so others
are set aside before.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without id take no part; a query isn't its own neighbour; ties
go to the smaller id; repeated rows count once; of an id with several vectors the best
pair with any of the query's vectors counts; vectors of different lengths aren't
compared; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TREES, BITS = 128, 32
#: Share of a forest's rows that are scored for a query (1: all, exact), and the fewest.
SCORED, FEWEST = 0.08, 600
#: Rows of a shard: at most, and where it doesn't pay to have more shards.
SHARD, SMALL = 65_536, 8192


def planes(dims: int, seed: int = 11) -> np.ndarray:
    """(dims, TREES * BITS); those of a tree are orthogonal as far as there are dimensions."""
    rng = np.random.default_rng([seed, dims])
    groups = []
    for _ in range(TREES):
        parts, left = [], BITS
        while left > 0:
            parts.append(np.linalg.qr(rng.standard_normal((dims, min(left, dims))))[0])
            left -= dims
        groups += parts
    return np.concatenate(groups, axis=1)


def strings(vectors: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings, first bit highest."""
    out = np.zeros((len(vectors), TREES), np.uint32)
    side = planes(vectors.shape[1])
    for k in range(0, len(vectors), 4096):
        sides = (vectors[k : k + 4096] @ side > 0).reshape(-1, TREES, BITS)
        out[k : k + 4096] = np.packbits(sides, axis=2).view(">u4")[:, :, 0]
    return out


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lengths = np.sqrt((self.vectors**2).sum(axis=1))
        found = strings(self.vectors)
        self.rows = [np.argsort(found[:, t], kind="stable").astype(np.int32) for t in range(TREES)]
        self.sorted = [found[self.rows[t], t] for t in range(TREES)]

    def ranges(self, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query in each tree, the rows that share the first `depth` bits."""
        below = ((np.uint64(1) << (BITS - depth).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        lo = np.stack([np.searchsorted(self.sorted[t], keys[:, t] & ~below, "left") for t in range(TREES)], axis=1)
        hi = np.stack([np.searchsorted(self.sorted[t], keys[:, t] | below, "right") for t in range(TREES)], axis=1)
        return lo, hi

    def candidates(self, keys: np.ndarray, scored: float = SCORED, fewest: int = FEWEST) -> Iterator[np.ndarray]:
        """The rows to score for each query, sorted."""
        most = max(fewest, int(scored * len(self.ids)))
        if most >= len(self.ids):
            for _ in keys:
                yield np.arange(len(self.ids))
            return
        # the common depth to which all trees ascend: the greatest with enough rows
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), BITS)
        while (low < high).any():
            middle = (low + high + 1) // 2
            lo, hi = self.ranges(keys, middle)
            enough = (hi - lo).sum(axis=1) >= max(len(self.ids), 8 * fewest)
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        lo, hi = self.ranges(keys, low)
        for q in range(len(keys)):
            met = np.bincount(np.concatenate([self.rows[t][lo[q, t] : hi[q, t]] for t in range(TREES)]), minlength=len(self.ids))
            rows = np.flatnonzero(met)
            if len(rows) > most:
                rows = np.sort(rows[np.argpartition(-met[rows], most - 1)[:most]])
            yield rows

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, scored: float = SCORED, fewest: int = FEWEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's id, ids, scores) with up to k neighbours each, nearest first."""
        lengths = np.sqrt((vectors**2).sum(axis=1))
        for q, rows in enumerate(self.candidates(strings(vectors), scored, fewest)):
            rows = rows[self.ids[rows] != ids[q]]
            scores = (self.vectors[rows] * vectors[q]).sum(axis=1) / (self.lengths[rows] * lengths[q])
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield ids[q], self.ids[rows[best]], scores[best]


def valid(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["v"].to_numpy()).astype(np.float64)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shards: int | None = None,
    scored: float = SCORED,
    fewest: int = FEWEST,
) -> DataFrame:
    """query_id, rank, the neighbour's id and score, for each row where `is_query` holds.

    A shard scores at least `k` rows, and `scored` of its rows, or `fewest` if these are more.
    """
    if not (0 <= scored <= 1 and k >= 1):
        raise ValueError("scored is a share, and k at least 1")
    fewest = max(fewest, k + 1)
    given = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.where(F.col("i").isNotNull() & valid(F.col("v"))).withColumn("d", F.size("v"))
    rows = given.dropDuplicates(["i", "v"])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("i"))).where(F.col("n") <= k + 1)
    if shards is None:
        n = vectors.count()
        shards = max(1, -(-n // SHARD), min(n // SMALL, vectors.sparkSession.sparkContext.defaultParallelism))
    index = first.select("i", "v", "d", F.lit(False).alias("asks"), F.pmod(F.xxhash64("i"), F.lit(shards)).cast("long").alias("shard"))
    asked = rows.where("asks").select("i", "v", "d", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    both = index.unionByName(asked).repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", "asks")
    kind = given.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, forest = None, [], None
        for batch in batches:
            for key, part in batch.groupby(["d", "shard"], sort=True):
                if key != at:
                    at, held, forest = key, [], None
                if len(new := part[~part["asks"]]):
                    held.append((new["i"].to_numpy(), _stacked(new)))
                if len(asks := part[part["asks"]]) and held:
                    if forest is None:
                        forest = Forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    for q, ids, scores in forest.nearest(asks["i"].to_numpy(), _stacked(asks), k, scored, fewest):
                        yield pd.DataFrame({"query_id": q, "i": ids, "score": scores})

    found = both.select("i", "v", "d", "asks", "shard").mapInPandas(run, f"query_id {kind}, i {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "i"))
    best = found.groupBy("query_id", "i").agg(F.max("score").alias("score"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("i").alias(id_col), "score")


def op8_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
