"""The best rows for some words, without reading their whole lists.

Rows are scored by the sum over words of tf * ln(n / df), with tf over all text columns. The
postings (token, tf, id) are stored by token and falling tf. Of each word's list the head is
read: down to the tf at which it has enough rows. A row that is in no head can score no more than
the words' next lower tfs allow, and one that is in some heads no more than what is known plus this for
the others. When the best `most` known scores are above all that rows outside could reach, the
few rows that could still be among the best are scored exactly, by id in the token table. Until
then heads grow eightfold; at worst they are the whole lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import pieces, written
from .substring import FETCHED, SPREAD, id_ranges

#: Scores are rounded so; bounds leave as much room.
DIGITS = 6
_ROOM = 2 * 10.0**-DIGITS


@dataclass(frozen=True)
class Impacts:
    """postings (token, tf, id) and counts (token, tf, n), both stored, with the token table and the number of rows."""

    postings: DataFrame
    counts: DataFrame
    index: DataFrame
    rows: int


def write_impacts(index: DataFrame, rows: int, stored: DataFrame | None = None) -> Impacts:
    """Made of the token table of a catalog with `rows` rows; `stored` are its postings, which have a row for each token of a text, not for each place."""
    told = index.select("token", "id", F.lit(1).alias("n")) if stored is None else stored.select("token", "id", F.size("places").alias("n"))
    # the grouping holds within the parts that the rows are dealt to, so they are dealt once
    dealt = told.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).repartition(pieces(index), "token", "part")
    dealt = dealt.groupBy("token", "part", "id").agg(F.sum("n").alias("tf")).withColumn("low", -F.col("tf"))
    postings = written(dealt.sortWithinPartitions("token", "low", "id").select("token", "tf", "id"), "impacts")
    counts = postings.groupBy("token", "tf").agg(F.count("*").alias("n"))
    return Impacts(postings, written(counts.repartitionByRange("token").sortWithinPartitions("token"), "impactcounts"), index, rows)


def _head(steps: list[tuple[int, int]], wanted: int) -> tuple[int, int]:
    """Of a word's (tf, rows), tf falling: the least tf of a head of `wanted` rows, and the greatest tf that it leaves out (0: none)."""
    held = 0
    for k, (tf, n) in enumerate(steps):
        held += n
        if held >= wanted:
            return tf, steps[k + 1][0] if k + 1 < len(steps) else 0
    return steps[-1][0], 0


def top(impacts: Impacts, query: str, most: int = 10, head: int | None = None) -> DataFrame:
    """id, score of the best rows; the smaller id first of equal ones."""
    words = list(dict.fromkeys(T._plain_tokens(query)))
    told = impacts.counts.where(F.col("token").isin(words)).collect()  # a row for each tf of a word
    steps = {w: sorted(((r.tf, r.n) for r in told if r.token == w), reverse=True) for w in words}
    steps = {w: s for w, s in steps.items() if s}
    none = impacts.index.sparkSession.createDataFrame([], "id long, score double")
    if not steps:
        return none
    weight = {w: math.log(impacts.rows / sum(n for _, n in s)) for w, s in steps.items()}
    wanted = head or 20 * most
    while True:
        heads = {w: _head(s, wanted) for w, s in steps.items()}
        outside = sum(weight[w] * rest for w, (_, rest) in heads.items())
        read = reduce(lambda a, b: a | b, ((F.col("token") == w) & (F.col("tf") >= cut) for w, (cut, _) in heads.items()))
        value, spare = F.lit(0.0), F.lit(0.0)
        for w, (_, rest) in heads.items():
            value = F.when(F.col("token") == w, F.col("tf") * F.lit(weight[w])).otherwise(value)
            spare = F.when(F.col("token") == w, F.lit(weight[w] * rest)).otherwise(spare)
        seen = impacts.postings.where(read).groupBy("id").agg(F.sum(value).alias("known"), (F.lit(outside) - F.sum(spare)).alias("more"))
        best = [r.known for r in seen.orderBy(F.desc("known")).limit(most).select("known").collect()]
        whole = all(rest == 0 for _, rest in heads.values())
        if whole or (len(best) == most and outside < best[-1] - _ROOM):
            break
        wanted *= 8
    if whole:
        scored = seen.select("id", F.round("known", DIGITS).alias("score"))
    else:
        near = seen.where(F.col("known") + F.col("more") >= best[-1] - _ROOM).select("id")
        rows = impacts.index.where(F.col("token").isin(*steps))
        few = [r.id for r in near.limit(FETCHED + 1).collect()]
        rows = rows.where(id_ranges(few)) if len(few) <= FETCHED else rows.join(near, "id", "left_semi")
        worth = F.lit(0.0)
        for w in steps:
            worth = F.when(F.col("token") == w, F.lit(weight[w])).otherwise(worth)
        tf = rows.groupBy("id", "token").agg(F.count("*").alias("tf"))
        scored = tf.groupBy("id").agg(F.round(F.sum(F.col("tf") * worth), DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(most)
