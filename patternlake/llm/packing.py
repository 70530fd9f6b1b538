"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

No bin holds two pieces from one source or two members of one duplicate cluster. Bins
are ordered by residual capacity and carry bitmaps of their sources and clusters; for
each piece, longest first, the search starts at the tightest residual that fits and
goes on through larger ones until a bin's bitmaps admit the piece, else a bin opens.

Documents are dealt by hash into shards of some SHARD rows, which are packed each on
its own, so that the loss against one big packing is a few open bins a shard. Shards
get lengths and hashes, not texts. Neither a hot source nor a hot cluster makes a
shard larger; it opens more bins. Rows alike in id, source and text are dealt by the
partition they come from as well, so that they don't meet in one shard.

The cluster is that of the column `cluster_col` (such as the classes of near.near_groups)
where one is given. Otherwise, as in the query and the pipeline, whose texts have no near
copies left, it is that of texts equal but for case and blanks.

Defined results: a document longer than the capacity is cut into full pieces, each a
bin of its own, and a rest that is packed; null and empty texts are pieces of length 0
that conflict with nothing; null sources and null clusters don't conflict; rows that tie are alike,
and take their order from (length, hash, id); repeated rows are packed each; an empty table
gives no rows; columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, table
from .quality import n_words

#: Words that a bin holds.
CAPACITY = 2048
#: Rows that are packed together, on average.
SHARD = 5000


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = 0
        self.residual: list[int] = []
        self.clusters: list[int] = []  # bitmaps
        self.some = 0  # bit r: a bin has residual r
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # by residual, then by bitmap of sources
        self.sources: list[int] = []

    def _file(self, b: int) -> None:
        r = self.residual[b]
        self.at[r].setdefault(self.sources[b], []).append(b)
        self.some |= 1 << r

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are single bits, or 0 for none."""
        larger = self.some >> length
        r = length - 1
        while larger:
            step = (larger & -larger).bit_length()
            r += step
            larger >>= step
            for bitmap, bins in self.at[r].items():
                if bitmap & source:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    b = bins[k]
                    if not self.clusters[b] & cluster:
                        del bins[k]
                        if not bins:
                            del self.at[r][bitmap]
                            if not self.at[r]:
                                self.some &= ~(1 << r)
                        self.residual[b] -= length
                        self.sources[b] |= source
                        self.clusters[b] |= cluster
                        self._file(b)
                        return b, self.capacity - r
        return self.open(length, source, cluster), 0

    def open(self, length: int, source: int, cluster: int) -> int:
        self.residual.append(self.capacity - length)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.count += 1
        self._file(self.count - 1)
        return self.count - 1


def pack(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source, cluster), given longest first; None conflicts with nothing."""
    bins, bits = Bins(capacity), ({}, {})
    out = []
    for length, *marks in pieces:
        source, cluster = (0 if x is None else 1 << seen.setdefault(x, len(seen)) for x, seen in zip(marks, bits, strict=True))
        out.append(bins.place(length, source, cluster))
    return out


def cluster_of(text: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, BLANKS, " "))))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: Column | None = None,
    cluster_col: str | None = None,
) -> DataFrame:
    """id, piece, start, length (in words, or the unit of `length`), bin_id and bin_offset of every piece."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = n_words(text) if length is None else length.cast("long")
    cluster = cluster_of(text) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col))
    rows = docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), cluster.alias("c"), size.alias("n"))
    shards = max(1, -(-docs.count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("c", "i", "s", F.spark_partition_id()), F.lit(shards)).cast("long"))
    kind = rows.schema["i"].dataType.simpleString()

    def run(given: pa.Table) -> pa.Table:
        n = given["n"].to_numpy()
        rest, full = n % capacity, n // capacity
        rank = pc.rank(given["i"], null_placement="at_end").to_numpy()
        sources, clusters = given["s"].to_pylist(), given["c"].to_pylist()
        order = np.lexsort((rank, pc.fill_null(given["c"], 0).to_numpy(), -rest))
        lasting = order[(rest[order] > 0) | (n[order] == 0)]
        where = pack([(int(rest[k]), sources[k] if n[k] else None, clusters[k] if n[k] else None) for k in lasting], capacity)
        whole = np.repeat(order, full[order])
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full[order]) - full[order], full[order])
        bins = np.array([b for b, _ in where], np.int64)
        first = bins.max() + 1 if len(bins) else 0
        columns = {
            "i": given["i"].take(pa.array(np.concatenate([lasting, whole]))),
            "piece": np.concatenate([full[lasting], piece]),
            "start": np.concatenate([full[lasting], piece]) * capacity,
            "length": np.concatenate([rest[lasting], np.full(len(whole), capacity)]),
            "bin_id": np.concatenate([bins, first + np.arange(len(whole))]) + (given["shard"][0].as_py() << 32),
            "bin_offset": np.concatenate([np.array([x for _, x in where], np.int64), np.zeros(len(whole), np.int64)]),
        }
        return pa.table(columns)

    packed = dealt.groupBy("shard").applyInArrow(run, f"i {kind}, piece long, start long, length long, bin_id long, bin_offset long")
    return packed.withColumnRenamed("i", id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
