"""Near-duplicate classes by BagMinHash.

A text is the bag of its five-word shingles (words: see common.BLANKS; a shorter text
is one shingle of all its words). Two texts are linked where the weighted Jaccard
similarity of their bags, sum of minima over sum of maxima, is 0.8 or more; classes are
the connected components of the links.

1. Equal texts are merged in the one shuffle of all texts and written as a table that is
   bucketed by text id, so that later steps join texts without moving them again. The
   table lies in the shared folder and goes when the classes are known.
2. Signatures: each unit of a shingle's weight is a Poisson process that throws points
   in time onto REGISTERS registers; a register keeps its first point. Weight levels
   1, 2, 3-4, 5-8, ... form octaves. A process of an octave's whole rate is drawn once
   and the leading bits of each point's position halve the octave again and again, so
   that a weight inside it takes just the points below it. Points are drawn in order
   of time up to the time by which all registers are expected to be full; where
   one isn't, up to twice that time. Equal registers thus have exactly the probability
   of the weighted Jaccard similarity.
3. Bands of ROWS registers are hashed to buckets. A pair at similarity 0.8 misses all
   BANDS buckets with probability 3e-6, less above it.
4. In each bucket the member with most bucket-mates is the hub. Each text is verified
   against the hub it shares most buckets with. Components of these links are found by
   large-star and small-star steps.
5. The rest: in buckets that still hold several components, the members outside the
   largest one are compared with all members, a block of the ones with a block of the others
   at a time. Members with a partner whose signature agrees on 60 % or more (at similarity
   0.8 all but 1e-14 do) are verified in their cell, which gives links enough to join what
   is linked there, not all pairs.

Defined results: null text, and texts without words, are linked only to equal texts
(null counts as empty); very long texts are read whole, in stretches; repeated rows are
equal texts; one row of each class is kept: that with the smallest id, null ids last, then by
the hashes of text and row, and then any one of rows that are alike; an empty table gives no
rows; columns of any other name pass through.
Texts are told apart by 128 bits. Inside, texts go by a 64-bit id; where two texts have
the same (n*n/2**65 pairs of n texts: 270 of 1e11), only one of them is looked at for
links, and no other text is put into its class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, named, shared_folder, table
from .hashing import Rolling, U, bytes_of, mix

WORDS, REGISTERS, ROWS, BANDS = 5, 256, 6, 42
#: Similarity as a fraction, 4/5.
LEAST = (4, 5)
#: Share of registers below which signatures rule a link out, and members of a block.
SURE, BLOCK = 0.6, 256
#: Bytes that are hashed at a time; points that are drawn at a time.
SEGMENT, POINTS = 1 << 18, 1 << 17
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts laid end to end in `data`."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1]
    last = inside.copy()
    last[:-1] &= blank[1:]
    edge = ends[(ends > 0) & (ends < len(data))]  # words end with their text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(stops, starts[k] + SEGMENT, "right")))
        base = starts[k]
        hashes[k:stop] = Rolling(data[base : stops[stop - 1]], 3).of(starts[k:stop] - base, stops[k:stop] - base)
        k = stop
    return hashes, np.searchsorted(ends, starts, "right")


def bags(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of the texts' bags, sorted."""
    words, owner = word_hashes(data, ends)
    n = np.bincount(owner, minlength=len(ends))
    begin = np.cumsum(n) - n
    many = np.maximum(n - WORDS + 1, (n > 0).astype(np.int64))
    own = np.repeat(np.arange(len(ends)), many)
    at = begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    shingle = np.zeros(len(own), np.uint64)
    for k in range(WORDS):
        here = k < n[own]
        w = words[np.where(here, at + k, 0)] if len(words) else np.zeros(len(own), np.uint64)
        shingle = mix(shingle * U(0x9E3779B97F4A7C15) + np.where(here, w, U(k + 1)))
    order = np.lexsort((shingle, own))
    own, shingle = own[order], shingle[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return own[at], shingle[at], np.diff(np.append(at, len(own)))


def signatures(own: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int = REGISTERS, slack: float = 3.0) -> np.ndarray:
    """BagMinHash: the time of the first point on each register, (texts, m); inf for empty bags."""
    out = np.full(texts * m, np.inf)
    total = np.bincount(own, weights=weight, minlength=texts)
    octaves = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(own)), octaves)
    octave = np.arange(len(of)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    width = np.where(octave == 0, 1, 1 << np.maximum(octave - 1, 0))
    room = weight[of] - np.where(octave == 0, 0, width)  # levels of the octave that the weight has
    seed = mix(shingle[of] + (octave + 1).astype(np.uint64) * U(0xD1B54A32D192ED03))
    doc = own[of]
    end = (m * (np.log(m) + slack) / np.maximum(total, 1))[doc]
    live = np.arange(len(of))
    time, drawn, block = np.zeros(len(of)), 0, 2
    while len(live):
        step = max(1, POINTS // block)
        going = []
        for k in range(0, len(live), step):
            p = live[k : k + step]
            x = mix(seed[p][:, None] + (np.arange(drawn, drawn + block, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
            gaps = -np.log1p(-((x >> U(11)).astype(np.float64) * 2.0**-53)) / width[p][:, None]
            gaps[:, 0] += time[p]
            t = np.cumsum(gaps, axis=1)
            time[p] = t[:, -1]
            y = mix(x + U(0x632BE59BD9B4E019))
            level = ((y >> U(32)) * width[p][:, None].astype(np.uint64)) >> U(32)
            ok = (t < end[p][:, None]) & (level < room[p][:, None].astype(np.uint64))
            slot = doc[p][:, None] * m + (y & U(m - 1)).astype(np.int64)
            np.minimum.at(out, slot[ok], t[ok])
            going.append(p[t[:, -1] < end[p]])
        live, drawn, block = np.concatenate(going), drawn + block, min(2 * block, 1024)
    out = out.reshape(texts, m)
    short = np.flatnonzero(np.isinf(out).any(axis=1) & (total > 0))
    if len(short):
        place = np.full(texts, -1)
        place[short] = np.arange(len(short))
        some = place[own] >= 0
        out[short] = signatures(place[own[some]], shingle[some], weight[some], len(short), m, slack * 2 + np.log(m))
    return out


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some SEGMENT bytes together."""
    k = 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SEGMENT, "right")))
        yield k, stop
        k = stop


def _signed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, ends = bytes_of(column)
    for k, stop in _chunks(ends):
        base = ends[k - 1] if k else 0
        own, shingle, weight = bags(data[base : ends[stop - 1]], ends[k:stop] - base)
        size = np.bincount(own, weights=weight, minlength=stop - k).astype(np.int64)
        yield k, stop, size, signatures(own, shingle, weight, stop - k).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, stop, size, sig in _signed(batch["t"]):
            keep = np.flatnonzero(size > 0)
            keys = np.zeros((len(keep), BANDS), np.uint64)
            for band in range(BANDS):
                key = np.full(len(keep), U(band + 1))
                for r in range(band * ROWS, band * ROWS + ROWS):
                    key = mix(key * U(0x9E3779B97F4A7C15) + sig[keep, r].view(np.uint64))
                keys[:, band] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["h"].take(pa.array(keep + k)), pa.array(size[keep]), lists], ["h", "n", "bands"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each register."""
    for batch in batches:
        for k, stop, _, sig in _signed(batch["t"]):
            small = (mix(sig.view(np.uint64)) & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["h"][k:stop], pa.array([x.tobytes() for x in small], pa.binary())], ["h", "s"])


def overlaps(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of minima and of maxima of the weights, for each pair of texts."""
    sides = [bags(*bytes_of(x)) for x in (left, right)]
    own, shingle, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((shingle, own))
    own, shingle, weight = own[order], shingle[order], weight[order]
    both = np.flatnonzero((own[1:] == own[:-1]) & (shingle[1:] == shingle[:-1]))
    n = len(left)
    least = np.bincount(own[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    return least, np.bincount(own, weights=weight, minlength=n) - least


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = bytes_of(batch["ta"])[1] + bytes_of(batch["tb"])[1]
        for k, stop in _chunks(ends):
            rows = batch.slice(k, stop - k)
            least, most = overlaps(rows["ta"], rows["tb"])
            ok = pa.array((LEAST[1] * least >= LEAST[0] * most) & (most > 0))
            yield pa.RecordBatch.from_arrays([rows["a"].filter(ok), rows["b"].filter(ok)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text ids whose texts (h, t) are linked; few texts are b.

    The ids of the second side are computed, so that it does not count as dealt by them already: both sides of the
    second join are then dealt for it, which lets Spark split a b of many pairs.
    """
    first = texts.select(F.col("h").alias("a"), F.col("t").alias("ta"))
    second = texts.join(pairs.select(F.col("b").alias("h")).distinct(), "h").select(F.col("h").bitwiseXOR(F.lit(0)).alias("b"), F.col("t").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """h and label (the smallest h of its component) for every end of a link."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("h"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("h"), F.col("v").alias("label")).unionByName(roots)


_CELL = ["k", "i", "j"]


def _by_cell(work):
    """`work` on the rows of each cell (k, i, j); rows come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[x].to_numpy() for x in _CELL])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[0][x][0] != part[x][0] for x in _CELL):
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _plausible(rows: pa.Table) -> pa.RecordBatch:
    """The rows of a cell that have a partner from another component with a signature close enough."""
    label, weak = rows["label"].to_numpy(), rows["weak"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["s"].to_pylist()), np.uint8).reshape(len(label), REGISTERS)
    left, right = np.flatnonzero(weak), np.flatnonzero(~weak)
    keep = np.zeros(len(label), bool)
    for x in left:
        ok = ((sketch[right] == sketch[x]).sum(axis=1) >= SURE * REGISTERS) & (label[right] != label[x])
        keep[right[ok]] = True
        keep[x] = ok.any()
    found = rows.select([*_CELL, "h", "label", "weak"]).filter(pa.array(keep)).combine_chunks()
    return found.to_batches()[0] if found.num_rows else pa.RecordBatch.from_pylist([], found.schema)


def _linked(rows: pa.Table) -> pa.RecordBatch:
    """Links in a cell between components, as many as join what is linked there."""
    h, label, weak = (rows[x].to_numpy() for x in ("h", "label", "weak"))
    own, shingle, weight = bags(*bytes_of(rows["t"].combine_chunks()))
    total = np.bincount(own, weights=weight, minlength=len(h))
    begin = np.searchsorted(own, np.arange(len(h) + 1))
    order = np.argsort(shingle, kind="stable")
    postings, of, much = shingle[order], own[order], weight[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    pairs = []
    for x in np.flatnonzero(weak):
        mine = slice(begin[x], begin[x + 1])
        lo, hi = np.searchsorted(postings, shingle[mine], "left"), np.searchsorted(postings, shingle[mine], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        least = np.bincount(of[at], weights=np.minimum(much[at], np.repeat(weight[mine], n)), minlength=len(h))
        most = total + total[x] - least
        for y in np.flatnonzero((LEAST[1] * least >= LEAST[0] * most) & (most > 0) & (label != label[x]) & ~weak):
            a, b = find(int(label[x])), find(int(label[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                pairs.append((min(h[x], h[y]), max(h[x], h[y])))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links between members of a bucket from different components.

    In a bucket, members outside its largest component (weak) are compared with all
    members. Blocks of BLOCK of the ones and of the others meet in cells; what a cell emits is
    bounded by its members.
    """
    labelled = members.join(labels, "h", "left").select("k", "h", F.coalesce("label", "h").alias("label"))
    sizes = labelled.groupBy("k", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("k").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top")).where("top.n < m")
    mixed = mixed.select("k", F.col("top.label").alias("main"), F.ceil(F.col("m") / BLOCK).alias("js"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK).alias("is"))
    open_ = cut(labelled.join(mixed, "k"))
    wanted = texts.join(open_.select("h").distinct(), "h", "left_semi")
    sketches = wanted.select("h", "t").mapInArrow(_sketched, "h long, s binary")
    spot, zero = F.xxhash64("h", "k"), F.lit(0).cast("long")
    strong = open_.select("k", F.explode(F.sequence(zero, F.col("is") - 1)).alias("i"), F.pmod(spot, "js").alias("j"), "h", "label", F.lit(False).alias("weak"))
    weak = open_.where("label <> main").select("k", F.pmod(spot, "is").alias("i"), F.explode(F.sequence(zero, F.col("js") - 1)).alias("j"), "h", "label", F.lit(True).alias("weak"))
    kinds = "k long, i long, j long, h long, label long, weak boolean"

    def cells(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_CELL).sortWithinPartitions(*_CELL)

    close = cells(strong.unionByName(weak).join(sketches, "h").select(*_CELL, "h", "label", "weak", "s")).mapInArrow(_by_cell(_plausible), kinds)
    close = cut(close)
    return cells(close.join(texts.select("h", "t"), "h").select(*_CELL, "h", "label", "weak", "t")).mapInArrow(_by_cell(_linked), "a long, b long").distinct()


@contextmanager
def _database(spark: SparkSession):
    """A database in the shared folder, dropped with its tables at the end."""
    name = f"near_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}/{name}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of so many rows to and from workers while the steps run: long texts, and pairs of them, are in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_labels(texts: DataFrame) -> DataFrame:
    """h, g and label of every text (h, g, t) that is linked to another; labels are ids of texts."""
    spark = texts.sparkSession
    with _database(spark) as base, _small_batches(spark):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        texts.write.bucketBy(buckets, "h").option("compression", "lz4_raw").saveAsTable(f"{base}.texts")
        texts = spark.table(f"{base}.texts")
        texts.mapInArrow(_banded, "h long, n long, bands array<long>").write.saveAsTable(f"{base}.bands")
        banded = spark.table(f"{base}.bands").select("h", "n", F.explode("bands").alias("k"))
        shared = banded.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
        mates = cut(banded.join(shared, "k").groupBy("h").agg(F.first("n").alias("n"), F.sum("m").alias("degree"), F.collect_list("k").alias("ks")))
        members = mates.select("h", "n", "degree", F.explode("ks").alias("k"))
        hubs = members.groupBy("k").agg(F.max(F.struct("degree", "h", "n")).alias("hub"))
        pairs = (
            members.join(hubs, "k")
            .where(f"h <> hub.h and {LEAST[1]} * least(n, hub.n) >= {LEAST[0]} * greatest(n, hub.n)")
            .groupBy("h", F.col("hub.h").alias("to"))
            .agg(F.count("*").alias("times"))
            .groupBy("h")
            .agg(F.max(F.struct("times", "to")).alias("best"))
            .select(F.col("h").alias("a"), F.col("best.to").alias("b"))
        )
        links = cut(verified(cut(pairs), texts))
        labels = components(links)
        labels = components(links.unionByName(_rest(members, labels, texts)))
        return cut(labels.join(texts.select("h", "g"), "h"))


def _ids(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]


def distinct_texts(docs: DataFrame, text: Column) -> DataFrame:
    """One text for each h, that with the smallest g."""
    return docs.select(*_ids(text), text.alias("t")).groupBy("h").agg(F.min("g").alias("g"), F.min_by("t", "g").alias("t"))


def _class(label: Column, h: Column, g: Column) -> Column:
    """What the rows of a class have in common: a label, or the text where it has no link."""
    return F.when(label.isNull(), F.struct(h.alias("h"), g.alias("g"))).otherwise(F.struct(label.alias("h"), F.lit(None).cast("long").alias("g")))


def _order(docs: DataFrame, id_col: str) -> Column:
    """By id, null ids last, then by the hash of the row."""
    hashed = [named(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("tie"))


def near_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with h and g (of the text) and label, a struct that the rows of a class share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = text_labels(distinct_texts(docs, text)).withColumnsRenamed({"h": "h__", "g": "g__", "label": "label__"})
    h, g, label = (free_name(docs, x) for x in ("h", "g", "label"))
    keyed = docs.select(*[named(c) for c in docs.columns if c != text_col], *[x.alias(n) for x, n in zip(_ids(text), (h, g), strict=True)])
    joined = keyed.join(labels, (keyed[h] == labels["h__"]) & (keyed[g] == labels["g__"]), "left")
    return joined.select(*[keyed[c] for c in keyed.columns], _class(labels["label__"], keyed[h], keyed[g]).alias(label))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class, with the columns as given. Texts travel once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = text_labels(distinct_texts(docs, text))
    order = _order(docs, id_col).alias("o")
    firsts = docs.select(*_ids(text), order).groupBy("h", "g").agg(F.min("o").alias("o"))
    classes = firsts.join(labels, ["h", "g"], "left").groupBy(_class(F.col("label"), F.col("h"), F.col("g")).alias("c"))
    best = classes.agg(F.min(F.struct("o.last", "o.id", "h", "g")).alias("best")).select("best.h", "best.g")
    row = F.struct(*[named(c) for c in docs.columns])
    rows = docs.select(*_ids(text), order, row.alias("row")).groupBy("h", "g").agg(F.min_by("row", "o").alias("row"))
    return rows.join(best, ["h", "g"], "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (smallest id of the class; null where all are), class_rows and kept (one row of each class) of every row."""
    found = near_classes(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "t")
    numbered = found.select("i", "h", "g", "label", F.struct(F.col("i").isNull().alias("last"), F.col("i").alias("id"), "h", "g").alias("o"))
    # rows alike in id and text are first counted, and one of them is told from the others by its number
    alike = numbered.groupBy("label", "o").agg(F.count("*").alias("n"))
    # grouped by a struct, heads are dealt anew for the join, which may then split large classes
    heads = alike.groupBy(F.struct("label").alias("x")).agg(F.min("o").alias("first"), F.sum("n").alias("class_rows"))
    heads = heads.select("x.label", "first", "class_rows")
    joined = alike.join(heads, "label").select("o", "n", "first", "class_rows")
    rows = joined.select("o", "first", "class_rows", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return rows.select(F.col("o.id").alias(id_col), F.col("first.id").alias("class_id"), "class_rows", ((F.col("o") == F.col("first")) & (F.col("k") == 1)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_rows, kept (one row of each class)."""
    return near_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, min(rid) AS tid FROM d GROUP BY text),
w AS (SELECT tid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
s AS (SELECT tid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
b AS (SELECT tid, shingle, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT tid, sum(n) AS size FROM b GROUP BY tid),
p AS (SELECT x.tid AS a, y.tid AS b, sum(least(x.n, y.n)) AS least FROM b x JOIN b y ON x.shingle = y.shingle AND x.tid < y.tid GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN z za ON za.tid = p.a JOIN z zb ON zb.tid = p.b WHERE 5 * least >= 4 * (za.size + zb.size - least)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT tid, tid AS other FROM t UNION SELECT r.tid, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT tid, min(other) AS label FROM r GROUP BY tid),
m AS (SELECT d.doc_id, c.label, d.rid FROM d JOIN t USING (text) JOIN c USING (tid))
SELECT doc_id, min(doc_id) OVER (PARTITION BY label) AS class_id, count(*) OVER (PARTITION BY label) AS class_rows,
       row_number() OVER (PARTITION BY label ORDER BY doc_id NULLS LAST, rid) = 1 AS kept FROM m
"""
