"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

Every window of `length` bytes that also starts elsewhere in the corpus marks its
bytes; marked bytes are removed. Matches never cross documents, and windows are
judged on the input. The steps are:

1. Equal texts are merged (with their number) in the one shuffle of texts; later steps
   refer to a text by two 64-bit hashes and reuse that exchange.
2. Each window is filed under its least-hashed q-gram, a choice that depends on the
   window's content alone. Consecutive windows with one such q-gram form a run, some
   85 bytes on average. The q-grams are the initial buckets; buckets with one
   occurrence are dropped.
3. Runs of a bucket with the same whole content are one class. A class met twice is
   repeated throughout.
4. Buckets with several classes go on with one run of each class. Its windows are
   refined in blocks of whole buckets: the bucket of eight bytes is refined by the
   bucket pointers eight bytes later, and the new pointers are used again for the next,
   twice as deep step, until `length` bytes are told apart. A window whose last
   bucket has company is repeated.
   In a bucket of more than HOT classes, which no one task should hold, the pointer of
   the full depth is computed at once, as a 128-bit hash of the window, and the windows
   are dealt and counted by it.
5. Spans are joined to the texts.

Keys of joins that a common q-gram, run or window can make hot come from groups by a
struct, so that both sides are dealt for the join alone and Spark may split such a key.

The result is exact but for equal hashes of different things: texts and the windows of
large buckets are told apart by 128 bits, the runs of one bucket by 64 (some 5e-7 expected
errors for 1e12 runs in buckets of ten).

Defined results: null text is the empty text; texts of any length are read whole, in
stretches; an empty table gives no rows; repeated rows are copies of each other, so texts
of `length` bytes or more that occur twice vanish wholly; texts shorter than `length` bytes
stay; columns of any other name pass through. `length` is LONGEST at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, named, table
from .hashing import U as _U
from .hashing import Rolling, bytes_of, mix

LENGTH, Q = 200, 32
#: Where a run ends and where its q-gram lies are kept in 12 bits each.
LONGEST = 4095
#: Classes of a bucket that one task refines together; hashes tell the windows of larger ones apart.
HOT = 2000
#: Window starts that are hashed at a time; bytes that are refined at a time.
SEGMENT, BLOCK = 1 << 18, 1 << 19

def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    m = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def runs(data: np.ndarray, ends: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first and last window start, q-gram start, q-gram hash, content hash) of the runs.

    `data` holds the texts one after another, `ends` their ends. Work goes by stretches
    of SEGMENT bytes; a run that a stretch cuts becomes two, which step 4 resolves.
    """
    starts = np.concatenate(([0], ends[:-1]))
    for s in range(0, len(data), SEGMENT):
        part = data[s : s + SEGMENT + length - 1]
        if len(part) < length:
            break
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, s + SEGMENT, "left")
        first = np.maximum(starts[a:b], s) - s
        stop = np.minimum(ends[a:b] - length + 1, s + SEGMENT) - s
        some = stop > first
        if not some.any():
            continue
        first, stop, number = first[some], stop[some], np.arange(a, b)[some]
        rolling = Rolling(part, 1)
        grams = rolling.every(q)
        tagged = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_sliding_least(tagged, length - q + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        n = stop - first
        window = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner = np.repeat(number, n)
        gram = chosen[window]
        new = np.ones(len(window), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        lo_at = np.flatnonzero(new)
        hi_at = np.concatenate((lo_at[1:], [len(window)])) - 1
        lo, hi, at, own = window[lo_at], window[hi_at], gram[lo_at], owner[lo_at]
        content = mix(rolling.of(lo, hi + length) + (at - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        shift = s - starts[own]
        yield own, lo + shift, hi + shift, at + shift, mix(grams[at] + _U(1)), content


def _runs_of_texts(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch["t"])
            h, g, c = (batch[x].to_numpy(zero_copy_only=False) for x in ("h", "g", "c"))
            for own, lo, hi, at, key, content in runs(data, ends, length, q):
                rest = np.stack([content.view(np.int64), h[own], g[own], lo << 24 | (hi - lo) << 12 | (at - lo), c[own]], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, len(_REST), dtype=np.int32)), pa.array(rest.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lists], ["k", "v"])

    return run


def _contents(length: int):
    """One row per asked-for run, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch["t"])
            starts = np.concatenate(([0], ends[:-1]))
            asked = batch["asked"]
            n = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            at = flat.field("at").to_numpy()
            owner = np.repeat(np.arange(len(starts)), n)
            lo = starts[owner] + (at >> 24)
            hi = lo + (at >> 12 & 0xFFF) + length
            whole = data.tobytes()
            step = 20_000
            for k in range(0, len(at), step):
                part = slice(k, k + step)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("k")[part],
                        flat.field("n")[part],
                        batch["h"].take(pa.array(owner[part])),
                        batch["g"].take(pa.array(owner[part])),
                        pa.array(at[part]),
                        pa.array([whole[a:b] for a, b in zip(lo[part], hi[part], strict=True)], pa.binary()),
                    ],
                    ["k", "n", "h", "g", "at", "b"],
                )

    return run


def repeated(data: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at each of `windows` also start at another of them.

    pointer[p] is the bucket of the first `depth` bytes at p.
    """
    answer = np.zeros(len(windows), bool)
    depth = min(8, length)
    size = len(data) - depth + 1
    if size <= 0 or len(windows) < 2:
        return answer
    value = np.zeros(size, np.uint64)
    for k in range(depth):
        value = value << _U(8) | data[k : k + size].astype(np.uint64)
    pointer = np.unique(value, return_inverse=True)[1]
    alive = np.arange(len(windows))
    while True:
        bucket = pointer[windows[alive]]
        alive = alive[np.bincount(bucket)[bucket] > 1]  # a bucket of one can't become larger
        if depth == length or not len(alive):
            answer[alive] = depth == length
            return answer
        step = min(depth, length - depth)
        size = len(pointer) - step
        # positions whose pointer no window that is left will ask for keep bucket 0
        need = np.zeros(len(pointer) + length + 1, np.int32)
        np.add.at(need, windows[alive], 1)
        np.add.at(need, windows[alive] + length - depth - step + 1, -1)
        asked = np.flatnonzero(np.cumsum(need)[:size] > 0)
        pair = pointer[asked].astype(np.uint64) * _U(len(data)) + pointer[asked + step].astype(np.uint64)
        refined = np.zeros(size, np.int64)
        refined[asked] = np.unique(pair, return_inverse=True)[1]
        pointer, depth = refined, depth + step


def _spans(windows: np.ndarray, hit: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Owner, start and end of the stretches of consecutive windows that are hit."""
    w, o = windows[hit], owner[hit]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(w)])) - 1 if len(first) else first
    return o[first], w[first], w[last] + length


_SPAN = "h long, g long, a long, b long"
#: A run: its q-gram, and an array of its content, text, place and number. What is in one array travels as one, and
#: what can't be null needs no filter, so that each reader of the runs can reuse their exchange.
_RUN, _REST = "k long NOT NULL, v array<long> NOT NULL", ("r", "h", "g", "at", "c")


def _part(name: str) -> Column:
    return F.coalesce(F.get("v", F.lit(_REST.index(name))), F.lit(0).cast("long")).alias(name)


def _in_use(df: DataFrame) -> DataFrame:
    """`df`, whose columns are all looked at (for what is always so), so that each reader of it can reuse one exchange."""
    return df.where((F.xxhash64(*df.columns) != 0) | F.col("n").isNotNull())


def _refine(length: int):
    """Spans of the windows that are repeated; rows come sorted by bucket."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        data, ends = bytes_of(rows["b"].combine_chunks())
        starts = np.concatenate(([0], ends[:-1]))
        n = ends - starts - length + 1
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        hit = repeated(data, starts[owner] + inside, length)
        hit &= rows["n"].to_numpy()[owner] == 1  # the other classes are repeated throughout
        own, a, b = _spans(inside, hit, owner, length)
        lo = rows["at"].to_numpy()[own] >> 24
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["h"].to_numpy()[own]), pa.array(rows["g"].to_numpy()[own]), pa.array(lo + a), pa.array(lo + b)], ["h", "g", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows and held["b"].nbytes > BLOCK:
                keys = held["k"].to_numpy()
                size = np.cumsum(np.asarray([len(x.as_buffer()) for x in held["b"]]))
                end = int(np.searchsorted(size, BLOCK)) + 1
                change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                k = np.searchsorted(change, end)
                if k == len(change):  # the bucket may go on in the next batch
                    if not len(change):
                        break
                    k -= 1
                cutoff = int(change[k])
                yield block(held.slice(0, cutoff))
                held = held.slice(cutoff)
        if held is not None and held.num_rows:
            yield block(held)

    return run


def _window_hashes(length: int):
    """A row for each window of the runs of hot buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                data, ends = bytes_of(rows["b"])
                starts = np.concatenate(([0], ends[:-1]))
                n = ends - starts - length + 1
                owner = np.repeat(np.arange(len(n)), n)
                inside = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                at = starts[owner] + inside
                e, f = (Rolling(data, seed).of(at, at + length).view(np.int64) for seed in (1, 2))
                lo = rows["at"].to_numpy()[owner] >> 24
                take = [rows[x].to_numpy()[owner] for x in ("n", "h", "g")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (e, f, *take, lo + inside))], ["e", "f", "n", "h", "g", "a"])

    return run


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """h, g, spans: the stretches of each distinct text (h, g, t, c) of `docs` (t) that repeated windows cover.

    Spans may overlap; texts without any are left out.
    """

    def runs_of(some: DataFrame) -> DataFrame:
        return some.where(F.octet_length("t") >= length).mapInArrow(_runs_of_texts(length, q), _RUN)

    one = F.lit(1).cast("long")
    every_run = runs_of(docs.select("t", one.alias("h"), one.alias("g"), one.alias("c")))
    often = every_run.select("k", _part("c")).groupBy(F.struct("k").alias("x")).agg(F.sum("c").alias("n")).where("n > 1").select("x.k")
    found = runs_of(texts)
    found = found.join(often, "k", "left_semi").select("k", *map(_part, _REST))
    classes = found.groupBy(F.struct("k", "r").alias("x")).agg(F.sum("c").alias("n"), F.min(F.struct("h", "g", "at")).alias("one"))
    classes = _in_use(classes.select("x.*", "n", "one.*"))
    whole = found.join(classes.where("n > 1").select("k", "r"), ["k", "r"], "left_semi").select(
        "h", "g", F.shiftright("at", 24).alias("a"), (F.shiftright("at", 24) + F.shiftright("at", 12).bitwiseAND(F.lit(0xFFF)) + length).alias("b")
    )
    several = classes.groupBy(F.struct("k").alias("x")).agg(F.count("*").alias("m")).where("m > 1").select("x.k", "m")
    asked = classes.join(several, "k").select("h", "g", "k", "n", "m", "at")

    def of_texts(some: DataFrame) -> DataFrame:
        by_text = some.groupBy("h", "g").agg(F.collect_list(F.struct("k", "n", "at")).alias("asked"))
        return texts.join(by_text, ["h", "g"]).select("h", "g", "t", "c", "asked")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both steps in one, as each of two would have a Python worker for each task."""
        return _window_hashes(length)(_contents(length)(batches))

    few = of_texts(asked.where(F.col("m") <= hot)).mapInArrow(_contents(length), "k long, n long, h long, g long, at long, b binary")
    partly = few.repartition("k").sortWithinPartitions("k").mapInArrow(_refine(length), _SPAN)
    windows = of_texts(asked.where(F.col("m") > hot)).mapInArrow(hashed, "e long, f long, n long, h long, g long, a long")
    twice = windows.groupBy(F.struct("e", "f").alias("x")).agg(F.count("*").alias("m")).where("m > 1").select("x.*")
    hotly = windows.where("n = 1").join(twice, ["e", "f"], "left_semi").select("h", "g", "a", (F.col("a") + length).alias("b"))
    every = whole.unionByName(partly).unionByName(hotly)
    return every.groupBy("h", "g").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cleaned(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digest, left = [], [], [], [], []
            for text, c, spans in zip(batch["t"].cast(pa.large_binary()), batch["c"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                text = text.as_py()
                n = len(text)
                if c > 1 and n >= length:
                    merged = [[0, n]]
                else:
                    merged = []
                    for x in sorted((x["a"], x["b"]) for x in spans or ()):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append([*x])
                at = [0, *(x for span in merged for x in span), n]
                kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                n_bytes.append(n)
                n_removed.append(n - len(kept))
                n_spans.append(len(merged))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "ignore"))
            columns = [batch["h"], batch["g"], *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())]
            names = ["h", "g", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(left, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: Columns of `remove_repeats`.
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """`docs` without its text, with n_bytes, n_removed, n_spans, kept_sha256 and, `with_text`, kept.

    kept is what remains, without bytes of characters that a cut left incomplete; kept_sha256 is of all bytes.
    A name that `docs` has already gets underscores (`common.free_names` of it tells them).
    """
    if not 1 <= length <= LONGEST:
        raise ValueError(f"length from 1 to {LONGEST}")
    own = list(RESULTS[: len(RESULTS) - (not with_text)])
    *results, h, g, h2, g2 = free_names(docs, *own, "h", "g", "h", "g")
    text = F.coalesce(named(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    keyed = docs.select(*map(named, others), F.xxhash64(text).alias(h), F.xxhash64(F.lit(7), text).alias(g))
    texts = (
        docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"), text.alias("t"))
        .groupBy("h", "g")
        .agg(F.first("t").alias("t"), F.count("*").alias("c"))
    )
    kinds = "h long, g long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    done = texts.join(repeated_spans(docs.select(text.alias("t")), texts, length, min(Q, length), hot), ["h", "g"], "left").select("h", "g", "t", "c", "spans").mapInArrow(
        _cleaned(length, with_text), kinds
    )
    done = done.toDF(h2, g2, *results)
    return keyed.join(done, (F.col(h) == F.col(h2)) & (F.col(g) == F.col(g2))).select(*map(named, [*others, *results]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, p, substring(x, CAST(2 * p + 1 AS BIGINT), 400) AS win FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM d)),
g AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
h AS (SELECT rid, p FROM w SEMI JOIN g USING (win)),
i AS (SELECT rid, p, CASE WHEN p - lag(p) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY rid ORDER BY p)),
j AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS k FROM i),
s AS (SELECT rid, k, min(p) AS a, max(p) + 200 AS b FROM j GROUP BY rid, k),
u AS (SELECT rid, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS removed, list(struct_pack(a := a, b := b) ORDER BY a) AS spans FROM s GROUP BY rid),
k AS (SELECT d.rid, doc_id, x, n, removed, [0] || list_transform(spans, lambda y: y.b) AS starts, list_transform(spans, lambda y: y.a) || [length(x) // 2] AS ends FROM d LEFT JOIN u USING (rid))
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(starts) + 1), lambda y: substring(x, CAST(2 * starts[y] + 1 AS BIGINT), CAST(2 * (ends[y] - starts[y]) AS BIGINT))), '') END)) AS kept_sha256 FROM k
"""
