"""How filters interact: who removes what in every order, from one pass over the documents.

Each document has a mask, one bit for each filter that it fails. For every set S of filters
the documents' parities (-1)^|mask & S| are summed per part and label: 2^n signed sums, which
add up over tasks, so just a row for each part and label leaves a task. They are the
Walsh-Hadamard transform of the numbers of documents with each mask, and the transform,
applied again and divided by 2^n, gives these cells exactly. All else follows from the cells:
a step of an order removes the cells that have its filter and none of those before it, and
in 1/k of the orders a filter is the first of a document's k failing ones, so that it removes
it in n!/k of them.

Defined results: a null text is the empty one and a null part the empty string; texts are
read whole; a document is a copy where its text, told by 128 bits and its length, is that of
a smaller id (rows that share id and text are no copies of one another, and a null id neither
makes a copy nor is one); repeated rows count each; labels that name an id twice hold where
any of them does, and labels of no document are left out; an empty table gives no parts;
columns of other names are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table
from .quality import words


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, by letter: true where it fails."""
    n = F.length(text)
    sizes = let(words(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": sizes["words"] < 200,
        "B": 100 * sizes["distinct"] < 50 * sizes["words"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * n,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(failures: dict[str, Column]) -> Column:
    """Bit k is set where filter number k fails."""
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures.values())])


def with_copies(docs: DataFrame, id_col: str, key: list[str], copy_col: str) -> DataFrame:
    """`docs` with whether a smaller id has the same key.

    A key's smallest id is found by partial sums; the rows are then met by key and id, so
    that a third of all rows with one key is dealt to all tasks.
    """
    first = docs.groupBy(*key).agg(F.min(id_col).alias("first_"))
    first = first.select(*[F.col(k).alias(f"{k}_") for k in key], "first_", F.lit(True).alias("found_"))
    met = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}_") for k in key], F.col(id_col) == F.col("first_"))
    return docs.join(first, met, "left").withColumn(copy_col, F.col("found_").isNull() & F.col(id_col).isNotNull()).select(*docs.columns, copy_col)


def _sign(a: Column, b: Column) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(masks: DataFrame, mask_col: str, n: int, by: list[str]) -> DataFrame:
    """`by` and sums: for each of the 2^n sets of filters the signed sum of parities."""
    sums = [F.sum(_sign(F.col(mask_col), F.lit(s)).cast("long")).alias(f"s{s}") for s in range(1 << n)]
    return masks.groupBy(*by).agg(*sums).select(*by, F.array(*[f"s{s}" for s in range(1 << n)]).alias("sums"))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """The columns of `sums`, mask and n: the number of documents with exactly these failures."""

    def inverted(sums: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit((1 << n) - 1)),
            lambda m: F.shiftright(F.aggregate(F.transform(sums, lambda x, s: x * _sign(m, s)), F.lit(0).cast("long"), lambda a, b: a + b), n),
        )

    rest = [c for c in sums.columns if c != "sums"]
    return sums.select(*rest, F.posexplode(inverted(F.col("sums"))).alias("mask", "n"))


def orders(counts: DataFrame, letters: str, by: list[str]) -> DataFrame:
    """Every order of the filters, step by step, from cells (`by`, mask, n, good, toxic)."""
    held = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bits = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))])

    def step(order: Column, k: Column) -> Column:
        before = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda j: F.when(j < k, bits[F.substring(order, j, 1)]).otherwise(0)), F.lit(0), lambda a, b: a + b)
        return F.struct(order.alias("filter_order"), k.alias("step"), bits[F.substring(order, k, 1)].alias("bit"), before.alias("before"))

    steps = F.flatten(F.transform(every, lambda o: F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda k: step(o, k))))
    rows = held.select(*by, "cells", F.explode(steps).alias("s"))

    def summed(value: str, hit) -> Column:
        chosen = F.transform("cells", lambda c: F.when(hit(c["mask"]), c[value]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + b)

    bit, before = F.col("s.bit"), F.col("s.before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    early = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~early(m)
    share = F.transform("cells", lambda c: F.when(fails(c["mask"]), c["n"] * F.floor(F.lit(factorial(len(letters))) / F.greatest(F.bit_count(c["mask"]), F.lit(1)))).otherwise(F.lit(0).cast("long")))
    return rows.select(
        *by,
        "s.filter_order",
        "s.step",
        summed("n", lambda m: ~fails(m) & ~early(m)).alias("kept"),
        summed("n", removed).alias("removed"),
        summed("n", lambda m: fails(m) & early(m)).alias("redundant"),
        summed("n", lambda m: m == bit).alias("unique_fails"),
        summed("good", removed).alias("good_lost"),
        summed("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, filter_order, step and the counts of each step, for the five filters A to E (E: copies).

    Texts are read twice, once for their hashes and once for all else; ids, hashes and masks
    alone are shuffled. n!/k is whole for up to five failures, so shapley is exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    narrow = read.select("i", "part", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), F.length("t").alias("n"), mask_of(text_failures(F.col("t"))).alias("m"))
    marked = with_copies(narrow, "i", ["h", "g", "n"], "copy").select("i", "part", (F.col("m") + F.when(F.col("copy"), 16).otherwise(0)).alias("m"))
    told = labels.groupBy(F.col(id_col).alias("j")).agg(F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    joined = marked.join(told, F.col("i") == F.col("j"), "left").select("part", "m", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    found = cells(parity_sums(joined, "m", 5, ["part", "good", "toxic"]), 5)
    counts = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return orders(counts, "ABCDE", ["part"])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k, substring(o, k, 1) AS x, substring(o, 1, k - 1) AS early FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS k)),
h AS (SELECT s.*, c.*, contains(fails, x) AS hit, early <> '' AND regexp_matches(fails, '[' || CASE WHEN early = '' THEN '_' ELSE early END || ']') AS gone FROM s, c),
r AS (SELECT part, o, k, x, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM h GROUP BY ALL)
SELECT part, o AS filter_order, k AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
