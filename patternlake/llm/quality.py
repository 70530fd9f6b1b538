"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule looks at a Text: the measures of one text, over words that are split once.
`cascade(df, rules)` orders the rules by rejections per second on a bounded sample and
folds them into one CASE chain, so that a row stops at the first rule that rejects it. A
rule's seconds are the best of RUNS jobs over the sample less those of a job without a
rule. The order changes the cost alone: the verdict is the conjunction of all rules.

The sample has SAMPLE_ROWS rows at most, drawn at a fixed share from as many of the first
splits as it takes, so that nothing but the sample is read or moved; texts of more than
SAMPLE_CHARS characters are not in it, which bounds what the driver holds.

Defined results: a null text counts as the empty text (no words, so the length
rule rejects it); long texts are measured whole (n log n for any text); repeated rows are
judged one by one; rules that gain alike keep the order in which they are given, as do all
in an empty table; columns of any other name pass through unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, free_name, let, named, table

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SHARE, RUNS = 1000, 50_000, 0.2, 2


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Of words, those that lie in a three-word window which there is twice or more.

    Windows are sorted with their positions, so the cost is n log n for any text.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )

    def repeated(s: Column) -> Column:
        return F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (F.get(s, j - 1)["t"] == x["t"]) | (F.get(s, j + 1)["t"] == x["t"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
            F.lit(0),
            lambda a, b: a + b,
        )

    def count(t: Column) -> Column:
        order = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
        marked = let(order, lambda s: F.sort_array(repeated(s)))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(marked, covered))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), count)).cast("long")


#: Measures by name, of a text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_lines": lambda t, w: F.size(lines(t)).cast("long"),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_letter_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
}


@dataclass(frozen=True)
class Text:
    """What rules look at: a text, its words, and the measures; `known` ones are at hand already."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def __getitem__(self, measure: str) -> Column:
        return self.known[measure] if measure in self.known else MEASURES[measure](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """`rejects` maps a Text to a boolean column that is true for bad texts."""

    name: str
    rejects: Callable[[Text], Column]


def default_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda x: x["n_words"] < 50),
        Rule("repeats", lambda x: 100 * x["n_repeat_words"] > 50 * x["n_words"]),
        Rule("symbols", lambda x: 10 * x["n_symbols"] > x["n_words"]),
        Rule("dup_lines", lambda x: 100 * x["n_dup_lines"] > 50 * x["n_lines"]),
        Rule("short_words", lambda x: x["word_chars"] < 2 * x["n_words"]),
        Rule("long_words", lambda x: x["word_chars"] > 15 * x["n_words"]),
        Rule("no_letters", lambda x: 100 * x["n_letter_words"] < 70 * x["n_words"]),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def estimate(df: DataFrame, rules: list[Rule], text_col: str = "text", known: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Share of sampled rows that each rule rejects, and its own seconds over the sample, where the `known` measures cost nothing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = df.select(text.alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    taken = given.sample(SAMPLE_SHARE, seed=5).limit(sample_rows).collect() or given.limit(sample_rows).collect()
    if not taken:
        return []
    sample = df.sparkSession.createDataFrame(taken, "t string").withColumn("w", words(F.col("t")))
    sample = sample.select("t", "w", *[MEASURES[m](F.col("t"), F.col("w")).alias(m) for m in known]).persist()
    x = Text(F.col("t"), F.col("w"), {m: F.col(m) for m in known})

    def measured(hit: Column) -> tuple[int, float]:
        count, best = sample.agg(F.sum(hit.cast("long")).alias("n")), float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            n = count.first()["n"]
            best = min(best, time.perf_counter() - began)
        return n, best

    try:
        sample.count()
        _, idle = measured(F.length("t") < 0)
        found = [(rule.name, *measured(rule.rejects(x))) for rule in rules]
    finally:
        sample.unpersist()
    return [Estimate(name, hits / len(taken), max(seconds - idle, 1e-4)) for name, hits, seconds in found]


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, largest first; ties keep the given order."""
    gain = {e.name: e.gain for e in estimates}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def first_rejection(x: Text, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, else null; later rules aren't evaluated."""
    chain = None
    for rule in rules:
        hit = rule.rejects(x)
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def cascade(
    df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", verdict_col: str = "rejected_by", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """`df` with the rule that rejected the row, null where all rules pass it."""
    rules = default_rules() if rules is None else rules
    order = ordered(rules, estimate(df, rules, text_col, sample_rows=sample_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(verdict_col, let(words(text), lambda w: first_rejection(Text(text, w), order)))


def keep(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that every rule passes, with the columns of `df`."""
    mark = free_name(df, "rejected_by")
    return cascade(df, rules, text_col, mark).where(F.col(mark).isNull()).select(*map(named, df.columns))


#: Measures that op1 returns anyway, so that its rules have them at hand.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t, rules = F.col("text"), default_rules()
    order = ordered(rules, estimate(docs, rules, known=RETURNED))

    def judged(w: Column) -> Column:
        return let(
            F.struct(*[MEASURES[m](t, w).alias(m) for m in RETURNED]),
            lambda m: F.struct(m.alias("m"), first_rejection(Text(t, w, {x: m[x] for x in RETURNED}), order).isNull().alias("kept")),
        )

    found = docs.select("doc_id", let(words(t), judged).alias("x"))
    m = {x: F.col(f"x.m.{x}") for x in RETURNED}
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return found.select("doc_id", *[m[x].alias(x) for x in RETURNED], failed.alias("base_failed"), F.col("x.kept").alias("kept"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS word,
             generate_subscripts(string_split_regex(text, '[\x20\x09-\x0D]+'), 1) AS pos FROM d),
w AS (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY pos) AS i FROM s WHERE word <> ''),
ws AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
              count(*) FILTER (WHERE regexp_matches(word, '\p{L}')) AS n_letter_words FROM w GROUP BY rid),
t AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM t WHERE tri IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
cov AS (SELECT DISTINCT rid, i + k AS i FROM dup, (VALUES (0), (1), (2)) AS x(k)),
cs AS (SELECT rid, count(*) AS n_repeat_words FROM cov GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_letter_words, 0) AS n_letter_words
      FROM d LEFT JOIN ws USING (rid) LEFT JOIN cs USING (rid) LEFT JOIN ls USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_letter_words < 70 * n_words) AS kept
FROM m
"""
