"""Token counts by a two-tier lookup on the map side.

A table of the lengths, in tokens, of the corpus's frequent pre-tokens is broadcast;
its size is bounded by FREQUENT entries. Other pre-tokens are encoded in the worker
that meets them and kept in its bounded cache. Occurrences of pre-tokens are never
shuffled: to find the frequent ones, each task counts over all its texts and hands
on its LOCAL commonest, and only these summaries are merged. The table decides the
speed alone, not the counts.

Defined results: null text is the empty text (0 bytes, 0 tokens); strings of special
tokens count as the tokenizer's default has it, as one token each; repeated rows are
counted each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table; with LONGEST it has some 4 MB at most.
FREQUENT = 50_000
#: Pre-tokens that each task hands on.
LOCAL = 5_000
#: Distinct pre-tokens that a task counts at a time, and in each generation of a worker's cache.
WINDOW, CACHE = 300_000, 300_000
#: Texts whose misses are encoded together.
CHUNK = 200
#: Pre-tokens of more characters are neither tabled nor cached.
LONGEST = 32


class Counts:
    """Token counts of texts, for one tokenizer file."""

    def __init__(self, path: str, pattern: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = special_pattern(path)
        self.split = regex.compile(pattern).findall
        self.frequent = frequent
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x.ids) for x in self.encoder.encode_batch(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> dict[str, int]:
        """Lengths of `words`, which the newer cache doesn't have; the short ones go there."""
        old = self.older
        new = {w: old[w] for w in words if w in old}
        unknown = [w for w in words if w not in new]
        new.update(zip(unknown, self.lengths(unknown), strict=True))
        if len(self.cache) + len(new) > CACHE:
            self.cache, self.older = {}, self.cache
        self.cache.update((w, n) for w, n in new.items() if len(w) <= LONGEST)
        return new

    def count_all(self, texts: list[str]) -> list[int]:
        first, second = self.frequent.get, self.cache.get
        totals, missed = [], []
        for text in texts:
            pieces = self.special.split(text) if self.special else [text]
            total, rest = len(pieces) - 1, []
            for piece in pieces:
                words = self.split(piece)
                got = [first(w) or second(w) for w in words]
                if None in got:
                    rest += [w for w, n in zip(words, got, strict=True) if n is None]
                    got = [n for n in got if n is not None]
                total += sum(got)
            totals.append(total)
            missed.append(rest)
        if unknown := {w for rest in missed for w in rest}:
            new = self.learn(unknown)
            for k, rest in enumerate(missed):
                totals[k] += sum([new[w] for w in rest])
        return totals

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


def special_pattern(path: str) -> regex.Pattern | None:
    """Matches the added tokens that the tokenizer finds inside texts."""
    import json

    with open(path) as file:
        added = json.load(file).get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        raise ValueError("only plain added tokens are supported")
    strings = sorted((x["content"] for x in added), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, strings))) if strings else None


_workers: dict[tuple, Counts] = {}


class _Tier:
    """The broadcast table with a name by which workers tell it from an earlier one."""

    def __init__(self, spark: SparkSession, lengths: dict[str, int]):
        self.shared = spark.sparkContext.broadcast(lengths)
        self.id = hash(frozenset(lengths.items()))

    @property
    def value(self) -> dict[str, int]:
        return self.shared.value


def frequent_words(texts: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, size: int = FREQUENT) -> list[str]:
    """The commonest pre-tokens of column t, from every task's summary of all its texts."""

    def run(batches: Iterator) -> Iterator:
        split, special, seen = regex.compile(pattern).findall, special_pattern(path), Counter()
        for rows in batches:
            for text in rows["t"]:
                for piece in special.split(text) if special else [text]:
                    seen.update(split(piece))
                if len(seen) > WINDOW:
                    seen = Counter(dict(seen.most_common(WINDOW // 3)))
        top = [(w, n) for w, n in seen.most_common(LOCAL) if len(w) <= LONGEST]
        yield pd.DataFrame({"w": [w for w, _ in top], "n": [n for _, n in top]})

    tops = texts.mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r["w"] for r in tops.orderBy(F.desc("n"), "w").limit(size).collect()]


def count_tokens(
    docs: DataFrame, path: str, limit: int, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", size: int = FREQUENT
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text."""
    words = frequent_words(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")), path, pattern, size)
    lengths = Counts(path, pattern, {}).lengths(words)
    tier = _Tier(docs.sparkSession, dict(zip(words, lengths, strict=True)))

    def make():
        key = (path, pattern, tier.id)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Counts(path, pattern, tier.value)
        counts = _workers[key]

        def rows(texts: list[str]) -> list[tuple]:
            chunks = (texts[k : k + CHUNK] for k in range(0, len(texts), CHUNK))
            return [(len(t.encode()), n, n > limit) for chunk in chunks for t, n in zip(chunk, counts.count_all(chunk), strict=True)]

        return rows

    return map_texts(docs, id_col, text_col, make, "n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 1024)
