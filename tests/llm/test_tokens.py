import random

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from patternlake.llm import bpe, token_counts
from patternlake.llm.common import free_name

TEXTS = ["", "a", "<|endoftext|>x <|endoftext|>", " " * 300 + "x", "\n\n\t x", "é" * 500, "ab" * 2000, "z" * 5000, "日本語 text 👍🏽", "it's we'll 12345"]


def odd_texts(n):
    rng = random.Random(1)
    pick = lambda: rng.choice([rng.randrange(32, 0x300), rng.randrange(1, 40), rng.randrange(0x3000, 0x9000), 0x1F600 + rng.randrange(60), 0x20, 0x85, 0xA0])
    return ["".join(chr(pick()) for _ in range(200)) for _ in range(n)]


def documents():
    return [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def test_bpe_as_library():
    mine = bpe.ByteBPE(bpe.load_ranks(P.path(bpe.RANKS)))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    for text in [*TEXTS, *odd_texts(100), *documents()]:
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_bpe_caches_keep_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    mine = bpe.ByteBPE(bpe.load_ranks(P.path(bpe.RANKS)))
    first = [mine.round_trip(t) for t in documents()]
    assert first == [mine.round_trip(t) for t in documents()]


def test_counts_as_library(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 100)
    theirs = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    mine = token_counts.Counts(P.path(token_counts.VOCABULARY), P.PATTERN, {"the": 1, " the": 1})
    texts = [*TEXTS, *odd_texts(100), *documents()]
    want = [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]
    assert mine.count_all(texts) == want
    assert [mine.count(t) for t in texts] == want


@pytest.fixture(scope="module")
def odd_rows(spark):
    rows = [(1, t, "x") for t in TEXTS] + [(None, None, None), (1 << 60, "twice", "x"), (1 << 60, "twice", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_rows(spark, odd_rows):
    digest = bpe.digest_documents(odd_rows, P.path(bpe.RANKS)).collect()
    assert len(digest) == len(TEXTS) + 3 and {r["doc_id"] for r in digest} == {1, None, 1 << 60}
    ids = {tuple(r["ids"]) for r in bpe.encode_documents(odd_rows, P.path(bpe.RANKS)).where("doc_id IS NULL").collect()}
    assert ids == {()}
    counts = token_counts.count_tokens(odd_rows, P.path(token_counts.VOCABULARY), 1024).collect()
    assert len(counts) == len(TEXTS) + 3
    assert [(r["n_bytes"], r["n_tokens"]) for r in counts if r["doc_id"] is None] == [(0, 0)]
    empty = odd_rows.limit(0)
    assert bpe.digest_documents(empty, P.path(bpe.RANKS)).count() == 0
    assert token_counts.count_tokens(empty, P.path(token_counts.VOCABULARY), 1024).count() == 0


def test_free_name(spark, odd_rows):
    assert free_name(odd_rows, "TEXT") == "TEXT_"
