"""Tries and label tables against flat alternations, and their time."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from patternlake.functions import terms
from patternlake.operators import brands
from patternlake.operators.extract import Scrubber


def flat(labels):
    names = sorted(labels, key=lambda t: (-len(t), t))
    pattern = re.compile("(?i)(?<![a-zA-Z])(?:" + "|".join(map(re.escape, names)) + ")(?![a-zA-Z])")
    low = {t.lower(): v for t, v in labels.items()}
    return lambda text: pattern.sub(lambda m: low[m[0].lower()], text)


def made(rng, n):
    parts = ["a", "ab", "abc", "b", "ba", "Zed", " ", "-", "_", "$", ".", "|", "7", "é", "É", "(", "\\", "😀"]
    return {t: f"<{k}>" for k, t in enumerate({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)}) if t.strip()}


def test_same_as_a_flat_alternation(spark):
    rng = random.Random(1)
    for n in (1, 5, 60):
        given = made(rng, n)
        labels = {}
        for t in given:  # one label for terms that differ in case alone
            labels[t] = next((labels[o] for o in labels if o.lower() == t.lower()), given[t])
        texts = ["".join(rng.choices([*labels, "a", "B", "ab", " ", "-", "x", "É", "(", "ZED", "\ue000" if k % 5 == 0 else "$1"], k=rng.randint(0, 30))) for k in range(80)]
        want = [flat(labels)(t) for t in texts]
        trie = re.compile(terms.trie_pattern(list(labels)))
        low = {t.lower(): v for t, v in labels.items()}
        assert [trie.sub(lambda m: low[m[0].lower()], t) for t in texts] == want
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        assert [r.x for r in df.select("k", brands.scrub(F.col("t"), labels).alias("x")).orderBy("k").collect()] == want
        by_source = spark.createDataFrame([("s", t, v) for t, v in labels.items()] + [("other", "x", "no")], "source_hash string, term string, label string")
        rows = df.withColumn("source_hash", F.lit("s")).withColumn("extra", F.lit(1))
        assert [r.t for r in brands.scrub_by_source(rows, ["t"], by_source).orderBy("k").collect()] == want


def test_sources_without_terms_stay(spark):
    rows = spark.createDataFrame([(1, "s", "acme x"), (2, None, "acme"), (3, "t", "acme"), (4, "s", None), (5, "s", "")], "k int, source_hash string, t string")
    labels = spark.createDataFrame([("s", "ACME", "B"), ("s", "Acme", "B"), ("s", "", "no")], "source_hash string, term string, label string")
    got = brands.scrub_by_source(rows, ["t"], labels)
    assert {r.k: r.t for r in got.collect()} == {1: "B x", 2: "acme", 3: "acme", 4: None, 5: ""}
    assert brands.scrub_by_source(rows, ["t"], labels.where("false")).count() == 5


def test_deep_and_long_terms():
    long = ["a" * k for k in range(1, 1500)]
    pattern = re.compile(terms.trie_pattern(long[:300]))
    assert pattern.sub("!", "a" * 299 + " b") == "! b"
    assert len(terms.trie_pattern(long)) < 20_000


def test_time_does_not_grow_with_the_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    known = [word() for _ in range(10_000)]
    texts = spark.createDataFrame([(" ".join(rng.choice(known[:20]) if rng.random() < 0.1 else word() for _ in range(5000)),) for _ in range(40)], "t string").withColumn("source_hash", F.lit("s"))
    texts = texts.repartition(4).persist()
    texts.count()

    def seconds(n):
        labels = spark.createDataFrame([("s", t, "B") for t in known[:n]], "source_hash string, term string, label string").persist()
        labels.count()
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            brands.scrub_by_source(texts, ["t"], labels).agg(F.sum(F.length("t"))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    few, many = seconds(100), seconds(10_000)
    assert many < 3 * few + 2


def test_a_text_gets_only_the_terms_that_it_may_have(spark):
    known = ["w" + "".join(chr(97 + k // 26**i % 26) for i in range(5)) for k in range(100_000)]
    labels = spark.createDataFrame([("s", t, f"<{k}>") for k, t in enumerate(known)] + [("s", "z" * k, "Z") for k in range(1, 3000)], "source_hash string, term string, label string")
    rows = spark.createDataFrame([(k, "s", f"{known[k]} {known[-1 - k].upper()}, x{known[k]} {'z' * (k + 1)}") for k in range(2000)], "k int, source_hash string, t string")
    began = time.perf_counter()
    got = {r.k: r.t for r in brands.scrub_by_source(rows, ["t"], labels).collect()}
    assert got == {k: f"<{k}> <{99_999 - k}>, x{known[k]} Z" for k in range(2000)}
    assert time.perf_counter() - began < 30


def test_long_texts_empty_sources_and_batches(spark, monkeypatch):
    monkeypatch.setattr(brands, "BATCH_ROWS", 2)
    monkeypatch.setattr(brands, "LARGE", 30)
    labels = spark.createDataFrame([(1, "Acme Cloud", "A"), (1, "acme", "B"), (1, "7-7", None), (1, "\u212aay", "K"), (2, "acme", "C")], "n int, term string, label string")
    texts = [(1, "acme cloud 7-7 x7-7 17-78"), (1, "ACME clouds" + " acme" * 9), (1, None), (2, "Acme Cloud"), (3, "acme"), (None, "acme"), (1, "kay Kay \u212aay ka\u0131 acme\u017f")] * 3
    rows = spark.createDataFrame([(k, n, t, t) for k, (n, t) in enumerate(texts)], "k int, n int, t string, u string").repartition(3)
    want = ["A [BRAND] x7-7 1[BRAND]8", "B clouds" + " B" * 9, None, "C Cloud", "acme", "acme", "K K K ka\u0131 acme\u017f"] * 3
    got = brands.scrub_by_source(rows, ["t", "u"], labels, "n").orderBy("k").collect()
    assert [r.t for r in got] == [r.u for r in got] == want
    assert [r.n for r in got] == [n for n, _ in texts]


def test_odd_texts_as_in_sql(spark, tmp_path):
    """No row for a document without text, and letters other than a to z, though folded to some, part words."""
    texts = ["\u212aelvinx ok", "kelvinx \u017fuccess", "KELVINX success", None, "", "SUCCESS x\u0130stanbul \u0130stanbul", "istanbul xistanbul \u0131stanbul stanbul", " ", "uccess \u017fUCCESS", "su\u0307ccess \u00e9success"]
    rows = [(k, "s", t) for k, t in enumerate(texts)] + [(20, None, "success"), (21, "t", "success"), (22, None, "success"), (23, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["scrub_many_terms"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["scrub_many_terms"]).fetchall()
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)


def test_only_ascii_letters_have_two_cases(spark):
    rows = spark.createDataFrame([(1, "s", "ACME \u00c9a 7-7 \u212aay KAY-1 acme\u017f \u00e9A")], "k int, source_hash string, t string")
    labels = spark.createDataFrame([("s", "Acme", "A"), ("s", "\u00e9a", "E"), ("s", "7-7", "7"), ("s", "kay", "K"), ("s", "kay-1", "K1")], "source_hash string, term string, label string")
    assert brands.scrub_by_source(rows, ["t"], labels, ascii_only=True).first().t == "A \u00c9a 7 \u212aay K1 A\u017f E"
    assert brands.scrub_by_source(rows, ["t"], labels).first().t == "A E 7 K K1 acme\u017f E"


def test_documents_are_scrubbed_alike():
    labels = {"AcmeCloud": "Brand_A", "Acme": "Brand_B"}
    clean = Scrubber(labels | {"": "no"})
    assert clean.text("acmecloud ACME acmes x") == "Brand_A Brand_B acmes x"
