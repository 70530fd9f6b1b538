"""Trigram search against a scan of every row, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from patternlake.operators import search, substring

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(3)
    words = ["Straße", "ÉCOLE", "naïve", "ab", "Abc", "x%y", "a_b", "back\\slash", "tab\t", "line\nbreak", "😀😁😂", "İstanbul", "ΣΑΣ", "abcabc", "q"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=20)) if k % 7 else None, rng.choice(["Src1", "src2"]), '["a", "b"]') for k in range(300)]
    return spark.createDataFrame(rows, "id long, name string, description string, source_object string, tags_text string").repartition(5).persist()


PATTERNS = ["abc", "ABCABC", "École naïve", "ß", "x%y", "%abc%q", "a_b", "k\\s", "e\nb", "tab\t", "😀😁", "😁😂 ", "istan", "İsta", "ΣΑΣ", "σας", "src1", '", "', "ab", "", "%", "zzz", "abc zzz", "abcab%", "___abc", "c a"]


def test_same_rows_as_a_scan(spark, catalog):
    grams = substring.write_grams(catalog)
    scan = catalog.select(*[F.struct("id", substring.any_like(p, substring.TEXT_COLUMNS).alias("hit")).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).collect()
    for k, p in enumerate(PATTERNS):
        want = {r[f"p{k}"]["id"] for r in scan if r[f"p{k}"]["hit"]}
        assert {r.id for r in substring.containing(catalog, p, grams).collect()} == want, p
    assert substring.candidates(grams, "ab") is None and substring.candidates(grams, "zzz").count() == 0


def test_some_columns(catalog):
    grams = substring.write_grams(catalog, ("name", "source_object"))
    got = substring.containing(catalog, "SRC1", grams, ("source_object",))
    assert got.count() == catalog.where("source_object = 'Src1'").count()
    with pytest.raises(ValueError):
        substring.containing(catalog, "src1", grams)


def test_many_candidates_are_not_fetched(catalog, monkeypatch):
    monkeypatch.setattr(substring, "FETCHED", 3)
    grams = substring.write_grams(catalog)
    assert substring.containing(catalog, "src1", grams).count() == catalog.where("source_object = 'Src1'").count()


def test_id_ranges(spark):
    ids = [1, 2, 3, 50, 51, 900, 10_000, -4]
    assert [r.id for r in spark.range(-10, 20_000).where(substring.id_ranges(ids, 3)).collect()] == sorted(ids)


def rows_read(df):
    """Rows that the scans of a plan hand on."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return total


def test_only_the_pages_of_its_trigrams_are_read(spark):
    """On a table of many pages: the postings of four trigrams of 400 thousand rows, then the pages of a few ids."""
    from patternlake.sources.store import written

    hay = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))
    stored = written(hay.repartitionByRange(4, "id").sortWithinPartitions("id"), "hay")
    grams = substring.write_grams(stored, ("name",))
    needle = stored.where("id = 77777").first().name[20:32]
    every = grams.postings.count()
    read = rows_read(substring.candidates(grams, needle))
    assert 0 < read < 0.05 * every
    found = substring.containing(stored, needle, grams, ("name",))
    assert 0 < rows_read(found) < 0.2 * 200_000 and [r.id for r in found.collect()] == [77777]


def test_search_falls_back_by_trigrams(catalog):
    index, grams = search.token_table(catalog, ("name", "description", "source_object", "tags_text")).persist(), substring.write_grams(catalog)
    for q in ("stra", "bcab", '"b"', "abc zzz"):
        assert {r.id for r in search.search(catalog, q, index, grams=grams).collect()} == {r.id for r in search.search(catalog, q, index).collect()}
