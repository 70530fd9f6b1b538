"""Answers as whole texts, event overlays, places of pages."""

import pytest
from pyspark.sql import functions as F

from patternlake.functions import text as T
from patternlake.operators import catalog, overlay, rendering, reports, search, substring
from tests.test_substring import rows_read


@pytest.fixture(scope="module")
def rows(spark):
    given = [(k, "field_definition", "Data Model", f"n{k}", None if k == 1 else "d" * 300, "Lead", '{"b": [1], "a": "é"}' if k else "broken", ["X__c", "Lead.Name", "Id"], "58.0" if k else "", k % 3 + 1, ["t", "u"], "s", "f.xml", None, False, k, "h", ["s"]) for k in range(4)]
    return spark.createDataFrame(given, catalog.SCHEMA)


def test_search_answer(rows):
    text = reports.as_text(reports.search_answer(rows, search.page(rows, 1, 2), "q"))
    assert text.startswith("Found 4 patterns (showing 2):\n\n  [2] n2\n      Category: Data Model | Type: field_definition\n      Object: Lead | Complexity: ***\n      " + "d" * 200 + "\n      Tags: t, u\n\n  [1] n1\n")
    none = rows.where("false")
    assert reports.as_text(reports.search_answer(none, none, "q")) == "No patterns found matching 'q'. Try broader keywords or different filters."


def test_detail_answer(rows):
    text = reports.as_text(reports.detail_answer(rows, 2))
    assert text.startswith(f"Pattern #2: n2\n{'=' * 60}\nCategory:    Data Model\n") and "API Version: 58.0\n" in text
    assert 'Field References:\n[\n  "X__c",\n  "Lead.Name",\n  "Id"\n]\n' in text and text.endswith('Structure (JSON):\n{\n  "b": [\n    1\n  ],\n  "a": "\\u00e9"\n}\n')
    assert "API Version: N/A" in reports.as_text(reports.detail_answer(rows, 0)) and "{}" in reports.as_text(reports.detail_answer(rows, 0))
    assert reports.as_text(reports.detail_answer(rows, 99)) == "Pattern 99 not found."


def test_other_answers(spark, rows):
    assert reports.as_text(reports.category_answer(rows, "P")) == "P - 4 total patterns\n\nCategories:\n  Data Model: 4 patterns (#a855f7)\n\nPattern Types:\n  field_definition: 4\n"
    sources = spark.createDataFrame([("S", 4)], "display_name string, pattern_count int")
    text = reports.as_text(reports.statistics_answer(rows, sources, "P"))
    assert text.endswith("Complexity Distribution:\n  1 (Basic): 2\n  2 (Simple): 1\n  3 (Moderate): 1\n\nIngested Sources: 1\n  S: 4 patterns\n")
    mapping = reports.as_text(reports.mapping_answer(rows, 1, "Case"))
    assert f"  {'X__c':40} → X__c\n  {'Lead.Name':40} → Case.Name\n  {'Id':40} → Id\n\n{'-' * 40}\nTotal Fields: 3\n" in mapping
    assert reports.as_text(reports.mapping_answer(rows, 9, "Case")) == "Pattern 9 not found."
    empty = reports.as_text(reports.statistics_answer(rows.where("false"), sources.where("false"), "P"))
    assert "Total Patterns: 0" in empty and "Ingested Sources: 0" in empty


def test_composition_answer(rows):
    composed = rows.select("*", F.col("id").alias("place")).where("id > 1")
    text = reports.as_text(reports.composition_answer(composed, "Make it so", "Case", ["Flow Logic", "Data Model"]))
    assert "\n--- Flow Logic (0 patterns) ---\n  No matching patterns found. Consider creating custom.\n\n--- Data Model (2 patterns) ---\n\n  [2] n2\n" in text
    assert "      Fields: X__c, Lead.Name, Id\n" in text and "Total Components: 2\n" in text and text.index("[2]") < text.index("[3]")


def test_overlay(spark, rows, tmp_path):
    folder = str(tmp_path / "events")
    for k, toggles, uses in ((1, 1, 0), (1, 0, 1), (1, 0, 1), (2, 1, 0), (2, 1, 0), (99, 1, 1)):
        overlay.record(spark, folder, k, toggles, uses)
    assert overlay.events(spark, folder).count() == 6  # one row each
    told = lambda f: {r.id: (r.favorited, r.use_count) for r in overlay.merged(rows, overlay.events(spark, f)).collect()}
    want = {0: (False, 0), 1: (True, 3), 2: (False, 2), 3: (False, 3)}
    assert told(folder) == want
    small = overlay.compact(spark, folder)
    assert told(small) == want and overlay.events(spark, small).count() == 3
    overlay.record(spark, small, 1, toggles=1)
    assert told(small)[1] == (False, 3) and overlay.merged(rows, overlay.events(spark, small)).columns == rows.columns


def test_corrupt_cache_entries(spark):
    entries = spark.createDataFrame([(1, '{"ids": [3]}', 1), (2, "{", 1), (3, '{"x": 1}', 1), (4, '{"ids": "no"}', 1), (5, None, 1), (6, '{"ids": [4]}', 99)], "k int, e string, h int")
    entries = entries.withColumn("at", F.expr("timestamp'2024-01-02' - make_interval(0, 0, 0, 0, h)"))
    got = rendering.cached(entries, "at", "e", 24, F.lit("2024-01-02").cast("timestamp")).collect()
    assert [(r.k, r.ids) for r in got] == [(1, [3])]


def test_places(spark):
    cat = spark.range(3000).selectExpr("id", "CAST(id * 7 % 5 + 1 AS int) AS complexity_score", "concat('n', id * 13 % 100) AS name").repartition(3)
    places = search.write_places(cat)
    for number, size in ((1, 50), (7, 200), (15, 200), (16, 200), (3000, 1)):
        assert search.page_at(cat, places, number, size).collect() == search.page(cat, number, size).collect()
    with pytest.raises(ValueError, match="page"):
        search.page_at(cat, places, 0)


def test_deep_pages_read_a_range(spark):
    cat = substring.written(spark.range(400_000).selectExpr("id", "1 AS complexity_score", "lpad(id, 9, '0') AS name").repartitionByRange(4, "id").sortWithinPartitions("id"), "deep")
    places = search.write_places(cat)
    assert rows_read(places.where("place BETWEEN 300001 AND 300020")) < 0.2 * 400_000
    assert [r.id for r in search.page_at(cat, places, 15_001, 20).collect()] == list(range(300_000, 300_020))


def test_folding(spark):
    texts = ["Άνθρωπος", "e\u0301", "Й", "Ầ", "plain", "ﬁ", "한국어"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.fold(F.col("t"))).collect()]
    assert got == ["ανθρωπος", "e", "и", "a", "plain", "ﬁ", "한국어"] and [T._plain_tokens(t) for t in texts] == [[g] for g in got]
