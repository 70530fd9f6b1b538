import json

import pytest
from pyspark.sql import functions as F

from patternlake.functions import text as T
from patternlake.operators import brands, catalog, graph, rendering, search
from patternlake.sources import dictionary, store
from patternlake.sources.store import numbered


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.anonymize, "see 001xx000003DGbQAAW or a@b.co", "see [SF_ID] or [EMAIL]"),
        (T.anonymize, "http://x.y/z 10.0.0.1 $1,200.50", "[URL] [IP] [AMOUNT]"),
        (T.anonymize, "$1", "$1"),
        (T.nesting_depth, "((a)(b(c)))", 3),
        (T.nesting_depth, "", 0),
        (T.formula_functions, "FLOOR(TODAY())", ["OR", "TODAY", "DAY"]),
        (T.company_core, "Acme Holdings, Inc.", "acme holdings"),
        (T.normalized, "Smith & Söhne, (AG)", "smith & söhne ag"),
        (T.acronym, "Department of Small Affairs", "dsa"),
        (T.keywords, "Build the Email, email alert!", ["email", "alert"]),
        (T.json_ids, "no ids", []),
        (T.json_ids, "take [3, 1]", [3, 1]),
        (lambda c: T.redact("label", c), "four", "[LABEL:4chars]"),
    ],
)
def test_text(spark, f, text, want):
    assert value(spark, text, f) == want


@pytest.mark.parametrize(
    ("text", "term", "want"), [("a Café here", "cafe", True), ("flow_decision x", "flow_decision", True), ("flow x decision", "flow_decision", False), ("x", "!!!", False), ("flows", "flo", False)]
)
def test_terms(spark, text, term, want):
    assert value(spark, text, lambda c: T.has_term(c, term)) is want


def test_like_escapes(spark):
    assert value(spark, "a\\b", lambda c: search.like(c, "A\\B")) is True
    assert value(spark, "axb", lambda c: search.like(c, "a_b")) is True


@pytest.mark.parametrize(
    ("term", "want"), [("AcmeCloud", True), ("WidgetCo", True), ("NOVAtech", True), ("bizible2", True), ("CreatedById", False), ("Status", False), ("IsAPastUser", True)]
)
def test_brand_shape(spark, term, want):
    assert value(spark, term, brands.looks_like_brand) is want


@pytest.mark.parametrize(("term", "want"), [("BizibleId", True), ("SyncToMarketo", True), ("mkto_si", True), ("X6sense", True), ("AcmeCloud", False)])
def test_ecosystem(spark, term, want):
    assert value(spark, term, brands.is_ecosystem) is want


def test_brand_scrub(spark):
    labels = {"AcmeCloud": "Brand_A", "Dev": "Brand_B", "Brand": "Brand_C"}
    assert value(spark, "acmecloud_DeveloperName Dev_Brand", lambda c: brands.scrub(c, labels)) == "Brand_A_DeveloperName Brand_B_Brand_C"


def test_brand_terms(spark):
    rows = [("A", "AcmeCloud_X__c"), ("B", "AcmeCloud_Y__c"), ("A", "ZedSoft__Tier__c"), ("A", "Direct_Energy_Plan__c"), ("A", "OneOff_Z__c")]
    names = spark.createDataFrame([("direct energy",), ("plan",)], "name string")
    found = brands.brand_terms(spark.createDataFrame(rows, "object string, field string"), names, ["Custom"])
    assert {r["term"]: r["label"] for r in found.collect()} == {"Custom": "Brand_A", "AcmeCloud": "Brand_B", "ZedSoft": "Brand_C", "Direct_Energy": "Brand_D", "Plan": "Brand_E"}


def test_dictionary(spark, tmp_path):
    (tmp_path / "rank.csv").write_text("rank,company\n1,Teladoc Health Inc.\n2,AB\n")
    (tmp_path / "sec.json").write_text(json.dumps({"0": {"title": "ZetaSync Corp", "ticker": "ZETA"}, "1": {"title": "Q Co", "ticker": "Q"}}))
    (tmp_path / "gov.csv").write_text("Organization name,Suborganization name\nBureau of Odd Things,Small Office\n")
    lists = [dictionary.from_ranking(spark, str(tmp_path / "rank.csv")), dictionary.from_tickers(spark, str(tmp_path / "sec.json")), dictionary.from_agencies(spark, str(tmp_path / "gov.csv"))]
    names = dictionary.build(lists, ["health", "office"])
    dictionary.write_names(names, str(tmp_path / "out"), ["names", "made here"])
    read = {r["name"] for r in dictionary.read_names(spark, str(tmp_path / "out")).collect()}
    assert {"teladoc", "teladoc health inc", "zetasync", "zeta", "bureau of odd things", "small office"} <= read
    assert not {"health", "office", "q"} & read


def rows(spark, *given):
    out = [(k, "t", "c", n, "", "o", "{}", [], "", 1, [], src, "f", None, fav, use, h, [src]) for k, n, src, fav, use, h in given]
    return spark.createDataFrame(out, catalog.SCHEMA)


def test_ingest_and_dedup(spark):
    old = rows(spark, (1, "a", "s1", False, 1, "h1"), (2, "b", "s1", True, 2, "h2"))
    new = rows(spark, (0, "a", "s2", False, 0, "h1"), (0, "x", "s2", False, 0, "h3"), (0, "x2", "s2", False, 0, "h3"))
    merged = catalog.ingest(new, old, "s2")
    found = {(r["id"], r["name"], r["source_hash"], tuple(r["seen_in_sources"])) for r in merged.collect()}
    assert found == {(1, "a", "s1", ("s1", "s2")), (2, "b", "s1", ("s1",)), (3, "x", "s2", ("s2",)), (4, "x2", "s2", ("s2",))}
    once = catalog.merge_duplicates(merged, age=("id",))
    assert {r["name"] for r in once.collect()} == {"a", "b", "x"}
    twice = catalog.merge_duplicates(once, age=("id",))
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_sources_table(spark):
    counts = spark.createDataFrame([("flow", 2), ("apex", 1)], "file_type string, n long")
    sources = catalog.upsert_source(spark.createDataFrame([], catalog.SOURCES), "s1", "Name", "/p", F.lit("2024-01-01").cast("timestamp"), counts)
    row = catalog.count_patterns(sources, rows(spark, (1, "a", "s1", False, 1, "h1"))).first()
    assert row["pattern_count"] == 1 and row["metadata_counts"] == {"flow": 2, "apex": 1}


def test_hash_backfill(spark):
    filled = catalog.with_hash(rows(spark, (1, "a", "s1", False, 1, None), (2, "b", "s1", False, 1, "h2"))).orderBy("id").collect()
    assert len(filled[0]["content_hash"]) == 16 and filled[1]["content_hash"] == "h2"


def test_pages(spark):
    cat = rows(spark, *[(k, f"n{k:02}", "s1", False, 0, "h") for k in range(1, 8)])
    assert [r["id"] for r in search.page(cat, 2, 3).collect()] == [4, 5, 6]
    assert search.page_counts(cat, 3).first()["pages"] == 3
    with pytest.raises(ValueError, match="page"):
        search.page(cat, 0)


def test_numbered(spark):
    rows = spark.range(1000, numPartitions=7).selectExpr("id", "(id * 7919) % 1000 AS k")
    found = numbered(rows, ["k"]).collect()
    assert all(r["place"] == r["k"] + 1 for r in found) and len(found) == 1000


def test_evolved(spark):
    old = spark.createDataFrame([(1, "a", "own")], "id int, Name string, extra string")
    new = catalog.evolved(old)
    assert new.columns[:2] == ["id", "pattern_type"] and new.columns[-1] == "extra" and new.schema["id"].dataType.simpleString() == "bigint"
    assert catalog.evolved(new).columns == new.columns and new.first()["name"] == "a"


def test_phrases_and_neighbours(spark):
    texts = spark.createDataFrame([(1, "a b a b c"), (2, "c x x b a"), (3, "b"), (4, None)], "id long, t string")
    index = search.token_table(texts, ("t",)).persist()
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(search.ids_with_all(index, "a_b_c")) == [1] and ids(search.ids_with_all(index, "b a")) == [1, 2] and ids(search.ids_with_all(index, "!!!")) == []
    assert ids(search.ids_near(index, "c", "b", 2)) == [1, 2] and ids(search.ids_near(index, "c", "b", 1)) == [1] and ids(search.ids_near(index, "a b", "c", 0)) == [1]
    assert ids(search.ids_near(index, "!", "c")) == [] and ids(search.ids_with_prefix(index, "X")) == [2] and ids(search.ids_with_prefix(index, "")) == []
    assert ids(search.either(search.ids_with_all(index, "x"), search.without(search.ids_with_all(index, "b"), search.ids_with_all(index, "c")))) == [2, 3]
    assert ids(search.both(search.ids_with_all(index, "b"), search.ids_with_all(index, "x"))) == [2]


def test_reach(spark):
    long = [("long", k, k + 1) for k in range(1000)]
    edges = spark.createDataFrame([*long, ("loop", 1, 2), ("loop", 2, 3), ("loop", 3, 1), ("loop", 1, 3), ("none", 5, None)], "g string, a int, b int")
    starts = spark.createDataFrame([("long", 0), ("loop", 1), ("lost", 9)], "g string, node int")
    found = {(r["g"], r["node"]): r["steps"] for r in graph.reach(edges, starts).collect()}
    assert found == {("long", k): k for k in range(1001)} | {("loop", 1): 0, ("loop", 2): 1, ("loop", 3): 1, ("lost", 9): 0}


def test_ledger_and_blueprint(spark):
    calls = spark.createDataFrame([("d1", 0.5), ("d1", 0.25), ("d2", 1.0)], "day string, cost double")
    ledger = rendering.store_call(spark.createDataFrame([("d1", 2, 1.0)], "day string, calls long, cost double"), F.col("day"), F.col("cost"), calls)
    assert sorted(map(tuple, ledger.collect())) == [("d1", 4, 1.75), ("d2", 1, 1.0)]
    rows = spark.createDataFrame([("c", 1, 7, "n", "o", 3, None, "t")], "category string, place int, id long, name string, source_object string, complexity_score int, description string, tags_text string")
    text = [r["text"] for r in rendering.blueprint(rows, "req", "obj").orderBy("category", "place").collect()]
    assert text[0].startswith("# Solution Blueprint") and text[0].endswith("Found 1 relevant patterns:") and text[1] == "### c" and text[2] == "- **[7] n** (o, complexity 3/5)\n  \n  Tags: t"


def test_tables_are_made_once(spark):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    store.forget("x")
    assert store.stored(spark, ("x", "y"), make).count() == store.stored(spark, ("x", "y"), make).count() == 3 and len(made) == 1
    store.forget("x")
    store.stored(spark, ("x", "y"), make)
    assert len(made) == 2
