import json

import pytest
from pyspark.sql import functions as F

from patternlake.operators import brands, catalog, extract
from patternlake.sources import metadata
from tests import project


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = project.write(tmp_path_factory.mktemp("projects"))
    assert metadata.project_root(spark, str(root)) == str(root / "force-app")
    return metadata.scan(spark, metadata.project_root(spark, str(root)), root.name).persist()


@pytest.fixture(scope="module")
def rows(files):
    labels = {r["term"]: r["label"] for r in brands.brand_terms(metadata.field_names(files)).collect()}
    assert labels == {"AcmeCloud": "Brand_A"}
    found = [r.asDict() for r in extract.extract(files, labels).collect()]
    for r in found:
        r["structure"] = json.loads(r["structure"])
    return found


def one(rows, kind, file):
    return next(r for r in rows if r["pattern_type"] == kind and r["source_file"].startswith(file))


def test_counts(files, rows):
    counts = {r["file_type"]: r["n"] for r in metadata.file_counts(files).collect()}
    assert counts == {"flow": 2, "validation": 1, "object": 1, "field": 5, "report": 2, "layout": 2, "lwc": 2, "apex": 2}
    kinds = {}
    for r in rows:
        kinds[r["pattern_type"]] = kinds.get(r["pattern_type"], 0) + 1
    assert kinds == {
        "flow_full": 1, "flow_decision": 1, "flow_record_update": 1, "flow_assignment": 1, "flow_formula": 1, "validation_rule": 1,
        "object_definition": 1, "field_definition": 4, "report_definition": 2, "layout_definition": 2, "lwc_component": 2, "apex_class": 1,
    }
    assert all(1 <= r["complexity_score"] <= 5 and len(r["content_hash"]) == 16 for r in rows)


def test_flow(rows):
    flow = one(rows, "flow_full", "Case")
    assert flow["name"] == "Flow: Case Router" and flow["source_object"] == "Case" and flow["api_version"] == "58.0"
    assert flow["structure"]["topology"] == [
        {"from": "Check", "to": "Save", "type": "rule:yes"},
        {"from": "Check", "to": "Done", "type": "default"},
        {"from": "Save", "to": "Done", "type": "next"},
        {"from": "Save", "to": "Oops", "type": "fault"},
    ]
    assert flow["structure"]["elements"] == {"decisions": 1, "recordUpdates": 1, "assignments": 1, "formulas": 1}
    decision = one(rows, "flow_decision", "Case")
    assert decision["structure"]["label"] == "[LABEL:10chars]" and "locationX" not in decision["structure"]
    assert decision["field_references"] == ["Case.Heat__c", "Heat__c"]
    assert one(rows, "flow_record_update", "Case")["source_object"] == "Account"


def test_validation(rows):
    rule = one(rows, "validation_rule", "Need")
    assert rule["name"] == "Validation: Need Mail" and rule["source_object"] == "Case"
    pattern = rule["structure"]["formulaPattern"]
    assert pattern["functions_used"] == ["AND", "OR", "ISBLANK"] and pattern["condition_count"] == 4 and pattern["nesting_depth"] == 3
    assert rule["field_references"] == ["Amount__c", "Email__c", "Rank__c", "User.Rank__c"]
    assert rule["tags"][-4:] == ["active", "func:and", "func:or", "func:isblank"]
    assert rule["description"] == "Active validation rule on Case using AND, OR, ISBLANK."


def test_objects_and_fields(rows):
    assert one(rows, "object_definition", "Case")["structure"]["actionOverrides"] == ["View:Flexipage"]
    twins = [r for r in rows if r["source_file"].startswith("AcmeCloud")]
    assert {r["name"] for r in twins} == {"Field: Case.Brand_A_Tier__c", "Field: Lead.Brand_A_Tier__c"}
    lookup = one(rows, "field_definition", "Solo")
    assert lookup["field_references"] == ["Lead.SoloBrand_Tier__c", "Account"] and lookup["tags"][-1] == "lookup"
    assert lookup["description"] == "Lookup field on Lead (lookup to Account)."
    assert one(rows, "field_definition", "mkto")["structure"]["isFormula"] is True


def test_report_and_layout(rows):
    report = one(rows, "report_definition", "Open")
    assert report["structure"]["columnCount"] == 2 and report["structure"]["filterCount"] == 2
    assert report["structure"]["filters"][1] == {"booleanFilter": "1"}
    assert report["field_references"] == ["CASE.AGE", "CASE.SUBJECT", "OWNER", "STATUS"] and "has-chart" in report["tags"]
    assert report["description"] == "Summary report on CaseList, with 2 columns, 1 groupings."
    layout = one(rows, "layout_definition", "Case-")
    assert layout["name"] == "Layout: Case - Case Layout" and layout["structure"]["totalFields"] == 2
    assert one(rows, "layout_definition", "Plain")["source_object"] == "Unknown"


def test_components_and_classes(rows):
    component = one(rows, "lwc_component", "rowList")
    assert component["name"] == "LWC: Row List" and component["source_object"] == "Account" and component["api_version"] == "59.0"
    assert component["structure"]["js"]["apex_calls"] == [{"localName": "getRows", "method": "RowController.getRows"}]
    assert component["structure"]["html"]["child_components"] == ["c-row", "lightning-input"]
    assert component["structure"]["meta"]["targets"] == ["RecordPage"]
    assert one(rows, "lwc_component", "bare")["structure"]["html"] == {}
    apex = one(rows, "apex_class", "CaseService")["structure"]
    assert apex["interfaces"] == ["Queueable", "Schedulable"] and apex["isSchedulable"] and apex["isAuraEnabled"]
    assert [(m["name"], m["paramCount"]) for m in apex["methods"]] == [("load", 2), ("store", 1)]
    assert apex["dmlOperations"] == ["update"] and apex["objectsReferenced"] == ["Case"]


def test_hash_ignores_key_order():
    assert extract.content_hash("a", "b", {"x": 1, "y": [2]}) == extract.content_hash("a", "b", {"y": [2], "x": 1})


def test_projects(spark, tmp_path):
    project.write(tmp_path)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "note.txt").write_text("x")
    config = '{"packageDirectories": [{"path": "none"}, {"path": "./src/"}, {"default": true}]}'
    for name, text in (("other", config), ("broken", "{")):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "sfdx-project.json").write_text(text)
        (tmp_path / name / "src" / "A.cls").write_text("class A {}")
    rows = metadata.projects(metadata.listing(spark, str(tmp_path)), str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["has_config"], r["has_package"]) for r in rows] == [("acme", False, True), ("broken", True, False), ("other", True, False)]
    assert [r["root"] for r in rows] == [str(tmp_path / "acme" / "force-app"), None, str(tmp_path / "other" / "src")]
    assert metadata.project_root(spark, str(tmp_path / "other")) == str(tmp_path / "other" / "src")
    assert metadata.project_root(spark, str(tmp_path / "broken")) is None and metadata.project_root(spark, str(tmp_path / "plain")) is None
    assert metadata.project_root(spark, str(tmp_path / "acme" / "force-app")) == str(tmp_path / "acme" / "force-app")


def test_brands_of_each_source(spark, files):
    """Rows of two sources meet their own terms only, and stored rows get the hash that extraction gives."""
    other = files.withColumn("source_hash", F.lit("other"))
    labels = spark.createDataFrame([(files.first()["source_hash"], "AcmeCloud", "Brand_A"), ("other", "Solo", "Brand_B")], "source_hash string, term string, label string")
    found = extract.extract(files.unionByName(other), labels).where("pattern_type = 'field_definition'")
    names = {(r["source_hash"] == "other", r["name"]) for r in found.collect()}
    assert (False, "Field: Lead.Brand_A_Tier__c") in names and (True, "Field: Lead.AcmeCloud_Tier__c") in names
    stored = found.withColumn("was", F.col("content_hash")).withColumn("content_hash", F.lit(None).cast("string"))
    assert catalog.with_hash(stored).where("content_hash <> was OR content_hash IS NULL").count() == 0
    texts = spark.createDataFrame([("s1", "an AcmeCloud x"), ("s2", "an acmecloud x"), ("s3", "AcmeCloud")], "source_hash string, t string")
    terms = spark.createDataFrame([("s1", "Acme", "Brand_B"), ("s1", "acmecloud", "Brand_A"), ("s2", "a.c", "Brand_A")], "source_hash string, term string, label string")
    assert {r["t"] for r in brands.scrub_by_source(texts, ["t"], terms).collect()} == {"an Brand_A x", "an acmecloud x", "AcmeCloud"}


def test_progress(files):
    from pyspark.sql import Observation

    progress = Observation("extraction")
    extract.watched(extract.extract(files), progress).count()
    assert progress.get["rows"] == progress.get["Data Model"] + sum(progress.get[c] for c in ("Flow Logic", "Data Validation", "UI Component", "Reporting", "Page Layout", "Apex Logic")) and progress.get["Data Model"] == 5


def test_tables_go_once_to_a_share(spark, files, monkeypatch):
    monkeypatch.setattr(extract, "SHARE_ROWS", 3)
    own, other = files.first()["source_hash"], files.withColumn("source_hash", F.lit("other"))
    loose, bare = files.withColumn("source_hash", F.lit(None).cast("string")), files.withColumn("source_hash", F.lit("bare"))
    every = files.unionByName(other).unionByName(loose).unionByName(bare)
    terms = [(own, "AcmeCloud", "Brand_A"), (own, "ACMECLOUD", "Brand_A"), (own, "AcmeCloud", "Brand_A"), (own, "", "no"), ("other", "Solo", "Brand_B"), ("absent", "x", "no")]
    labels = spark.createDataFrame(terms, "source_hash string, term string, label string")
    seen = lambda rows: sorted((str(r["source_hash"]), r["path"], r["pattern_type"], r["name"], r["structure"], r["content_hash"]) for r in rows.collect())
    want = []
    for part, table in ((files, {"AcmeCloud": "Brand_A"}), (other, {"Solo": "Brand_B"}), (loose, {}), (bare, {})):
        want += seen(extract.extract(part, table))
    assert seen(extract.extract(every, labels)) == sorted(want)

    rows = extract.fields(every)
    sizes = rows.groupBy("source_hash").agg(F.count("*").alias("n"))
    parts = extract._dealt(rows, labels, sizes).select("source_hash", F.spark_partition_id().alias("p"), "labels_", "name").collect()
    tables = [r for r in parts if r["labels_"] is not None]
    assert {r["source_hash"] for r in tables} == {own, "other"} and len(tables) == 4 and all(r["name"] is None for r in tables)
    of = {}
    for r in parts:  # each row of a source with terms comes after its table
        if r["labels_"] is not None:
            of[r["p"]] = r["source_hash"]
        elif r["source_hash"] in (own, "other"):
            assert of[r["p"]] == r["source_hash"]
    assert len(parts) - len(tables) == rows.count()


def test_a_large_table_is_refused(spark, files):
    with pytest.raises(ValueError, match="DataFrame"):
        extract.extract(files, {f"t{k}": "x" for k in range(extract.MOST_TERMS + 1)})
