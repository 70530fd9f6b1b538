"""Extractors over many files: each file is looked through once, in whatever split it lies."""

import pytest
from pyspark.sql import functions as F

from patternlake.operators import extract
from patternlake.sources import metadata

_FLOW = """<Flow xmlns="http://soap.sforce.com/2006/04/metadata"><apiVersion>58.0</apiVersion><start><object>Case</object></start><object>Other</object>
<decisions a="1"><name>D</name><rules><name>r</name><conditions/><conditions/><connector><targetReference>M</targetReference></connector></rules><rules><connector/></rules></decisions>
<decisions><name>E</name><locationX>1</locationX><defaultConnector><targetReference>D</targetReference></defaultConnector></decisions>
<assignments><name>M</name><assignmentItems>Acc.Name</assignmentItems><assignmentItems>x__c</assignmentItems></assignments></Flow>"""


def test_elements_without_the_whole_flow():
    every = extract.flow_rows(_FLOW, "f.flow-meta.xml")
    assert [r["pattern_type"] for r in every] == ["flow_full", "flow_decision", "flow_decision", "flow_assignment"]
    assert extract.flow_rows(_FLOW, "f.flow-meta.xml", whole=False) == every[1:]
    assert extract.flow_rows(_FLOW, "f.flow-meta.xml", elements=False) == every[:1]
    assert every[0]["structure"]["topology"] == [{"from": "D", "to": "M", "type": "rule:r"}, {"from": "E", "to": "D", "type": "default"}]
    assert every[1]["structure"] == {
        "@attrs": {"a": "1"},
        "name": "D",
        "rules": [{"name": "r", "conditions": ["", ""], "connector": {"targetReference": "M"}}, {"connector": ""}],
    }
    assert every[3]["structure"] == {"name": "M", "assignmentItems": ["Acc.Name", "x__c"]}
    assert extract.structure_fields(every[3]["structure"]) == ["Acc.Name", "x__c"]


@pytest.mark.parametrize("kind", ["validations", "objects", "fields", "reports", "layouts"])
def test_files_of_one_split_are_dealt(spark, kind):
    files = spark.range(10).select(F.concat(F.lit("/p/a/"), "id").alias("path"), F.lit("x").alias("content")).coalesce(1)
    rows = getattr(extract, kind)(metadata.described(files, "a"))
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
