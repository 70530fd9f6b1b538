"""Files that arrive in several batches give the same patterns as files that arrive at once."""

import pytest
from pyspark.sql import functions as F

from patternlake.functions import text as T
from patternlake.operators import catalog, extract
from patternlake.sources import metadata
from patternlake.streaming import dropfolder
from tests import project


def put(base, name, text):
    path = base / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def told(rows):
    return sorted((r.pattern_type, r["name"], r.description, r.source_file, r.content_hash) for r in rows.collect())


@pytest.fixture
def drop(spark, tmp_path):
    def go():
        query = dropfolder.watch(spark, str(tmp_path / "in"), "acme", str(tmp_path / "out"), str(tmp_path / "state"), settle=0)
        query.awaitTermination()
        return dropfolder.current(spark, str(tmp_path / "out"))

    return tmp_path, go


def test_late_siblings_and_changes(spark, drop):
    base, go = drop
    top = base / "in"
    put(top, "lwc/rowList/rowList.js", project.SCRIPT)
    put(top, "lwc/other/other.html", project.PAGE)
    put(top, "classes/CaseService.cls", "public class CaseService { public void old() {} }")
    put(top, "classes/Gone.cls", "public class Gone { public void run() {} }")
    first = go()
    assert [r[1] for r in told(first)] == ["Apex: CaseService", "Apex: Gone", "LWC: Row List"]
    put(top, "lwc/rowList/rowList.html", project.PAGE)
    put(top, "lwc/rowList/rowList.js-meta.xml", project.META)
    put(top, "lwc/other/other.js", project.SCRIPT)
    put(top, "classes/CaseService.cls", project.APEX)
    put(top, "classes/Gone.cls", "")
    put(top, "objects/Lead/fields/Tier__c.field-meta.xml", project.field("Tier__c"))
    second = told(go())
    assert len(second) == 4 and not any("Gone" in r[1] for r in second)

    at_once = base / "once"
    query = dropfolder.watch(spark, str(top), "acme", str(at_once / "out"), str(at_once / "state"), settle=0)
    query.awaitTermination()
    assert second == told(dropfolder.current(spark, str(at_once / "out")))
    assert told(go()) == second  # nothing new

    dropfolder.compacted(spark, str(base / "out"), str(base / "small"))
    assert told(dropfolder.current(spark, str(base / "small"))) == second
    assert spark.read.parquet(str(base / "small/patterns")).count() == 4


def test_no_table_of_paths_goes_through_the_driver(spark, drop, capsys):
    base, go = drop
    for name in ("rowList.js", "rowList.html", "rowList.js-meta.xml"):
        put(base / "in", f"lwc/rowList/{name}", project.SCRIPT if name.endswith(".js") else project.PAGE if name.endswith("html") else project.META)
    rows = go()
    extract.components(metadata.scan(spark, str(base / "in"), "acme")).explain()
    rows.explain()
    assert rows.count() == 1 and "Broadcast" not in capsys.readouterr().out


def test_ingest_with_provenance(spark, drop):
    base, go = drop
    put(base / "in", "objects/Lead/fields/Tier__c.field-meta.xml", project.field("Tier__c"))
    put(base / "in", "classes/CaseService.cls", project.APEX)
    rows = go()
    shared = rows.where("pattern_type = 'field_definition'").first()
    known = [(7, "t", "c", "n", "", "o", "{}", [], "", 1, [], "other", "f", None, False, 2, shared.content_hash, ["other"])]
    merged = dropfolder.ingested(spark, str(base / "out"), spark.createDataFrame(known, catalog.SCHEMA), shared.source_hash, F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r.id, r.source_hash, tuple(r.seen_in_sources)) for r in merged} == {(7, "other", ("other", shared.source_hash)), (8, shared.source_hash, (shared.source_hash,))}
    assert shared.source_hash == spark.range(1).select(T.short_hash(F.lit("acme"), 12)).first()[0]
