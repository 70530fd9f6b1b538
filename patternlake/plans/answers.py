"""Tool answers, event overlays and the ranking's bookkeeping over the fixture tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import overlay, rendering, reports, search
from ..sources.store import shared_folder
from .catalog_view import catalog, load
from .registry import query


def _full(spark, d) -> DataFrame:
    """The catalog with the columns that only extracted ones have."""
    own = F.concat(F.lit('{"b": [1, "'), "source_object", F.lit('"], "a": {}}'))
    refs = F.array(F.lit("Amt__c"), F.concat("source_object", F.lit(".Kind")), F.col("pattern_type"), F.lit("Name"))
    return catalog(spark, d).select("*", F.array("category", "source_object").alias("tags"), refs.alias("field_references"), own.alias("structure"), F.lit("f.xml").alias("source_file"))


_SHOWN = "'  [' || id || '] ' || name || chr(10) || '      Category: ' || category || ' | Type: ' || pattern_type || chr(10) || '      Object: ' || source_object || ' | Complexity: ' || repeat('*', complexity_score) || chr(10) || '      ' || substring(description, 1, 200) || chr(10) || '      Tags: ' || category || ', ' || source_object || chr(10) || chr(10)"


@query(f"""x AS (SELECT * FROM cat WHERE category = 'en' AND complexity_score >= 2), y AS (SELECT *, row_number() OVER (ORDER BY complexity_score DESC, name, id) AS k FROM x)
SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Found ' || count(*) || ' patterns (showing ' || count(*) FILTER (WHERE k BETWEEN 6 AND 10) || '):' || chr(10) || chr(10) AS text FROM y
UNION ALL SELECT 1, k - 5, {_SHOWN} FROM y WHERE k BETWEEN 6 AND 10""", True)
def answer_search(spark, d):
    found = _full(spark, d).where(search.filters(category="en", min_complexity=2))
    return reports.search_answer(found, search.page(found, 2, 5), "")


_STRUCTURE = "'{{' || chr(10) || '  \"b\": [' || chr(10) || '    1,' || chr(10) || '    \"' || source_object || '\"' || chr(10) || '  ],' || chr(10) || '  \"a\": {{}}' || chr(10) || '}}' || chr(10)".replace("{{", "{").replace("}}", "}")


@query(f"""SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Pattern #7: ' || name || chr(10) || repeat('=', 60) || chr(10) || 'Category:    ' || category || chr(10) || 'Type:        ' || pattern_type || chr(10) || 'Object:      ' || source_object || chr(10)
|| 'Complexity:  ' || complexity_score || '/5' || chr(10) || 'API Version: N/A' || chr(10) || 'Source File: f.xml' || chr(10) || 'Uses:        ' || use_count || chr(10) || chr(10) || 'Description:' || chr(10) || description || chr(10) || chr(10) || 'Field References:' || chr(10)
|| '[' || chr(10) || '  "Amt__c",' || chr(10) || '  "' || source_object || '.Kind",' || chr(10) || '  "' || pattern_type || '",' || chr(10) || '  "Name"' || chr(10) || ']' || chr(10) || chr(10) || 'Tags: ' || category || ', ' || source_object || chr(10) || chr(10) || 'Structure (JSON):' || chr(10) || {_STRUCTURE} AS text
FROM cat WHERE id = 7 UNION ALL SELECT 0, 0, 'Pattern -7 not found.'""", True)
def answer_detail(spark, d):
    rows = _full(spark, d)
    return reports.detail_answer(rows, 7).unionByName(reports.detail_answer(rows, -7))


@query("""t AS (SELECT category, count(*) AS n FROM cat GROUP BY 1), u AS (SELECT pattern_type, count(*) AS n FROM cat GROUP BY 1)
SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Patterns - ' || sum(n) || ' total patterns' || chr(10) || chr(10) || 'Categories:' || chr(10) AS text FROM t
UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, category), '  ' || category || ': ' || n || ' patterns (#888)' || chr(10) FROM t
UNION ALL SELECT 2, 0, chr(10) || 'Pattern Types:' || chr(10) UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, pattern_type), '  ' || pattern_type || ': ' || n || chr(10) FROM u""", True)
def answer_categories(spark, d):
    return reports.category_answer(_full(spark, d), "Patterns")


@query("""t AS (SELECT category, count(*) AS n FROM cat GROUP BY 1), o AS (SELECT source_object, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source_object) AS k FROM cat GROUP BY 1), c AS (SELECT complexity_score AS s, count(*) AS n FROM cat GROUP BY 1)
SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Statistics' || chr(10) || repeat('=', 40) || chr(10) || 'Total Patterns: ' || sum(n) || chr(10) || chr(10) || 'By Category:' || chr(10) AS text FROM t
UNION ALL SELECT 1, row_number() OVER (ORDER BY category), '  ' || category || ': ' || n || chr(10) FROM t UNION ALL SELECT 2, 0, chr(10) || 'Top Objects:' || chr(10) UNION ALL SELECT 3, k, '  ' || source_object || ': ' || n || chr(10) FROM o WHERE k <= 15
UNION ALL SELECT 4, 0, chr(10) || 'Complexity Distribution:' || chr(10) UNION ALL SELECT 5, row_number() OVER (ORDER BY s), '  ' || s || ' (' || ['Basic', 'Simple', 'Moderate', 'Complex', 'Expert'][s] || '): ' || n || chr(10) FROM c
UNION ALL SELECT 6, 0, chr(10) || 'Ingested Sources: ' || count(*) || chr(10) FROM nation UNION ALL SELECT 7, row_number() OVER (ORDER BY n_name), '  ' || n_name || ': ' || n_regionkey || ' patterns' || chr(10) FROM nation""", True)
def answer_statistics(spark, d):
    sources = load(spark, d, "nation").select(F.col("n_name").alias("display_name"), F.col("n_regionkey").alias("pattern_count"))
    return reports.statistics_answer(_full(spark, d), sources, "Statistics")


_COMPOSED = """w AS (SELECT * FROM (VALUES (1, 'thing'), (2, 'und')) AS v(k, word)),
x AS (SELECT category, id, k FROM (SELECT category, id, k, row_number() OVER (PARTITION BY category, k ORDER BY id) AS n FROM cat JOIN w
      ON name ILIKE '%' || word || '%' OR description ILIKE '%' || word || '%' OR tags_text ILIKE '%' || word || '%') WHERE n <= 5
      UNION ALL SELECT category, id, 0 FROM cat WHERE source_object ILIKE '%src1%'),
y AS (SELECT category, id, min(k) AS origin FROM x WHERE category IN ('en', 'de') GROUP BY 1, 2),
p AS (SELECT * FROM (SELECT y.category, y.id, row_number() OVER (PARTITION BY y.category ORDER BY complexity_score DESC, origin, y.id) AS place FROM y JOIN cat USING (id)) WHERE place <= 5),
z AS (SELECT p.category, p.place, cat.* EXCLUDE (category), CASE p.category WHEN 'en' THEN 1 WHEN 'de' THEN 3 END AS part FROM p JOIN cat USING (id)),
g AS (SELECT v.*, (SELECT count(*) FROM z WHERE z.category = v.category) AS n FROM (VALUES ('en', 1), ('de', 3), ('xx', 5)) AS v(category, part))"""


@query(_COMPOSED + """ SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Solution Blueprint: A thing, und more' || chr(10) || repeat('=', 60) || chr(10) || 'Target Object: src1' || chr(10) || 'Keywords: thing, und' || chr(10) || chr(10) AS text
UNION ALL SELECT part, 0, chr(10) || '--- ' || category || ' (' || n || ' patterns) ---' || chr(10) || CASE WHEN n = 0 THEN '  No matching patterns found. Consider creating custom.' || chr(10) ELSE '' END FROM g
UNION ALL SELECT part + 1, place, chr(10) || '  [' || id || '] ' || name || chr(10) || '      Object: ' || source_object || ' | Complexity: ' || complexity_score || '/5' || chr(10) || '      ' || substring(description, 1, 150) || chr(10) || '      Fields: Amt__c, ' || source_object || '.Kind, ' || pattern_type || ', Name' || chr(10) FROM z
UNION ALL SELECT 7, 0, chr(10) || repeat('=', 60) || chr(10) || 'Total Components: ' || sum(n) || chr(10) || chr(10) || 'Next Steps:' || chr(10) || '1. Use get_pattern(id) to retrieve full structure for each component' || chr(10)
|| '2. Use generate_field_mapping(id, ''src1'') to map fields' || chr(10) || '3. Adapt the pattern structures to your target org''s field names' || chr(10) || '4. Deploy via SFDX or Metadata API' || chr(10) FROM g""", True)
def answer_composition(spark, d):
    composed = search.compose(_full(spark, d), "A thing, und more", "src1", ("en", "de", "xx"))
    return reports.composition_answer(composed, "A thing, und more", "src1", ["en", "de", "xx"])


@query(_COMPOSED + """ SELECT '' AS category, CAST(-1 AS BIGINT) AS place, '# Solution Blueprint' || chr(10) || '## Requirement: A thing, und more' || chr(10) || '## Target Object: src1' || chr(10) || chr(10) || 'Found ' || count(*) || ' relevant patterns:' AS text FROM z
UNION ALL SELECT DISTINCT category, 0, '### ' || category FROM z
UNION ALL SELECT category, place, '- **[' || id || '] ' || name || '** (' || source_object || ', complexity ' || complexity_score || '/5)' || chr(10) || '  ' || description || chr(10) || '  Tags: ' || tags_text FROM z""", True)
def blueprint(spark, d):
    return rendering.blueprint(search.compose(_full(spark, d), "A thing, und more", "src1", ("en", "de")), "A thing, und more", "src1")


@query(f"""SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS place, 'Field Mapping Template' || chr(10) || repeat('=', 60) || chr(10) || 'Pattern: ' || name || ' (#7)' || chr(10) || 'Source Object: ' || source_object || chr(10) || 'Target Object: Lead' || chr(10) || chr(10) || 'Field Mappings (source → target):' || chr(10) || repeat('-', 40) || chr(10) AS text FROM cat WHERE id = 7
UNION ALL SELECT 1, k, '  ' || rpad(ref, 40, ' ') || ' → ' || target || chr(10) FROM (SELECT unnest([0, 1, 2, 3]) AS k, unnest(['Amt__c', source_object || '.Kind', pattern_type, 'Name']) AS ref, unnest(['Amt__c', 'Lead.Kind', pattern_type, 'Name']) AS target FROM cat WHERE id = 7)
UNION ALL SELECT 2, 0, chr(10) || repeat('-', 40) || chr(10) || 'Total Fields: 4' || chr(10) || chr(10) || 'Instructions:' || chr(10) || '1. Review each mapping above' || chr(10) || '2. Replace custom field names (__c) with your org''s field API names' || chr(10) || '3. Verify relationship fields point to correct objects' || chr(10)
|| '4. Standard fields (Name, Id, etc.) usually map 1:1' || chr(10) || chr(10) || 'Pattern Structure (for reference):' || chr(10) || {_STRUCTURE} FROM cat WHERE id = 7""", True)
def answer_mapping(spark, d):
    return reports.mapping_answer(_full(spark, d), 7, "Lead")


# Events beside the catalog ---------------------------------------------------------------


@query("""e AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'click') % 2 = 1 AS turned, count(*) FILTER (WHERE event_type <> 'click') AS uses FROM events GROUP BY 1)
SELECT cat.id, favorited <> coalesce(turned, false) AS favorited, use_count + coalesce(uses, 0) AS use_count FROM cat LEFT JOIN e ON e.id = cat.id""".replace("e AS (", "x AS (").replace("JOIN e ON e.id", "JOIN x ON x.id"), True)
def overlay_states(spark, d):
    """Toggles and reads in several appends, with a compaction between."""
    folder = f"{shared_folder(spark)}/overlay-{uuid.uuid4().hex}"
    click = F.col("event_type") == "click"
    rows = load(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.when(click, 1).otherwise(0).cast("long").alias("toggles"), F.when(click, 0).otherwise(1).cast("long").alias("uses"))
    overlay.append(rows.where("event_id % 3 = 0"), folder)
    overlay.append(rows.where("event_id % 3 = 1"), folder)
    folder = overlay.compact(spark, folder)
    overlay.append(rows.where("event_id % 3 = 2"), folder)
    return overlay.merged(catalog(spark, d), overlay.events(spark, folder)).select("id", "favorited", "use_count")


# The ranking's cache and ledger, progress ---------------------------------------------------


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 6) AS cost FROM events GROUP BY 1""")
def cost_ledger(spark, d):
    """A day's calls added to a ledger in two steps."""
    calls = load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("cost"), "event_id")
    ledger = spark.createDataFrame([], "day string, calls long, cost double")
    for part in (calls.where("event_id % 2 = 0"), calls.where("event_id % 2 = 1")):
        ledger = rendering.store_call(ledger, F.col("day"), F.col("cost"), part)
    return ledger


@query("""SELECT event_id, user_id % 7 AS first FROM events WHERE event_id % 3 <> 0 AND ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR""")
def cached_rankings(spark, d):
    """Cached answers that are fresh and well-formed: a corrupt entry is a miss."""
    body = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"ids": ['), F.col("user_id") % 7, F.lit(", 2]}")))
    entries = load(spark, d, "events").select("event_id", "ts", body.alias("entry"))
    hits = rendering.cached(entries, "ts", "entry", 24, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return hits.select("event_id", F.get("ids", F.lit(0)).alias("first"))


@query("""x AS (SELECT id FROM cat WHERE source_object = 'src1') SELECT count(*) AS total, (SELECT count(*) FROM cat) AS read FROM x""", True)
def progress_counts(spark, d):
    """What a scan tells of its rows while it runs, and how many its answer has."""
    seen = Observation("read")
    rows = catalog(spark, d).observe(seen, F.count("*").alias("read")).where("source_object = 'src1'")
    total = rows.agg(F.count("*").alias("total")).first().total
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(seen.get["read"]).cast("long").alias("read"))
