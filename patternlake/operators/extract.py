"""Extractors: metadata files to pattern rows.

XML of fixed shape is read by from_xml and sources by regular expressions, both as column
expressions. Flows, whose elements keep whatever they hold, are read by a small
function over their tree, and one Arrow step anonymizes and hashes all structures.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import vocab
from ..functions import terms
from ..functions import text as T
from ..sources.metadata import object_of
from ..sources.store import written

ROW = (
    "pattern_type string, category string, name string, description string, source_object string, structure string, field_references array<string>, "
    "api_version string, complexity_score int, tags array<string>, source_hash string, source_file string, path string"
)
_STRINGS = "array<string>"


def _value(raw: Column, default: Column | str = "") -> Column:
    """Stripped text of a child; the default where it is missing or empty, but not where it is blank."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(raw.isNull() | (raw == ""), default).otherwise(F.regexp_replace(raw, r"^\s+|\s+$", ""))


def _xml(files: DataFrame, kind: str, schema: str) -> DataFrame:
    """The files of a type with x, their parsed tree; what isn't well-formed is left out. Files are dealt anew, as they may lie in one split."""
    options = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "bad"}
    parsed = files.where(F.col("file_type") == kind).repartition("path").withColumn("x", F.from_xml("content", f"{schema}, bad string", options))
    return parsed.where("x IS NOT NULL AND x.bad IS NULL")


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array())


def _is(raw: Column) -> Column:
    return _value(raw, "false") == "true"


def _rows(files: DataFrame, kind: str, category: str, *, name, description, source_object, structure, refs, score, api_version=None, extra_tags=()) -> DataFrame:
    api = F.lit("") if api_version is None else api_version
    tags = F.concat(T.auto_tags(F.lit(kind), F.lit(category), source_object, api, score), *extra_tags)
    return files.select(
        F.lit(kind).alias("pattern_type"),
        F.lit(category).alias("category"),
        name.alias("name"),
        description.alias("description"),
        source_object.alias("source_object"),
        F.to_json(structure, {"ignoreNullFields": "true"}).alias("structure"),
        refs.cast(_STRINGS).alias("field_references"),
        api.alias("api_version"),
        score.cast("int").alias("complexity_score"),
        tags.cast(_STRINGS).alias("tags"),
        "source_hash",
        F.col("name").alias("source_file"),
        "path",
    )


def _tag_if(condition: Column, tag: Column | str) -> Column:
    return F.when(condition, F.array(F.lit(tag) if isinstance(tag, str) else tag)).otherwise(F.array().cast(_STRINGS))


def _stem(suffix: str) -> Column:
    return F.regexp_replace("name", re.escape(suffix) + "$", "")


def validations(files: DataFrame) -> DataFrame:
    rows = _xml(files, "validation", "fullName string, active string, errorConditionFormula string, errorDisplayField string")
    rows = rows.select(
        "*",
        _value(F.col("x.fullName"), _stem(".xml")).alias("full"),
        _is(F.col("x.active")).alias("active"),
        _value(F.col("x.errorConditionFormula")).alias("f"),
        object_of(F.col("path")).alias("object"),
    )
    f, some = F.col("f"), F.col("f") != ""
    rows = rows.select(
        "*",
        F.when(some, T.formula_functions(f)).otherwise(F.array().cast(_STRINGS)).alias("functions"),
        F.when(some, T.condition_count(f)).otherwise(0).alias("conditions"),
        F.when(some, T.nesting_depth(f)).otherwise(0).alias("depth"),
        T.formula_fields(f).alias("refs"),
    )
    analysis = F.struct(
        F.col("functions").alias("functions_used"),
        F.col("conditions").alias("condition_count"),
        F.col("depth").alias("nesting_depth"),
        F.when(some, f.contains("$Permission")).alias("uses_permissions"),
        F.when(some, f.contains("RecordType")).alias("uses_record_type"),
        F.when(some, f.contains("$Profile") | f.contains("$UserRole")).alias("uses_profile"),
        F.when(some, F.array().cast(_STRINGS)).alias("operators"),
    )
    state = F.when(F.col("active"), "Active").otherwise("Inactive")
    told = F.concat_ws(
        " ",
        F.concat(state, F.lit(" validation rule")),
        F.when(F.col("object") != "Unknown", F.concat(F.lit("on "), "object")),
        F.when(F.size("functions") > 0, F.concat(F.lit("using "), F.array_join(F.slice("functions", 1, 5), ", "))),
        F.when(F.col("depth") > 3, F.concat(F.lit("(deeply nested: "), F.col("depth").cast("string"), F.lit(" levels)"))),
    )
    return _rows(
        rows,
        "validation_rule",
        "Data Validation",
        name=F.concat(F.lit("Validation: "), T.readable(F.col("full"))),
        description=F.concat(told, F.lit(".")),
        source_object=F.col("object"),
        structure=F.struct("active", analysis.alias("formulaPattern"), f.alias("rawFormula"), _value(F.col("x.errorDisplayField")).alias("errorDisplayField"), F.size("refs").alias("fieldCount")),
        refs=F.col("refs"),
        score=T.complexity({"conditions": F.col("conditions"), "nesting_depth": F.col("depth"), "formulas": F.lit(1), "fields": F.size("refs")}),
        extra_tags=(_tag_if(F.col("active"), "active"), F.transform("functions", lambda x: F.concat(F.lit("func:"), F.lower(x)))),
    )


def objects(files: DataFrame) -> DataFrame:
    keys = ("sharingModel", "deploymentStatus", "enableActivities", "enableHistory", "enableReports", "enableSearch")
    rows = _xml(files, "object", ", ".join(f"{k} string" for k in keys) + ", nameField struct<type:string>, actionOverrides array<struct<actionName:string,type:string>>")
    chosen = F.filter(_list(F.col("x.actionOverrides")), lambda o: (_value(o["actionName"]) != "") & (_value(o["type"]) != "Default"))
    overrides = F.array_sort(F.array_distinct(F.transform(chosen, lambda o: F.concat(_value(o["actionName"]), F.lit(":"), _value(o["type"])))))
    rows = rows.select("*", _stem(".object-meta.xml").alias("object"), overrides.alias("overrides"))
    structure = F.struct(
        F.col("object").alias("objectName"), *[_value(F.col(f"x.{k}")).alias(k) for k in keys], _value(F.col("x.nameField.type")).alias("nameFieldType"), F.col("overrides").alias("actionOverrides")
    )
    return _rows(
        rows,
        "object_definition",
        "Data Model",
        name=F.concat(F.lit("Object: "), "object"),
        description=F.concat(F.lit("Custom object definition for "), "object", F.lit(".")),
        source_object=F.col("object"),
        structure=structure,
        refs=F.array("object"),
        score=T.complexity({"elements": F.size("overrides") + 1}),
    )


def fields(files: DataFrame) -> DataFrame:
    keys = "fullName type required unique externalId length precision scale defaultValue formula formulaTreatBlanksAs referenceTo relationshipName deleteConstraint".split()
    rows = _xml(files, "field", ", ".join(f"{k} string" for k in keys) + ", valueSet struct<restricted:string,valueSetName:string,valueSetDefinition:string>")
    x = {k: _value(F.col(f"x.{k}")) for k in keys}
    rows = rows.select("*", _value(F.col("x.fullName"), _stem(".field-meta.xml")).alias("full"), _value(F.col("x.type"), "Unknown").alias("kind"), object_of(F.col("path")).alias("object"), x["referenceTo"].alias("to"), x["formula"].alias("formula"))
    given = lambda c: F.when(c != "", c)
    formula, lookup, known = F.col("formula") != "", F.col("to") != "", F.col("object") != "Unknown"
    picklist = F.col("x.valueSet").isNotNull()
    structure = F.struct(
        F.col("full").alias("fieldName"),
        F.col("kind").alias("type"),
        *[_is(F.col(f"x.{k}")).alias(k) for k in ("required", "unique", "externalId")],
        *[given(x[k]).alias(k) for k in ("length", "precision", "scale")],
        F.when(x["defaultValue"] != "", True).alias("hasDefaultValue"),
        F.when(formula, True).alias("isFormula"),
        F.when(formula, x["formulaTreatBlanksAs"]).alias("formulaReturnType"),
        *[F.when(lookup, x[k]).alias(k) for k in ("referenceTo", "relationshipName", "deleteConstraint")],
        F.when(picklist, True).alias("hasPicklist"),
        F.when(picklist, _is(F.col("x.valueSet.restricted"))).alias("picklistRestricted"),
    )
    full = F.when(known, F.concat_ws(".", "object", "full")).otherwise(F.col("full"))
    told = F.concat_ws(" ", F.concat("kind", F.lit(" field")), F.when(known, F.concat(F.lit("on "), "object")), F.when(lookup, F.concat(F.lit("(lookup to "), "to", F.lit(")"))))
    return _rows(
        rows,
        "field_definition",
        "Data Model",
        name=F.concat(F.lit("Field: "), full),
        description=F.concat(told, F.lit(".")),
        source_object=F.col("object"),
        structure=structure,
        refs=F.concat(F.array(full), _tag_if(lookup, F.col("to"))),
        score=T.complexity({"fields": F.lit(1), "formulas": formula.cast("int")}),
        extra_tags=(F.array(F.concat(F.lit("type:"), F.lower("kind"))), _tag_if(formula, "formula-field"), _tag_if(lookup, "lookup")),
    )


def reports(files: DataFrame) -> DataFrame:
    group = "array<struct<field:string,dateGranularity:string,sortOrder:string>>"
    formula = "array<struct<label:string,formulaType:string,formula:string>>"
    rows = _xml(
        files,
        "report",
        "name string, reportType string, format string, apiVersion string, columns array<struct<field:string,aggregateTypes:string>>, "
        "filter array<struct<criteriaItems:array<struct<column:string,operator:string,snapshot:string>>,booleanFilter:string>>, "
        f"groupingsDown {group}, groupingsAcross {group}, customDetailFormulas {formula}, customSummaryFormulas {formula}, "
        "chart struct<chartType:string,enableHoverLabels:string,legendPosition:string>",
    )
    v = lambda s, *names: F.struct(*[_value(s[n]).alias(n) for n in names])
    columns = F.filter(
        F.transform(_list(F.col("x.columns")), lambda c: F.struct(_value(c["field"]).alias("field"), _value(c["aggregateTypes"]).alias("aggregate"))), lambda c: c["field"] != ""
    )
    null = F.lit(None).cast("string")

    def conditions(f: Column) -> Column:
        items = F.transform(_list(f["criteriaItems"]), lambda c: F.struct(*[_value(c[n]).alias(n) for n in ("column", "operator", "snapshot")], null.alias("booleanFilter")))
        whole = F.struct(*[null.alias(n) for n in ("column", "operator", "snapshot")], _value(f["booleanFilter"]).alias("booleanFilter"))
        return F.concat(items, F.when(_value(f["booleanFilter"]) != "", F.array(whole)).otherwise(F.filter(F.array(whole), lambda _: F.lit(False))))

    names = ("field", "dateGranularity", "sortOrder")
    down = F.transform(_list(F.col("x.groupingsDown")), lambda g: F.struct(*[_value(g[n]).alias(n) for n in names], null.alias("direction")))
    across = F.transform(_list(F.col("x.groupingsAcross")), lambda g: F.struct(*[_value(g[n]).alias(n) for n in names], F.lit("across").alias("direction")))
    formulas = F.transform(F.concat(_list(F.col("x.customDetailFormulas")), _list(F.col("x.customSummaryFormulas"))), lambda f: v(f, "label", "formulaType", "formula"))
    chart = F.col("x.chart").isNotNull()
    rows = rows.select(
        "*",
        _value(F.col("x.name"), _stem(".xml")).alias("title"),
        _value(F.col("x.reportType"), "Unknown").alias("kind"),
        _value(F.col("x.format"), "Tabular").alias("fmt"),
        _value(F.col("x.apiVersion")).alias("api"),
        columns.alias("cols"),
        F.flatten(F.transform(_list(F.col("x.filter")), conditions)).alias("conds"),
        F.concat(down, across).alias("groups"),
        formulas.alias("formulas"),
        chart.alias("charted"),
    )
    structure = F.struct(
        F.col("kind").alias("reportType"),
        F.col("fmt").alias("format"),
        F.size("cols").alias("columnCount"),
        F.col("cols").alias("columns"),
        F.size("conds").alias("filterCount"),
        F.col("conds").alias("filters"),
        F.col("groups").alias("groupings"),
        F.col("formulas").alias("customFormulas"),
        F.when(F.col("charted"), F.struct(*[_value(F.col(f"x.chart.{n}")).alias(n) for n in ("chartType", "enableHoverLabels", "legendPosition")]))
        .otherwise(F.struct(*[null.alias(n) for n in ("chartType", "enableHoverLabels", "legendPosition")]))
        .alias("chart"),
    )
    told = F.concat_ws(
        ", ",
        F.concat("fmt", F.lit(" report on "), "kind"),
        F.concat(F.lit("with "), F.size("cols").cast("string"), F.lit(" columns")),
        F.when(F.size("groups") > 0, F.concat(F.size("groups").cast("string"), F.lit(" groupings"))),
        F.when(F.size("formulas") > 0, F.concat(F.size("formulas").cast("string"), F.lit(" custom formulas"))),
    )
    refs = F.concat(F.col("cols")["field"], F.col("groups")["field"], F.col("conds")["column"])
    return _rows(
        rows,
        "report_definition",
        "Reporting",
        name=F.concat(F.lit("Report: "), F.replace("title", F.lit("_"), F.lit(" "))),
        description=F.concat(told, F.lit(".")),
        source_object=F.col("kind"),
        structure=structure,
        refs=F.array_sort(F.array_distinct(F.filter(refs, lambda r: r.isNotNull() & (r != "")))),
        score=T.complexity({"fields": F.size("cols"), "conditions": F.size("conds"), "formulas": F.size("formulas"), "elements": F.size("groups") + F.col("charted").cast("int")}),
        api_version=F.col("api"),
        extra_tags=(F.array(F.concat(F.lit("format:"), F.lower("fmt"))), _tag_if(F.col("charted"), "has-chart"), _tag_if(F.size("formulas") > 0, "custom-formulas")),
    )


def layouts(files: DataFrame) -> DataFrame:
    rows = _xml(
        files,
        "layout",
        "layoutSections array<struct<label:string,style:string,layoutColumns:array<struct<layoutItems:array<struct<behavior:string,field:string>>>>>>, "
        "relatedLists array<struct<relatedList:string,fields:array<string>>>, quickActionList array<struct<quickActionListItems:array<struct<quickActionName:string>>>>",
    )

    def section(s: Column) -> Column:
        items = F.flatten(F.transform(_list(s["layoutColumns"]), lambda c: _list(c["layoutItems"])))
        inside = F.filter(F.transform(items, lambda i: F.struct(_value(i["field"]).alias("field"), _value(i["behavior"]).alias("behavior"))), lambda i: i["field"] != "")
        return F.struct(_value(s["label"]).alias("label"), _value(s["style"]).alias("style"), F.size(_list(s["layoutColumns"])).alias("columnCount"), F.size(inside).alias("fieldCount"), inside.alias("fields"))

    lists = F.transform(_list(F.col("x.relatedLists")), lambda r: F.struct(_value(r["relatedList"]).alias("relatedList"), F.filter(_list(r["fields"]), lambda f: f != "").alias("fields")))
    actions = F.transform(F.flatten(F.transform(_list(F.col("x.quickActionList")), lambda q: _list(q["quickActionListItems"]))), lambda q: _value(q["quickActionName"]))
    stem = _stem(".layout-meta.xml")
    dashed = stem.contains("-")
    rows = rows.select(
        "*",
        F.when(dashed, F.substring_index(stem, "-", 1)).otherwise("Unknown").alias("object"),
        F.when(dashed, F.regexp_replace(stem, "^[^-]*-", "")).otherwise(stem).alias("shown"),
        F.transform(_list(F.col("x.layoutSections")), section).alias("sections"),
        lists.alias("lists"),
        actions.alias("actions"),
    )
    refs = F.flatten(F.transform("sections", lambda s: s["fields"]["field"]))
    n = F.size(refs)
    return _rows(
        rows,
        "layout_definition",
        "Page Layout",
        name=F.concat(F.lit("Layout: "), "object", F.lit(" - "), F.replace("shown", F.lit("_"), F.lit(" "))),
        description=F.concat(F.lit("Page layout for "), "object", F.lit(" with "), F.size("sections").cast("string"), F.lit(" sections and "), n.cast("string"), F.lit(" fields.")),
        source_object=F.col("object"),
        structure=F.struct(
            F.size("sections").alias("sectionCount"), "sections", F.col("lists").alias("relatedLists"), F.filter("actions", lambda a: a != "").alias("quickActions"), n.alias("totalFields")
        ),
        refs=F.array_sort(F.array_distinct(refs)),
        score=T.complexity({"fields": n, "elements": F.size("sections") + F.size("lists")}),
        extra_tags=(_tag_if(F.size("lists") > 0, "has-related-lists"), _tag_if(F.size("actions") > 0, "has-quick-actions")),
    )


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def _pairs(text: Column, pattern: str, names: dict[str, int]) -> Column:
    """A struct of groups for each match."""
    return F.transform(_all(text, pattern, 0), lambda m: F.struct(*[F.regexp_extract(m, "(?U)" + pattern, g).alias(n) for n, g in names.items()]))


def components(files: DataFrame) -> DataFrame:
    """UI components: a script with the template and settings beside it, in the same folder of the same source."""
    folder = F.struct(F.coalesce("source_hash", F.lit("")).alias("source"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    scripts = files.where("file_type = 'lwc'").where(~F.col("path").contains("__tests__") & (F.col("content") != "")).select("*", folder.alias("folder"), _stem(".js").alias("component"))
    beside = files.where("file_type IS NULL").select(folder.alias("folder"), F.col("name").alias("beside"), F.col("content").alias("text"))
    pages = beside.select("folder", F.regexp_replace("beside", r"\.html$", "").alias("component"), F.col("text").alias("html")).where(F.col("beside").endswith(".html"))
    metas = beside.select("folder", F.regexp_replace("beside", r"\.js-meta\.xml$", "").alias("component"), F.col("text").alias("meta")).where(F.col("beside").endswith(".js-meta.xml"))
    on = ["folder", "component"]
    # merged, as paths and like pages shrink so well when stored that Spark takes them for small tables and sends them to the driver
    rows = scripts.join(pages.hint("merge"), on, "left").join(metas.hint("merge"), on, "left")
    js, html, meta = F.col("content"), F.coalesce("html", F.lit("")), F.coalesce("meta", F.lit(""))
    hooks = F.filter(F.array(*map(F.lit, ("connectedCallback", "disconnectedCallback", "renderedCallback", "errorCallback"))), lambda h: F.contains(js, h))
    rows = rows.select(
        "*",
        F.struct(
            _all(js, r"@api\s+(\w+)").alias("api_properties"),
            _all(js, r"@track\s+(\w+)").alias("tracked_properties"),
            _all(js, r"@wire\((\w+)(?:,\s*\{[^}]*\})?\)").alias("wire_adapters"),
            _pairs(js, r"import\s+(\w+)\s+from\s+['\"]@salesforce/apex/(\w+\.\w+)['\"]", {"localName": 1, "method": 2}).alias("apex_calls"),
            _all(js, r"(handle\w+)\s*\(").alias("event_handlers"),
            js.contains("NavigationMixin").alias("navigation"),
            js.contains("ShowToastEvent").alias("toast"),
            hooks.alias("lifecycle_hooks"),
            _all(js, r"import\s+\w+\s+from\s+['\"]@salesforce/schema/(\w+\.\w+)['\"]").alias("field_references"),
        ).alias("js"),
        F.when(
            html != "",
            F.struct(
                F.array_distinct(_all(html, r"<(c-\w+|lightning-\w+)")).alias("child_components"),
                _all(html, r"(?:if:true|if:false|lwc:if|lwc:elseif)=\{([^}]+)\}").alias("conditionals"),
                _all(html, r"for:each=\{([^}]+)\}").alias("iterations"),
                html.contains("<slot").alias("slots"),
                (html.contains("lightning-input") | html.contains("lightning-combobox")).alias("forms"),
            ),
        ).alias("page"),
        F.when(
            meta != "",
            F.struct(
                F.regexp_extract(meta, r"<apiVersion>([\d.]+)</apiVersion>", 1).alias("apiVersion"),
                meta.contains("<isExposed>true</isExposed>").alias("isExposed"),
                F.transform(_all(meta, r"<target>([\w:]+)</target>"), lambda t: F.substring_index(t, "__", -1)).alias("targets"),
                F.coalesce(F.nullif(F.regexp_extract(meta, r"(?U)<objects>\s*<object>(\w+)</object>", 1), F.lit("")), F.lit("Unknown")).alias("primaryObject"),
            ),
        ).alias("settings"),
    )
    empty = F.array().cast(_STRINGS)
    targets, children = F.coalesce("settings.targets", empty), F.coalesce("page.child_components", empty)
    n = {k: F.size(f"js.{k}") for k in ("api_properties", "wire_adapters", "apex_calls")}
    count = lambda c, what: F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {what}")))
    features = F.concat_ws(", ", count(n["wire_adapters"], "wire adapters"), count(n["apex_calls"], "Apex calls"), count(n["api_properties"], "@api props"), count(F.size(children), "child components"))
    told = F.concat_ws(
        " ",
        F.lit("Lightning Web Component"),
        F.when(F.size(targets) > 0, F.concat(F.lit("for "), F.array_join(F.slice(targets, 1, 3), ", "))),
        F.when(features != "", F.concat(F.lit("with "), features)),
    )
    spaced = F.initcap(F.trim(F.regexp_replace("component", "([A-Z])", " $1")))
    return _rows(
        rows,
        "lwc_component",
        "UI Component",
        name=F.concat(F.lit("LWC: "), spaced),
        description=F.concat(told, F.lit(".")),
        source_object=F.coalesce("settings.primaryObject", F.lit("Unknown")),
        structure=F.struct(F.col("component").alias("componentName"), "js", F.col("page").alias("html"), F.col("settings").alias("meta")),
        refs=F.col("js.field_references"),
        score=T.complexity(
            {
                "fields": n["api_properties"],
                "elements": n["wire_adapters"] + n["apex_calls"] + F.size(children),
                "conditions": F.size(F.coalesce("page.conditionals", empty)),
                "loops": F.size(F.coalesce("page.iterations", empty)),
            }
        ),
        api_version=F.coalesce("settings.apiVersion", F.lit("")),
        extra_tags=(
            _tag_if(n["wire_adapters"] > 0, "uses-wire"),
            _tag_if(n["apex_calls"] > 0, "calls-apex"),
            _tag_if(F.col("js.navigation"), "uses-navigation"),
            F.transform(targets, lambda t: F.concat(F.lit("target:"), t)),
        ),
    )


# Fixed values. What is read of a class, and of its methods.
_CLASS = (
    r"(public|private|global)\s+(?:(?:virtual|abstract|with sharing|without sharing|inherited sharing)\s+)*class\s+\w+\s*"
    r"(?:extends\s+(\w+))?\s*(?:implements\s+([\w\s,]+))?\s*\{"
)
_METHOD = r"(public|private|global|protected)\s+(?:static\s+)?(\w+(?:<[\w,\s]+>)?)\s+(\w+)\s*\(([^)]*)\)"


def classes(files: DataFrame) -> DataFrame:
    rows = files.where("file_type = 'apex'").where(F.col("content") != "").select("*", _stem(".cls").alias("class"))
    text = F.col("content")
    part = lambda k: F.regexp_extract(text, "(?U)" + _CLASS, k)
    notes = F.array_distinct(_all(text, r"@(\w+)(?:\([^)]*\))?"))
    methods = F.transform(
        _all(text, _METHOD, 0),
        lambda m: F.struct(
            *[F.regexp_extract(m, "(?U)" + _METHOD, k).alias(n) for n, k in (("access", 1), ("returnType", 2), ("name", 3))],
            F.size(F.filter(F.split(F.regexp_extract(m, "(?U)" + _METHOD, 4), ","), lambda p: F.trim(p) != "")).alias("paramCount"),
        ),
    )
    queried = F.regexp_extract_all(text, F.lit(r"(?Ui)\[SELECT\s+.+?\s+FROM\s+(\w+)"), F.lit(1))
    changes = F.array_compact(F.array(*[F.when(text.rlike(rf"(?Ui)\b{op}\s+\w+"), F.lit(op)) for op in ("insert", "update", "upsert", "delete", "undelete", "merge")]))
    rows = rows.select(
        "*",
        F.coalesce(F.nullif(part(1), F.lit("")), F.lit("public")).alias("access"),
        part(2).alias("parent"),
        part(3).alias("wanted"),
        notes.alias("notes"),
        methods.alias("methods"),
        queried.alias("queried"),
        F.array_distinct(queried).alias("objects"),
        changes.alias("changes"),
    )
    rows = rows.select(
        "*",
        (F.array_contains("notes", "isTest") | F.array_contains("notes", "IsTest") | F.lower("content").contains("testmethod")).alias("test"),
        F.when(F.col("wanted") != "", F.transform(F.split("wanted", ","), lambda i: F.trim(i))).otherwise(F.array().cast(_STRINGS)).alias("interfaces"),
        F.col("wanted").contains("Database.Batchable").alias("batch"),
        F.col("wanted").contains("Schedulable").alias("timed"),
        F.array_contains("notes", "RestResource").alias("rest"),
        (text.contains("TriggerHandler") | F.lower("class").contains("trigger")).alias("handler"),
    ).where(~(F.col("test") & (F.size("methods") == 0)))
    structure = F.struct(
        F.col("class").alias("className"),
        F.lit("standard").alias("classType"),
        F.col("access").alias("accessModifier"),
        F.col("notes").alias("annotations"),
        "interfaces",
        F.col("parent").alias("extends"),
        "methods",
        F.transform("queried", lambda o: F.struct(o.alias("object"))).alias("soqlPatterns"),
        F.col("changes").alias("dmlOperations"),
        F.col("objects").alias("objectsReferenced"),
        F.col("test").alias("isTest"),
        F.col("batch").alias("isBatch"),
        F.col("timed").alias("isSchedulable"),
        F.col("handler").alias("isTriggerHandler"),
        F.array_contains("notes", "AuraEnabled").alias("isAuraEnabled"),
        F.col("rest").alias("isRestResource"),
    )
    role = (
        F.when(F.col("test"), "Test class")
        .when(F.col("batch"), "Batch Apex class")
        .when(F.col("timed"), "Schedulable Apex class")
        .when(F.col("rest"), "REST API resource class")
        .when(F.col("handler"), "Trigger handler class")
        .otherwise(F.concat(F.initcap("access"), F.lit(" Apex class")))
    )
    told = F.concat_ws(
        " ",
        role,
        F.when(F.size("methods") > 0, F.concat(F.lit("with "), F.size("methods").cast("string"), F.lit(" methods"))),
        F.when(F.size("objects") > 0, F.concat(F.lit("operating on "), F.array_join(F.slice("objects", 1, 3), ", "))),
    )
    return _rows(
        rows,
        "apex_class",
        "Apex Logic",
        name=F.concat(F.lit("Apex: "), "class"),
        description=F.concat(told, F.lit(".")),
        source_object=F.coalesce(F.get("objects", F.lit(0)), F.lit("Unknown")),
        structure=structure,
        refs=F.col("objects"),
        score=T.complexity({"elements": F.size("methods"), "conditions": F.size("queried"), "record_ops": F.size("changes")}),
        extra_tags=(
            F.transform("notes", lambda a: F.concat(F.lit("annotation:"), F.lower(a))),
            _tag_if(F.col("batch"), "batch"),
            _tag_if(F.col("timed"), "schedulable"),
            _tag_if(F.col("rest"), "rest-api"),
        ),
    )


# Flows ----------------------------------------------------------------------------------------

# Fixed values. Element tags in order, the types they make, and what descriptions call them.
FLOW_ELEMENTS = {
    "decisions": ("flow_decision", "Decision", "decisions"),
    "recordLookups": ("flow_record_lookup", "Recordlookup", "Record Lookup"),
    "recordUpdates": ("flow_record_update", "Recordupdate", "Record Update"),
    "recordCreates": ("flow_record_create", "Recordcreate", "Record Create"),
    "recordDeletes": ("flow_record_delete", "Recorddelete", "Record Delete"),
    "screens": ("flow_screen", "Screen", "screens"),
    "assignments": ("flow_assignment", "Assignment", "assignments"),
    "loops": ("flow_loop", "Loop", "loops"),
    "actionCalls": ("flow_action_call", "Actioncall", "Action Call"),
    "subflows": ("flow_subflow", "Subflow", "subflows"),
    "formulas": ("flow_formula", "Formula", "formulas"),
    "collectionProcessors": ("flow_collection_processor", "Collectionprocessor", "collectionProcessors"),
}
RECORD_TAGS = ("recordLookups", "recordUpdates", "recordCreates", "recordDeletes")
CONNECTORS = (("connector", "next"), ("faultConnector", "fault"), ("rules", ""), ("defaultConnector", "default"), ("nextValueConnector", "loop_next"), ("noMoreValuesConnector", "loop_done"))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


#: An element's children by local name, in document order: each element's are looked through once.
Children = dict[str, list[ElementTree.Element]]


def _children(element: ElementTree.Element) -> Children:
    found: Children = {}
    for child in element:
        found.setdefault(child.tag.rpartition("}")[2], []).append(child)
    return found


def _text(children: Children, tag: str, default: str = "") -> str:
    text = children[tag][0].text if tag in children else None
    return text.strip() if text else default


def as_document(element: ElementTree.Element):
    """Leaves as stripped text, repeated tags as lists, attributes of inner nodes under @attrs."""
    if not len(element):
        return (element.text or "").strip()
    out = {"@attrs": dict(element.attrib)} if element.attrib else {}
    several = set()
    for child in element:
        tag, value = child.tag.rpartition("}")[2], as_document(child) if len(child) else (child.text or "").strip()
        if tag not in out:
            out[tag] = value
        elif tag in several:
            out[tag].append(value)
        else:
            several.add(tag)
            out[tag] = [out[tag], value]
    return out


def topology(elements: dict[str, list[Children]]) -> list[dict[str, str]]:
    """Edges from, to, type between the elements (their children, by tag), in tag order, then document order."""
    edges = []
    for element in (e for tag in FLOW_ELEMENTS for e in elements.get(tag, ())):
        start = _text(element, "name")
        for tag, kind in CONNECTORS if start else ():
            for holder in element.get(tag, ())[: None if tag == "rules" else 1]:
                inner = _children(holder)
                link = (_children(inner["connector"][0]) if "connector" in inner else {}) if tag == "rules" else inner
                target = next((t.text for t in link.get("targetReference", ()) if t.text), None)
                if target:
                    edges.append({"from": start, "to": target, "type": kind or f"rule:{_text(inner, 'name', 'unnamed')}"})
    return edges


def flow_object(root: ElementTree.Element, elements: dict[str, list[Children]]) -> str:
    """Of the start, else the commonest of record elements (first met among equals), else the first anywhere."""
    start = next((e for e in root.iter() if _local(e) == "start"), None)
    if start is not None and (found := _text(_children(start), "object")):
        return found
    counts = Counter(o for tag in RECORD_TAGS for e in elements.get(tag, ()) if (o := _text(e, "object")))
    if counts:
        return counts.most_common(1)[0][0]
    first: dict[str, str] = {}
    for e in root.iter():
        if e.text:
            first.setdefault(_local(e), e.text.strip())
    return next((first[tag] for tag in ("object", "objectType", "Object") if first.get(tag)), "Unknown")


def _score(**factors: float) -> int:
    total = sum(n * vocab.COMPLEXITY_WEIGHTS.get(k, 1) for k, n in factors.items())
    return 1 + sum(total > step for step in vocab.COMPLEXITY_STEPS)


def _tags(kind: str, category: str, source_object: str, api: str, score: int) -> list[str]:
    tags = [kind, category.lower().replace(" ", "-")]
    tags += [source_object.lower()] if source_object not in ("", "Unknown") else []
    tags += [f"api-v{api}"] if api else []
    return tags + ["complex"] * (score >= 4) + ["simple"] * (score <= 1)


def _element_score(element: Children, tag: str) -> int:
    n = lambda child: len(element.get(child, ()))
    factors: dict[str, float] = {"elements": 1}
    if tag == "decisions":
        factors |= {"decisions": 1, "conditions": sum(len(_children(r).get("conditions", ())) for r in element.get("rules", ()))}
    elif tag == "screens":
        factors |= {"screens": 1, "fields": n("fields")}
    elif tag in RECORD_TAGS:
        factors |= {"record_ops": 1, "conditions": n("filters"), "fields": n("inputAssignments")}
    elif tag == "loops":
        factors |= {"loops": 1}
    elif tag == "actionCalls":
        factors |= {"fields": n("inputParameters") + n("outputParameters")}
    return _score(**factors)


def _whole_flow(name: str, top: Children, inside: dict[str, list[Children]], api: str, main: str) -> dict:
    process, status, trigger = _text(top, "processType", "unknown"), _text(top, "status", "unknown"), _text(top, "recordTriggerType")
    counts = {tag: len(found) for tag, found in inside.items()}
    variables = []
    for v in map(_children, top.get("variables", ())):
        row = {k: _text(v, k) for k in ("name", "dataType")} | {k: _text(v, k) == "true" for k in ("isInput", "isOutput", "isCollection")}
        variables.append(row | ({"apexClass": a} if (a := _text(v, "apexClass")) else {}))
    structure = {"processType": process, "status": status, "triggerType": trigger, "runInMode": _text(top, "runInMode"), "elements": counts, "variables": variables, "topology": topology(inside)}
    score = _score(
        **{k: counts.get(k, 0) for k in ("decisions", "loops", "screens", "formulas", "subflows")}, record_ops=sum(counts.get(t, 0) for t in RECORD_TAGS), elements=sum(counts.values())
    )
    told = [(f"{trigger}-triggered " if trigger else "") + f"{process} flow"]
    told += [f"on {main}"] if main != "Unknown" else []
    told += ["with " + ", ".join(f"{n} {tag}" for tag, n in sorted(counts.items()))] if counts else []
    label = _text(top, "label", name.removesuffix(".xml")).replace("_", " ").strip()
    extra = [process.lower()] + ([trigger.lower()] if trigger else [])
    return {
        "pattern_type": "flow_full", "name": f"Flow: {label}", "description": ". ".join(told) + ".", "source_object": main, "structure": structure,
        "api_version": api, "complexity_score": score, "tags": _tags("flow_full", "Flow Logic", main, api, score) + extra,
    }


def flow_rows(content: str, name: str, elements: bool = True, whole: bool = True) -> list[dict]:
    """The whole flow and each of its elements, whichever is asked for; nothing for what isn't well-formed."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    top = _children(root)
    inside = {tag: [_children(e) for e in top[tag]] for tag in FLOW_ELEMENTS if tag in top}
    api, main = _text(top, "apiVersion", "unknown"), flow_object(root, inside)
    rows = [_whole_flow(name, top, inside, api, main)] if whole else []
    for tag, (kind, title, called) in FLOW_ELEMENTS.items() if elements else ():
        for element, held in zip(inside.get(tag, ()), top.get(tag, ()), strict=True):
            label = _text(element, "label", _text(element, "name", "unnamed"))
            document = as_document(held)
            document = {k: v for k, v in document.items() if k not in ("locationX", "locationY")} if isinstance(document, dict) else {}
            own = _text(element, "object") or main
            score = _element_score(element, tag)
            about = f"{called} on {own}: {label}" if own != "Unknown" else f"{called}: {label}"
            rows.append(
                {
                    "pattern_type": kind, "name": f"{title}: {label.replace('_', ' ').strip()}", "description": about, "source_object": own, "structure": document,
                    "api_version": api, "complexity_score": score, "tags": _tags(kind, "Flow Logic", own, api, score),
                }
            )
    return rows


def flows(files: DataFrame, elements: bool = True, whole: bool = True) -> DataFrame:
    """Whole flows and their elements, whichever is asked for. Files are dealt anew before Python reads them, as they may lie in one split."""
    names = [f.split()[0] for f in ROW.split(", ")]
    kinds = {"field_references": pa.list_(pa.string()), "tags": pa.list_(pa.string()), "complexity_score": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in names}
            for path, name, content, source in zip(*[batch[c].to_pylist() for c in ("path", "name", "content", "source_hash")]):
                for row in flow_rows(content or "", name, elements, whole):
                    structure = row["structure"]
                    row |= {"category": "Flow Logic", "structure": json.dumps(structure), "field_references": structure_fields(structure), "source_hash": source, "source_file": name, "path": path}
                    for n in names:
                        columns[n].append(row[n])
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.string())) for n in names], names)

    read = files.where("file_type = 'flow'").select("path", "name", "content", "source_hash")
    return read.repartition("path").mapInArrow(run, ROW)


def edges(flows: DataFrame) -> DataFrame:
    """source_hash, source_file, from, to and type of the edges between the elements of whole flows."""
    found = F.from_json("structure", "topology array<struct<from:string,to:string,type:string>>")["topology"]
    return flows.where("pattern_type = 'flow_full'").select("source_hash", "source_file", F.explode(found).alias("e")).select("source_hash", "source_file", "e.*")


def structure_fields(document) -> list[str]:
    """Field references among the strings of a document, sorted."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, str):
            if "__c" in x or "__r" in x:
                found.update(p for p in x.split(".") if "__c" in p or "__r" in p)
            if x.count(".") == 1 and x[0] != "$" and x[x.index(".") + 1 :][:1].isupper():
                found.add(x)
        elif isinstance(x, dict):
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(document)
    return sorted(found)


# Anonymizing and hashing ------------------------------------------------------------------------

# Fixed values. Keys under which texts are replaced by their lengths.
CONTENT_KEYS = frozenset("errorMessage description label helpText inputText outputText choiceText interviewLabel".split())
_PATTERNS = [(re.compile(pattern), mark) for pattern, mark in T.SCRUBS]


class Scrubber:
    """Anonymizes strings and documents; `labels` gives brand terms their labels."""

    def __init__(self, labels: dict[str, str]):
        self.labels = {k.lower(): v for k, v in labels.items()}
        known = [t for t in labels if t]
        self.brands = re.compile(terms.trie_pattern(known)) if known else None

    def text(self, value: str) -> str:
        if len(value) < 3:
            return value
        for pattern, mark in _PATTERNS:
            value = pattern.sub(mark, value)
        return self.brands.sub(lambda m: self.labels.get(m[0].lower(), "[BRAND]"), value) if self.brands else value

    def document(self, x, key: str = ""):
        if isinstance(x, str):
            return f"[{key.upper()}:{len(x)}chars]" if key in CONTENT_KEYS else self.text(x)
        if isinstance(x, dict):
            return {k: self.document(v, k) for k, v in x.items()}
        return [self.document(v, key) for v in x] if isinstance(x, list) else x


def content_hash(kind: str, source_object: str, structure) -> str:
    canonical = json.dumps({"t": kind, "o": source_object, "s": structure}, sort_keys=True)
    return hashlib.sha256(canonical.encode()).hexdigest()[:16]


#: Rows of a source that one task scrubs, and the most terms of a table that is sent to all tasks.
SHARE_ROWS, MOST_TERMS = 50_000, 100_000


def _dealt(rows: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` in shares of a source, each in one task behind a row that has only the source and its table, `labels_`.

    So a table goes once to a share, not with every row. `sizes` (source_hash, n) tells how many shares a source
    gets; a source of any size is split. Of terms that are equal but for case the least counts; sources
    without terms get no table, and rows without source are spread.
    """
    names = rows.columns
    once = labels.where("term <> ''").groupBy("source_hash", F.lower("term").alias("low")).agg(F.min(F.struct("term", "label")).alias("x"))
    tables = once.groupBy("source_hash").agg(F.map_from_entries(F.collect_list("x")).alias("labels_"))
    # written, so that Spark knows its size and decides by it whether to broadcast
    shares = written(sizes.select("source_hash", F.ceil(F.col("n") / SHARE_ROWS).alias("shares_")), "shares")
    first = tables.join(shares, "source_hash").select("source_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares_") - 1)).alias("share_"), "labels_")
    spot = F.pmod(F.xxhash64("path", "name", "pattern_type"), F.coalesce("shares_", F.lit(1024).cast("long")))
    both = rows.join(shares, "source_hash", "left").select(*names, spot.alias("share_")).unionByName(first, allowMissingColumns=True)
    return both.repartition("source_hash", "share_").sortWithinPartitions("source_hash", "share_", F.col("labels_").isNull()).drop("share_")


def finished(rows: DataFrame, labels: dict[str, str] | DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Scrubbed rows with content_hash.

    `labels` is one project's small table of brand terms, or a DataFrame (source_hash, term, label) of those of
    several, of which each row meets its own source's. `sizes` (source_hash, n) has for these about how many rows each source
    has; it is counted where it isn't given.
    """
    names = rows.columns
    if isinstance(labels, DataFrame):
        rows, shared = _dealt(rows, labels, rows.groupBy("source_hash").agg(F.count("*").alias("n")) if sizes is None else sizes), None
    elif len(labels) > MOST_TERMS:
        raise ValueError(f"{len(labels)} terms: give more than {MOST_TERMS} as a DataFrame (source_hash, term, label)")
    else:
        shared = rows.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, of = Scrubber(shared.value if shared else {}), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if shared is None:
                    table = row.pop("labels_")
                    if row["source_hash"] != of:
                        clean, of = Scrubber(dict(table or ())), row["source_hash"]
                    if table is not None:
                        continue
                structure = clean.document(json.loads(row["structure"]))
                if row["pattern_type"] == "lwc_component":  # parts that a bundle lacks are empty, not missing
                    structure = {"html": {}, "meta": {}} | structure
                for k in ("name", "description", "source_object"):
                    row[k] = clean.text(row[k])
                for k in ("field_references", "tags"):
                    row[k] = [clean.text(x) for x in row[k]]
                row["content_hash"] = content_hash(row["pattern_type"], row["source_object"], structure)
                out.append(row | {"structure": json.dumps(structure, sort_keys=True)})
            kinds = {"field_references": pa.list_(pa.string()), "tags": pa.list_(pa.string()), "complexity_score": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds.get(n, pa.string())) for n in [*names, "content_hash"]], [*names, "content_hash"])

    return rows.mapInArrow(run, f"{ROW}, content_hash string")


def hashed(kind: pd.Series, source_object: pd.Series, structure: pd.Series) -> pd.Series:
    """content_hash of stored rows, whose structure is JSON text."""
    return pd.Series([content_hash(k, o, json.loads(s or "{}")) for k, o, s in zip(kind, source_object, structure, strict=True)], dtype="object")


#: By file type; a plug-in is another entry, from files to rows.
EXTRACTORS = {"flow": flows, "validation": validations, "object": objects, "field": fields, "report": reports, "layout": layouts, "lwc": components, "apex": classes}


def extract(files: DataFrame, labels: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """The finished rows of all files; these are read once and kept by type, so that each extractor reads its own."""
    files = written(files, "files", ("file_type",))
    every = reduce(DataFrame.unionByName, (f(files) for f in EXTRACTORS.values()))
    if not isinstance(labels, DataFrame):
        return finished(every, labels or {})
    return finished(every, labels, files.groupBy("source_hash").agg(F.count("*").alias("n")))


def watched(rows: DataFrame, progress: Observation) -> DataFrame:
    """`rows`, whose number, also by category, `progress` tells once they have been computed."""
    return rows.observe(progress, F.count("*").alias("rows"), *[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in vocab.CATEGORIES])
