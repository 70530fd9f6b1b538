"""Tool answers as text: each is a small table of blocks (part, place, text), to be read in this order.

The rows of an answer are a page, a few groups or one pattern, so that ordering them in one task is
bounded; whatever is counted or ranked before is not.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from . import stats

BLOCKS = "part int, place long, text string"


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _block(df: DataFrame, part: int, text: Column, order: list[Column] | None = None) -> DataFrame:
    place = F.lit(0).cast("long") if order is None else F.row_number().over(Window.orderBy(*order)).cast("long")
    return df.select(F.lit(part).alias("part"), place.alias("place"), text.alias("text"))


def _together(*blocks: DataFrame) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def as_text(blocks: DataFrame) -> str:
    """A whole answer, one string."""
    return "".join(r.text for r in blocks.orderBy("part", "place").collect())


def _indented(document: Column) -> Column:
    """JSON with two blanks a level, keys in their order; what isn't JSON as an empty object. For single rows."""
    return F.pandas_udf(_indent, "string")(document)


def _indent(document: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        try:
            return json.dumps(json.loads(x), indent=2)
        except (TypeError, ValueError):
            return "{}"

    return document.map(one)


def _key(catalog: DataFrame) -> list[Column]:
    return [F.desc("complexity_score"), F.col("name"), F.col("id")]


def search_answer(found: DataFrame, shown: DataFrame, query: str) -> DataFrame:
    """`shown` is a page of all rows `found`."""
    total = found.agg(F.count("*").alias("total")).crossJoin(shown.agg(F.count("*").alias("n")))
    none = _joined(f"No patterns found matching '{query}'. Try broader keywords or different filters.")
    head = _block(total, 0, F.when(F.col("n") == 0, none).otherwise(_joined("Found ", F.col("total"), " patterns (showing ", F.col("n"), "):\n\n")))
    row = _joined(
        "  [", F.col("id"), "] ", F.col("name"), "\n      Category: ", F.col("category"), " | Type: ", F.col("pattern_type"), "\n      Object: ", F.col("source_object"), " | Complexity: ",
        F.expr("repeat('*', complexity_score)"), "\n      ", F.substring("description", 1, 200), "\n      Tags: ", F.array_join(F.slice("tags", 1, 8), ", "), "\n\n",
    )
    return _together(head, _block(shown, 1, row, _key(shown)))


def detail_answer(catalog: DataFrame, pattern_id: int) -> DataFrame:
    """One pattern; that it was read is an event of `overlay.record`."""
    one = catalog.where(F.col("id") == pattern_id).limit(1)
    text = _joined(
        "Pattern #", F.col("id"), ": ", F.col("name"), "\n" + "=" * 60, "\nCategory:    ", F.col("category"), "\nType:        ", F.col("pattern_type"), "\nObject:      ", F.col("source_object"),
        "\nComplexity:  ", F.col("complexity_score"), "/5\nAPI Version: ", F.when(F.coalesce("api_version", F.lit("")) == "", "N/A").otherwise(F.col("api_version")), "\nSource File: ", F.col("source_file"),
        "\nUses:        ", F.col("use_count"), "\n\nDescription:\n", F.col("description"), "\n\nField References:\n", _indented(F.to_json("field_references")),
        "\n\nTags: ", F.array_join("tags", ", "), "\n\nStructure (JSON):\n", _indented(F.col("structure")), "\n",
    )
    return _together(_block(one, 0, text), _not_found(one, pattern_id))


def _not_found(one: DataFrame, pattern_id: int) -> DataFrame:
    return _block(one.agg(F.count("*").alias("n")).where("n = 0"), 0, F.lit(f"Pattern {pattern_id} not found."))


def category_answer(catalog: DataFrame, title: str) -> DataFrame:
    """Categories with their colours, and types, by count."""
    categories, types = stats.count_by(catalog, "category"), stats.count_by(catalog, "pattern_type")
    colour = F.lit("#888")
    for name, code in vocab.CATEGORY_COLORS.items():
        colour = F.when(F.col("category") == name, code).otherwise(colour)
    head = categories.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return _together(
        _block(head, 0, _joined(f"{title} - ", F.col("n"), " total patterns\n\nCategories:\n")),
        _block(categories, 1, _joined("  ", F.col("category"), ": ", F.col("n"), " patterns (", colour, ")\n"), [F.desc("n"), F.col("category")]),
        _block(head, 2, F.lit("\nPattern Types:\n")),
        _block(types, 3, _joined("  ", F.col("pattern_type"), ": ", F.col("n"), "\n"), [F.desc("n"), F.col("pattern_type")]),
    )


def statistics_answer(catalog: DataFrame, sources: DataFrame, title: str, objects: int = 15) -> DataFrame:
    """Counts by category, of the most frequent objects, by complexity; and the sources (display_name, pattern_count)."""
    categories, top, scores = stats.count_by(catalog, "category"), stats.count_by(catalog, "source_object", objects), stats.count_by(catalog, "complexity_score")
    head = categories.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    line = lambda c: _joined("  ", F.col(c), ": ", F.col("n"), "\n")
    shown = _joined("  ", F.col("complexity_score"), " (", T.complexity_label(F.col("complexity_score")), "): ", F.col("n"), "\n")
    known = sources.agg(F.count("*").alias("n"))
    return _together(
        _block(head, 0, _joined(f"{title}\n{'=' * 40}\nTotal Patterns: ", F.col("n"), "\n\nBy Category:\n")),
        _block(categories, 1, line("category"), [F.col("category")]),
        _block(head, 2, F.lit("\nTop Objects:\n")),
        _block(top, 3, line("source_object"), [F.desc("n"), F.col("source_object")]),
        _block(head, 4, F.lit("\nComplexity Distribution:\n")),
        _block(scores, 5, shown, [F.col("complexity_score")]),
        _block(known, 6, _joined("\nIngested Sources: ", F.col("n"), "\n")),
        _block(sources, 7, _joined("  ", F.col("display_name"), ": ", F.col("pattern_count"), " patterns\n"), [F.col("display_name"), F.col("pattern_count")]),
    )


def composition_answer(composed: DataFrame, requirement: str, target_object: str, categories: list[str]) -> DataFrame:
    """Rows of `search.compose` (category, place and the catalog's columns), category by category in the given order."""
    spark = composed.sparkSession
    asked = spark.createDataFrame([(requirement,)], "t string")
    head = _joined(f"Solution Blueprint: {requirement}\n{'=' * 60}\nTarget Object: {target_object}\nKeywords: ", F.array_join(T.keywords(F.col("t")), ", "), "\n\n")
    counts = composed.groupBy("category").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(c, 2 * k + 1) for k, c in enumerate(categories)], "category string, part int")
    named = wanted.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    none = F.when(F.col("n") == 0, "  No matching patterns found. Consider creating custom.\n").otherwise("")
    titles = named.select("part", F.lit(0).cast("long").alias("place"), _joined("\n--- ", F.col("category"), " (", F.col("n"), " patterns) ---\n", none).alias("text"))
    row = _joined(
        "\n  [", F.col("id"), "] ", F.col("name"), "\n      Object: ", F.col("source_object"), " | Complexity: ", F.col("complexity_score"), "/5\n      ",
        F.substring("description", 1, 150), "\n      Fields: ", F.array_join(F.slice("field_references", 1, 5), ", "), "\n",
    )
    rows = composed.join(wanted, "category").select((F.col("part") + 1).alias("part"), F.col("place").cast("long").alias("place"), row.alias("text"))
    end = (
        f"\n\nNext Steps:\n1. Use get_pattern(id) to retrieve full structure for each component\n2. Use generate_field_mapping(id, '{target_object}') to map fields\n"
        "3. Adapt the pattern structures to your target org's field names\n4. Deploy via SFDX or Metadata API\n"
    )
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return _together(_block(asked, 0, head), titles, rows, _block(total, 2 * len(categories) + 1, _joined("\n" + "=" * 60 + "\nTotal Components: ", F.col("n"), end)))


def mapping_answer(catalog: DataFrame, pattern_id: int, target_object: str) -> DataFrame:
    """A pattern's field references with suggestions on another object."""
    one = catalog.where(F.col("id") == pattern_id).limit(1)
    head = _joined("Field Mapping Template\n" + "=" * 60 + "\nPattern: ", F.col("name"), " (#", F.col("id"), ")\nSource Object: ", F.col("source_object"), f"\nTarget Object: {target_object}\n\nField Mappings (source → target):\n" + "-" * 40 + "\n")
    refs = one.select(F.posexplode("field_references").alias("place", "ref"))
    # a longer name isn't cut
    wide = F.when(F.length("ref") < 40, F.rpad("ref", 40, " ")).otherwise(F.col("ref"))
    rows = refs.select(F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), _joined("  ", wide, " → ", T.map_field(F.col("ref"), target_object), "\n").alias("text"))
    end = (
        "\n\nInstructions:\n1. Review each mapping above\n2. Replace custom field names (__c) with your org's field API names\n3. Verify relationship fields point to correct objects\n"
        "4. Standard fields (Name, Id, etc.) usually map 1:1\n\nPattern Structure (for reference):\n"
    )
    tail = _joined("\n" + "-" * 40 + "\nTotal Fields: ", F.size("field_references"), end, _indented(F.col("structure")), "\n")
    return _together(_block(one, 0, head), rows, _block(one, 2, tail), _not_found(one, pattern_id))
