"""Metadata projects as DataFrames of classified files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .filetree import read_tree

# Fixed values. File name endings and the types they mark.
SUFFIXES = {
    ".flow-meta.xml": "flow",
    ".validationRule-meta.xml": "validation",
    ".object-meta.xml": "object",
    ".field-meta.xml": "field",
    ".report-meta.xml": "report",
    ".layout-meta.xml": "layout",
}
CONFIG, PACKAGE = "sfdx-project.json", "force-app"


def projects(files: DataFrame, base: str) -> DataFrame:
    """name, path, has_config, has_package and root of the projects right under `base`, from (path, content) of the files there.

    A project is a folder with a configuration or a package folder that has files. Its root, where its sources
    are, is the package folder, else the first configured folder that has files, else null.
    """
    top = base.rstrip("/")
    below = files.where(F.col("path").startswith(f"{top}/")).select(F.split(F.substring("path", len(top) + 2, 1 << 30), "/").alias("p"), "content")
    below = below.where("size(p) > 1").select(F.get("p", F.lit(0)).alias("name"), F.array_join(F.slice("p", 2, 1 << 20), "/").alias("inner"), "content")
    listed = F.from_json("content", "packageDirectories array<struct<path:string>>")["packageDirectories"]["path"]
    config = F.when(F.col("inner") == CONFIG, listed)
    package = F.col("inner").startswith(f"{PACKAGE}/")
    found = below.groupBy("name").agg(F.bool_or(F.col("inner") == CONFIG).alias("has_config"), F.bool_or(package).alias("has_package"), F.first(config, True).alias("dirs"))
    found = found.where("has_config OR has_package")
    wanted = found.where("NOT has_package").select("name", F.posexplode("dirs").alias("k", "dir")).select("name", "k", F.trim(F.regexp_replace("dir", r"^(\./)+|/+$", "")).alias("dir"))
    there = below.join(wanted, "name").where(F.col("inner").startswith(F.concat("dir", F.lit("/")))).groupBy("name").agg(F.min(F.struct("k", "dir")).alias("first"))
    path = F.concat(F.lit(f"{top}/"), "name")
    root = F.when(F.col("has_package"), F.concat(path, F.lit(f"/{PACKAGE}"))).otherwise(F.concat(path, F.lit("/"), "first.dir"))
    return found.join(there, "name", "left").select("name", path.alias("path"), "has_config", "has_package", root.alias("root"))


def project_root(spark: SparkSession, project: str) -> str | None:
    """Where one project's sources are; a package folder is its own root."""
    project = project.rstrip("/")
    base, _, name = project.rpartition("/")
    if name == PACKAGE:
        return project
    row = projects(listing(spark, project), base or "/").where(F.col("name") == name).first()
    return row["root"] if row else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and content (of project configurations, else null) of the files under `root`, by whatever file system Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    configs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", CONFIG).load(root)
    paths = files.select(_plain(F.col("path")).alias("path"))
    return paths.join(configs.select(_plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("content")), "path", "left")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def file_type(path: Column) -> Column:
    """The type that a path's ending and folders give, else null."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, kind in SUFFIXES.items():
        out = out.when(name.endswith(suffix), kind)
    folder = F.try_element_at(parts, F.lit(-2))
    out = out.when(name.endswith(".js") & F.array_contains(parts, "lwc") & (F.regexp_replace(name, r"\.js$", "") == folder), "lwc")
    return out.when(name.endswith(".cls") & F.array_contains(parts, "classes"), "apex")


def described(files: DataFrame, source_name: str) -> DataFrame:
    """path, name, file_type, content and source_hash of files (path, content as text), also of those without a type."""
    path = _plain(F.col("path"))
    return files.select(
        path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        file_type(path).alias("file_type"),
        "content",
        T.short_hash(F.lit(source_name), 12).alias("source_hash"),
    )


def scan(spark: SparkSession, root: str, source_name: str) -> DataFrame:
    """Every file under `root`, described, hidden ones included; bytes that aren't UTF-8 are replaced."""
    return described(read_tree(spark, root).select("path", "content"), source_name)


def file_counts(files: DataFrame) -> DataFrame:
    return files.where("file_type IS NOT NULL").groupBy("file_type").agg(F.count("*").alias("n"))


def object_of(path: Column) -> Column:
    found = F.regexp_extract(path, "/objects/([^/]+)/", 1)
    return F.when(found == "", "Unknown").otherwise(found)


def field_names(files: DataFrame) -> DataFrame:
    """(object, field) from the paths of field files: all that brand detection reads."""
    fields = files.where("file_type = 'field'")
    return fields.select(object_of(F.col("path")).alias("object"), F.replace("name", F.lit(".field-meta.xml"), F.lit("")).alias("field"))
