"""Files as rows, and what lies beside them: projects, runner configuration, CSV data, known issues."""

from __future__ import annotations

import csv
import fnmatch
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, content string"


def read_files(spark: SparkSession, roots: Iterable[str], pattern: str) -> DataFrame:
    """(path, content) of the files below roots whose name matches, each once for every root that holds it; roots that
    don't exist are skipped. One row is one file."""
    found = [r for r in roots if os.path.isdir(r)]
    frames = [spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(r, wholetext=True).select("value", "_metadata.file_path") for r in found]
    if not frames:
        return spark.createDataFrame([], FILES)
    union = frames[0]
    for f in frames[1:]:
        union = union.unionAll(f)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return union.select(path.alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))


def without_folders(files: DataFrame, folders: Iterable[str]) -> DataFrame:
    """Files with none of the folders in their path."""
    for name in folders:
        files = files.where(~F.contains(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), F.lit(f"/{name}/")))
    return files


def wildcard(pattern: str) -> str:
    """The expression of a pattern in which * stands for anything, for rlike."""
    return "(?i)^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in pattern.split("*")) + "$"


def source_files(spark: SparkSession, roots: Iterable[str], exclude_dirs: Iterable[str], exclude_patterns: Iterable[str]) -> DataFrame:
    """C# files without excluded folders and names, each path once, whatever its case."""
    files = without_folders(read_files(spark, roots, "*.cs"), exclude_dirs)
    name = F.substring_index("path", "/", -1)
    for pattern in exclude_patterns:
        files = files.where(~name.rlike(wildcard(pattern)))
    return files.withColumn("__low", F.lower("path")).dropDuplicates(["__low"]).drop("__low")


def project_folders(root: str, configured: list[str] | None = None) -> list[str]:
    """The configured folders that exist, else those directly below the root."""
    if configured:
        return [p for name in configured if os.path.isdir(p := os.path.join(root, name))]
    return sorted(e.path for e in os.scandir(root) if e.is_dir()) if os.path.isdir(root) else []


def projects(paths: Iterable[str], unknown: str | None = None) -> dict[str, str]:
    """By folder of the paths, the project file's name in the nearest folder upwards; else unknown, or the folder's name."""
    known: dict[str, str | None] = {}

    def of(folder: str) -> str | None:
        if folder not in known:
            own = sorted(fnmatch.filter(os.listdir(folder), "*.csproj")) if os.path.isdir(folder) else []
            up = os.path.dirname(folder)
            known[folder] = os.path.splitext(own[0])[0] if own else of(up) if up != folder else None
        return known[folder]

    folders = {os.path.dirname(p) for p in paths}
    return {f: of(f) or (os.path.basename(f) if unknown is None else unknown) for f in folders}


def with_project(files: DataFrame, unknown: str | None = None) -> DataFrame:
    """files with their project. The folders are gathered to look them up: there are far fewer of them than files."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    names = [r[0] for r in files.select(folder).distinct().collect()]
    rows = [(k, v) for k, v in projects((f"{n}/x" for n in names), unknown).items()]
    table = files.sparkSession.createDataFrame(rows, "folder string, project string")
    return files.withColumn("folder", folder).join(table, "folder", "left").drop("folder")


class StepAssemblies:
    """Projects below solution folders and the step assemblies that their runner configuration names."""

    CONFIGS = ("reqnroll.json", "specflow.json")

    def __init__(self, solutions: Iterable[str]):
        self.paths: dict[str, str] = {}
        self.references: dict[str, list[str]] = {}
        self.warnings: list[str] = []
        for solution in filter(os.path.isdir, solutions):
            for e in sorted(os.scandir(solution), key=lambda e: e.name):
                if e.is_dir() and not e.name.startswith(".") and fnmatch.filter(os.listdir(e.path), "*.csproj"):
                    self.paths[e.name] = e.path
                    if names := self._configured(e.path):
                        self.references[e.name] = names

    def _configured(self, folder: str) -> list[str]:
        for name in self.CONFIGS:
            path = os.path.join(folder, name)
            try:
                with open(path, encoding="utf-8-sig") as f:
                    found = json.load(f).get("stepAssemblies", [])
                names = [a["assembly"] for a in found if isinstance(a, dict) and str(a.get("assembly") or "").strip()]
            except FileNotFoundError:
                continue
            except (ValueError, AttributeError, TypeError) as e:
                self.warnings.append(f"{path}: {e}")
                continue
            if names:
                return names
        return []

    def step_folders(self, projects: list[str], fallback: list[str]) -> list[str]:
        """The projects and the assemblies that they name; the fallback if none names any."""
        named = [os.path.basename(p.rstrip("/")) for p in projects]
        if not any(n in self.references for n in named):
            return list(fallback)
        found = [*projects, *(self.paths[a] for n in named for a in self.references.get(n, []) if a in self.paths)]
        return list(dict.fromkeys(found))

    def test_folders(self) -> list[str]:
        """Projects with a runner configuration."""
        return [self.paths[p] for p in self.references]


def resolve_data_source(value: str, feature: str, search: Iterable[str] = ()) -> str | None:
    """The CSV file that a @DataSource tag means: an absolute path, else beside the feature file, else below search."""
    places = [value] if os.path.isabs(value) else []
    places += [os.path.join(os.path.dirname(feature), value), *(os.path.join(s, value) for s in search)]
    return next((os.path.abspath(p) for p in places if os.path.isfile(p)), None)


def data_source_headers(path: str) -> list[str]:
    """The trimmed cells of a CSV file's first row."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [h.strip() for h in next(csv.reader(f), [])]


def data_source_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's rows as strings, trimmed, a missing field as the empty string."""
    headers = data_source_headers(path)
    frame = spark.read.csv(path, schema=", ".join(f"`{h}` string" for h in headers), header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)
    return frame.na.fill("")


def known_issues(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source_file, method, comment) of a known-issues file: source file, method, comment with any commas. Blank
    lines and # comments are skipped, so is a heading in the first line left, and rows without a method."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return parse_known_issues(lines)


def parse_known_issues(lines: DataFrame) -> DataFrame:
    """The same of lines (ord, line)."""
    kept = lines.select("ord", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", ",", 3)

    def field(i: int):
        text = F.regexp_replace(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^\s+|\s+$", "")
        quoted = text.rlike('(?s)^".*"$') & (F.length(text) >= 2)
        return F.when(quoted, F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)

    rows = kept.select("ord", field(0).alias("source_file"), field(1).alias("method"), field(2).alias("comment"))
    first = kept.agg(F.min("ord").alias("first"))
    heading = (F.col("ord") == F.col("first")) & (F.lower("source_file") == "sourcefile") & (F.lower("method") == "methodname")
    return rows.join(first).where(~heading & (F.col("method") != "")).drop("first")


def markup_names(files: DataFrame) -> DataFrame:
    """(name): the different identifiers in quoted values and {extensions} of markup (content)."""
    places = F.regexp_extract_all("content", F.lit(r'"([^"]*)"|\{([^}]*)\}'), F.lit(0))
    names = files.select(F.explode(places).alias("place")).select(F.explode(F.regexp_extract_all("place", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return names.distinct()
