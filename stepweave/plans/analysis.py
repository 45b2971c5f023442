"""The three checks over folders of a solution, and the command line."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import bindings as B
from stepweave.operators import gherkin as G
from stepweave.operators import matching as M
from stepweave.operators import scenarios as D
from stepweave.operators import steps as P
from stepweave.operators import unused as U
from stepweave.session import local_session
from stepweave.settings import Settings
from stepweave.sinks.report import HtmlReporter, Report, TextReporter
from stepweave.sources import csharp, dialects, files


@dataclass
class Features:
    """Of the feature files: one row a file, and its lists as frames."""

    parsed: DataFrame

    def rows(self, name: str) -> DataFrame:
        return G.explode(self.parsed, name)

    def failures(self) -> DataFrame:
        return self.parsed.where("failure is not null").select("project", "path", "failure")

    def counters(self) -> DataFrame:
        """(files, projects, scenarios, steps, excluded)."""
        return self.parsed.agg(F.count("*").alias("files"), F.count_distinct("project").alias("projects"), F.sum(F.size("scenarios")).alias("scenarios"), F.sum(F.size("steps")).alias("steps"), F.sum("excluded").alias("excluded"))


    def steps_by_project(self) -> DataFrame:
        """(project, steps)."""
        return self.rows("steps").groupBy("project").agg(F.count("*").alias("steps"))


def features(spark: SparkSession, settings: Settings) -> Features:
    """Feature files of the folders of each solution; a file directly in the solution's folder belongs to none."""
    found = []
    for root in settings.analysis.solution_paths:
        for folder in files.project_folders(root, settings.analysis.project_folders):
            own = files.read_files(spark, [folder], settings.analysis.feature_file_pattern)
            found.append(files.without_folders(own, settings.analysis.exclude_folders).withColumn("project", F.lit(os.path.basename(folder))))
    every = found[0] if found else spark.createDataFrame([], "path string, content string, project string")
    for f in found[1:]:
        every = every.unionByName(f)
    return Features(G.parse_features(every, settings.analysis, _dialects(settings)).cache())


def _dialects(settings: Settings) -> dict[str, dialects.Dialect]:
    path = settings.analysis.dialects_path
    return dialects.load_dialects(path) if path else dialects.DIALECTS


def step_duplicates(found: Features, settings: Settings, reviewed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates and variations of steps."""
    steps = P.for_duplicates(found.rows("steps").withColumn("ord", F.struct("path", "ord")), settings.analysis.exclude_keywords_from_duplicates)
    return P.ranked(P.exact_duplicates(steps, reviewed)), P.variations(steps)


def scenario_duplicates(found: Features, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs and ranked groups of scenarios."""
    from pyspark.sql import Window

    s = found.rows("scenarios").withColumn("ord", F.row_number().over(Window.orderBy("project", "path", "line_no")).cast("long"))
    pairs = D.pairs(s, settings.analysis).cache()
    return pairs, D.ranked(D.groups(pairs))


@dataclass
class Coverage:
    counted: DataFrame
    unconfirmed: DataFrame
    ignored: DataFrame
    summary: DataFrame
    unused: DataFrame
    duplicates: DataFrame
    indeterminate: DataFrame


def coverage_folders(settings: Settings) -> tuple[list[str], list[str]]:
    """Folders of step definitions and of feature files."""
    roots, c = settings.analysis.solution_paths, settings.coverage
    if not c.use_step_assembly_references:
        return c.step_definition_paths or list(roots), list(roots)
    assemblies = files.StepAssemblies(roots)
    own = settings.analysis.project_folders
    projects = [p for r in roots for p in files.project_folders(r, own)] if own else list(roots)
    steps = assemblies.step_folders(projects, roots)
    return steps, assemblies.test_folders() or steps


def coverage(spark: SparkSession, settings: Settings) -> Coverage:
    step_roots, feature_roots = coverage_folders(settings)
    sources = files.read_files(spark, step_roots, "*.cs")
    if settings.coverage.use_syntactic_discovery:
        found, unconfirmed, types = B.discover(csharp.parse_sources(sources).cache())
    else:
        found, types = B.legacy_bindings(files.with_project(sources)), None
        unconfirmed = M.empty(spark)
    found = found.cache()
    parsed = G.parse_corpus(files.with_project(files.read_files(spark, feature_roots, "*.feature")), settings.coverage.ignore_tags, settings.coverage.include_ignored_scenarios, _dialects(settings)).cache()
    steps = G.explode(parsed, "steps")
    compiled = M.compile_bindings(found, types)
    if steps.isEmpty():
        # nothing is matched, so nothing is known to be beyond evaluation
        compiled = compiled.withColumn("reason", F.lit(None).cast("string"))
    counted = M.usage_counts(steps, found, compiled).cache()
    unused = M.unused(counted)
    if path := settings.coverage.known_issues_csv_path:
        unused = M.accepted(unused, files.known_issues(spark, path))
    return Coverage(counted, unconfirmed, G.explode(parsed, "ignored").orderBy("project", "feature"), M.coverage_summary(counted), unused, M.duplicate_definitions(found), M.indeterminate(counted))


def unused_code(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Unused declarations, and how many of each kind were looked at."""
    s = settings.unused_code
    roots = s.scan_paths or settings.analysis.solution_paths
    parsed = csharp.parse_sources(files.source_files(spark, roots, s.exclude_directories, s.exclude_file_patterns)).cache()
    markup = files.markup_names(files.without_folders(files.read_files(spark, roots, "*.xaml"), s.exclude_directories))
    declarations = csharp.explode(parsed, "declarations")
    found = U.unused_code(declarations, csharp.explode(parsed, "references"), csharp.explode(parsed, "literals"), markup, s)
    return files.with_project(found).orderBy("project", "containing", "name"), U.totals(declarations, s)


def cascade_orphans(spark: SparkSession, settings: Settings, dead_bindings: DataFrame) -> DataFrame:
    """(id, round, name, containing, path, line_no) of methods that only the dead bindings use."""
    step_roots, _ = coverage_folders(settings)
    parsed = csharp.parse_sources(files.read_files(spark, step_roots, "*.cs")).cache()
    declarations = csharp.explode(parsed, "declarations")
    reportable = U.method_candidates(declarations, settings.unused_code).select("id", F.lit(True).alias("reportable"))
    methods = declarations.where("kind = 'Method'").dropDuplicates(["id"])
    declared = methods.select("id").join(reportable, "id", "left").na.fill(False)
    graph = U.reference_graph(declarations, csharp.explode(parsed, "references"))
    found = U.cascade(declared, graph, U.seed_methods(dead_bindings, declarations))
    return found.join(methods.select("id", "name", "containing", "path", "line_no"), "id").orderBy("round", "path", "line_no")


def analyse(spark: SparkSession, settings: Settings) -> Report:
    found = features(spark, settings)
    counts = found.counters().first()
    report = Report(counts["files"], counts["scenarios"] or 0, counts["steps"] or 0)
    if settings.show_data_errors:
        report.errors = found.rows("errors").collect()
    if settings.coverage.enabled:
        c = coverage(spark, settings)
        report.coverage, report.unused_steps, report.indeterminate = c.summary.first(), c.unused.collect(), c.indeterminate.collect()
    if settings.unused_code.enabled:
        code, scanned = unused_code(spark, settings)
        report.unused_code, report.scanned = code.collect(), {r["kind"]: r["scanned"] for r in scanned.collect()}
    return report


USAGE = "usage: python -m stepweave PATH [--unused-code] [--unused-steps] [--data-errors] [--all] [--out FOLDER] [--settings FILE]"


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """0, whatever is found; 1 if there is no path."""
    if not arguments or {"-h", "--help"} & set(arguments):
        print(USAGE)
        return 0 if arguments else 1
    value = lambda name: arguments[arguments.index(name) + 1] if name in arguments[:-1] else None
    settings = Settings.load(value("--settings"))
    if root := next((a for a in arguments if not a.startswith("-")), None):
        settings.analysis.solution_paths = [os.path.abspath(root)]
        settings.unused_code.scan_paths = [os.path.abspath(root)]
    if not settings.analysis.solution_paths:
        print(USAGE, file=sys.stderr)
        return 1
    checks = {"--data-errors", "--unused-steps", "--unused-code"}
    wanted = checks if "--all" in arguments or not checks & set(arguments) else checks & set(arguments)
    settings.coverage.enabled, settings.unused_code.enabled = "--unused-steps" in wanted, "--unused-code" in wanted
    settings.show_data_errors = "--data-errors" in wanted
    report = analyse(spark or local_session(), settings)
    folder = value("--out") or settings.output_directory
    path = TextReporter().write(report, folder)
    with open(path, encoding="utf-8") as f:
        print(f.read())
    if settings.generate_html:
        print(HtmlReporter().write(report, folder))
    return 0
