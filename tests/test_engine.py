"""The checks over a solution folder, the command line and the queries against DuckDB."""

import duckdb
import pytest

from stepweave.plans.analysis import cascade_orphans, coverage, features, main, scenario_duplicates, step_duplicates, unused_code
from stepweave.plans.queries import QUERIES, SQL
from stepweave.settings import Settings
from stepweave.sources.files import StepAssemblies, data_source_rows

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEATURE = "Feature: f\nScenario: one\nGiven the barn is open\nWhen I feed 3 cows\nThen all is well\nScenario: two\nGiven the barn is open\nWhen I feed 4 cows\nThen all is well\nScenario: typed\nGiven <x>\nExamples:\n|x|\n|the barn is open|\n"
CODE = 'namespace N;\n[Binding]\npublic class S {\n[Given("the barn is open")]\npublic void Open() { Used(); }\n[When("I feed {int} cows")]\npublic void Feed(int n) { Used(); }\n[Then("nobody says this")]\npublic void Nobody() { OnlyHere(); }\nprivate void Used() { }\nprivate void OnlyHere() { }\nprivate void Never() { }\n}\n'


@pytest.fixture(scope="module")
def solution(tmp_path_factory):
    root = tmp_path_factory.mktemp("solution")
    for name in ("App.Tests", "App.Steps", "Else"):
        (root / name).mkdir()
        (root / name / f"{name}.csproj").write_text("<Project/>")
    (root / "App.Tests" / "a b+c.feature").write_text(FEATURE)
    (root / "App.Tests" / "bin").mkdir()
    (root / "App.Tests" / "bin" / "old.feature").write_text(FEATURE)
    (root / "App.Tests" / "reqnroll.json").write_text('{"stepAssemblies": [{"assembly": "App.Steps"}, {"assembly": "Gone"}]}')
    (root / "App.Steps" / "S.cs").write_text("﻿" + CODE)
    (root / "App.Steps" / "x.g.cs").write_text("class G { void Made() {} }")
    (root / "Else" / "E.cs").write_text('class E { [Given("elsewhere")] void X() {} }')
    return str(root)


def settings(root, **changes):
    s = Settings()
    s.analysis.solution_paths, s.unused_code.scan_paths = [root], [root]
    return s


def test_features(spark, solution):
    s = settings(solution)
    found = features(spark, s)
    c = found.counters().first()
    assert (c["files"], c["projects"], c["scenarios"], c["steps"]) == (1, 1, 3, 7)
    assert [(e["error_type"], e["scenario"]) for e in found.rows("errors").collect()] == [("ScenarioWithExamples", "typed")]
    exact, varied = step_duplicates(found, s)
    assert [(r["text"], r["occurrences"], r["category"]) for r in exact.collect()] == [("all is well", 2, "WithinProject")] and varied.count() == 0
    pairs, groups = scenario_duplicates(found, s)
    assert pairs.count() == 1 and groups.first()["duplicate_type"] == "ParameterVariation"


def test_coverage_and_cascade(spark, solution):
    s = settings(solution)
    s.coverage.use_step_assembly_references = False
    c = coverage(spark, s)
    row = c.summary.first()
    assert (row["total"], row["used"], row["unused"]) == (3, 2, 1) and [r["pattern"] for r in c.unused.collect()] == ["nobody says this"]
    assert c.unused.first()["project"] == "App.Steps"
    assert [(r["name"], r["round"]) for r in cascade_orphans(spark, s, c.unused).collect()] == [("OnlyHere", 1)]
    s.coverage.use_syntactic_discovery = False
    assert coverage(spark, s).summary.first()["total"] == 4


def test_unused_code(spark, solution):
    found, scanned = unused_code(spark, settings(solution))
    assert [(r["kind"], r["name"], r["project"]) for r in found.collect()] == [("Method", "Never", "App.Steps"), ("Class", "E", "Else")] or {r["name"] for r in found.collect()} == {"Never", "E"}
    assert {r["kind"]: r["scanned"] for r in scanned.collect()} == {"Method": 3, "Class": 2}


def test_assemblies(solution):
    a = StepAssemblies([solution])
    tests, steps = f"{solution}/App.Tests", f"{solution}/App.Steps"
    assert a.step_folders([tests], ["fallback"]) == [tests, steps] and a.step_folders([steps], ["fallback"]) == ["fallback"] and a.test_folders() == [tests]


def test_csv(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text('a, b\n1,"x, y"\n2\n')
    assert [tuple(r) for r in data_source_rows(spark, str(p)).collect()] == [("1", "x, y"), ("2", "")]


def test_command_line(spark, solution, tmp_path, capsys):
    assert main([], spark) == 1 and main(["--help"], spark) == 0
    assert main([solution, "--all", "--out", str(tmp_path)], spark) == 0
    summary = (tmp_path / "summary.txt").read_text()
    assert "Feature files scanned : 1" in summary and "Unused methods        : 1" in summary and "Step coverage" in summary
    page = (tmp_path / "report.html").read_text()
    assert "Scenario with an Examples table (1)" in page and "nobody says this" in page
    assert main([solution, "--data-errors", "--out", str(tmp_path)], spark) == 0 and "coverage" not in (tmp_path / "summary.txt").read_text()


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"Analysis": {"ScenarioOverlapThreshold": 70, "ExcludeFolders": ["out"]}, "CoverageAnalysis": {"IncludeIgnoredScenarios": false}}')
    s = Settings.load(str(p))
    assert s.analysis.scenario_overlap_threshold == 70 and s.analysis.exclude_folders == ["bin", "obj", "node_modules", ".git", "out"] and not s.coverage.include_ignored_scenarios


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_similarity_query_equals_brute_force(spark):
    from brute import text_similarity
    from stepweave.plans.queries import lines

    by_doc: dict = {}
    for r in sorted(lines(spark, DATA).collect(), key=lambda r: (r["doc_id"], r["line_no"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    found = {(r["doc_id"], r["line_no"]): r["similarity"] for r in QUERIES["step_similarity"](spark, DATA).collect()}
    short = {(a["doc_id"], a["line_no"]): text_similarity(a["text"], b["text"]) for rows in by_doc.values() for a, b in zip(rows, rows[1:]) if len(a["text"]) * len(b["text"]) < 4000}
    assert len(found) == sum(len(r) - 1 for r in by_doc.values()) and all(found[k] == v for k, v in short.items())


def test_default_settings_file_and_dialects(spark, solution, tmp_path, monkeypatch):
    (tmp_path / "words.json").write_text('{"fr": {"feature": ["Fonctionnalité"], "scenario": ["Scénario"], "given": ["* ", "Soit "]}}')
    (tmp_path / "appsettings.json").write_text(f'{{"Analysis": {{"DialectsPath": "{tmp_path}/words.json"}}}}')
    monkeypatch.chdir(tmp_path)
    s = Settings.load(None)
    folder = tmp_path / "s" / "Own"
    folder.mkdir(parents=True)
    (folder / "Own.csproj").write_text("<Project/>")
    (folder / "a.feature").write_text("# language: fr\nFonctionnalité: f\nScénario: un\nSoit une vache\n")
    s.analysis.solution_paths = [str(tmp_path / "s")]
    c = features(spark, s).counters().first()
    assert (c["scenarios"], c["steps"]) == (1, 1)


def test_report_says_what_is_clean():
    from stepweave.sinks.report import Report

    assert Report().percentage("Method") == 0 and Report().findings() == 0
    assert Report(unused_code=[{"kind": "Method"}], scanned={"Method": 4}).percentage("Method") == 25
