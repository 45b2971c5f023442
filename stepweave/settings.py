"""Settings, with the defaults of the command line."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


DEFAULT_FILE = "appsettings.json"


def _words(text: str) -> Any:
    return field(default_factory=text.split)


@dataclass
class AnalysisSettings:
    """Scanning of feature files, and duplicates."""

    solution_paths: list[str] = _words("")
    project_folders: list[str] | None = None
    feature_file_pattern: str = "*.feature"
    exclude_folders: list[str] = _words("bin obj node_modules .git")
    step_keywords: list[str] = _words("Given When Then And But")
    exclude_keywords_from_duplicates: list[str] = _words("Given")
    duplicate_mode: str = "Scenario"
    scenario_overlap_threshold: int = 80
    min_steps_for_scenario_comparison: int = 3
    max_unique_steps_for_duplicate: int = 5
    enable_fuzzy_matching: bool = True
    fuzzy_match_threshold: float = 85.0
    enable_parameter_agnostic_matching: bool = True
    include_background_steps: bool = True
    enable_cross_feature_comparison: bool = True
    exclude_scenario_tags: list[str] = _words("@ignore @wip @skip @manual")
    include_only_tags: list[str] = _words("")
    max_comparisons_per_project: int = 500_000
    enable_bucket_optimization: bool = True
    data_source_search_paths: list[str] = _words("")
    #: A JSON file of keyword tables; without one English and German are known.
    dialects_path: str | None = None


@dataclass
class CoverageSettings:
    """Step-definition coverage."""

    enabled: bool = False
    known_issues_csv_path: str | None = None
    use_syntactic_discovery: bool = True
    use_step_assembly_references: bool = True
    step_definition_paths: list[str] = _words("")
    ignore_tags: list[str] = _words("@ignore @skip @wip @pending @manual @disabled")
    include_ignored_scenarios: bool = True


@dataclass
class UnusedCodeSettings:
    """Unused methods, classes and interfaces."""

    enabled: bool = False
    scan_paths: list[str] = _words("")
    analyze_methods: bool = True
    analyze_classes: bool = True
    analyze_interfaces: bool = True
    include_private_methods: bool = True
    include_internal_methods: bool = True
    include_public_members: bool = False
    exclude_patterns: list[str] = _words("*Tests *Test Test* *Fixture Program Startup Main ConfigureServices Configure Dispose ToString GetHashCode Equals")
    exclude_attributes: list[str] = _words(
        "Given When Then And But StepDefinition Binding Scope "
        + " ".join(f"{when}{what}" for what in ("Scenario", "Feature", "Step", "TestRun", "ScenarioBlock") for when in ("Before", "After"))
        + " Fact Theory InlineData ClassData MemberData Test TestCase TestCaseSource SetUp TearDown OneTimeSetUp OneTimeTearDown TestFixture "
        "TestMethod TestClass TestInitialize TestCleanup ClassInitialize ClassCleanup AssemblyInitialize AssemblyCleanup "
        "HttpGet HttpPost HttpPut HttpDelete HttpPatch Route ApiController Controller JsonConstructor JsonProperty DataMember DataContract Inject Autowired"
    )
    exclude_file_patterns: list[str] = _words("*.g.cs *.designer.cs *.generated.cs *.feature.cs AssemblyInfo.cs GlobalUsings.cs")
    exclude_directories: list[str] = _words("obj bin node_modules .git packages TestResults")


@dataclass
class Settings:
    """All settings. load() reads a JSON file whose keys may be in camel or Pascal case, by default DEFAULT_FILE of the
    current folder if there; a list in the file extends the default list."""

    analysis: AnalysisSettings = field(default_factory=AnalysisSettings)
    coverage: CoverageSettings = field(default_factory=CoverageSettings)
    unused_code: UnusedCodeSettings = field(default_factory=UnusedCodeSettings)
    output_directory: str = "./reports"
    generate_html: bool = True
    show_data_errors: bool = True

    @classmethod
    def load(cls, path: str | None) -> Settings:
        settings = cls()
        if not Path(path := path or DEFAULT_FILE).exists():
            return settings
        found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        plain = lambda name: name.replace("_", "").lower()
        parts = {"analysis": settings.analysis, "coverageanalysis": settings.coverage, "unusedcodeanalysis": settings.unused_code}
        for section, values in found.items():
            if not isinstance(values, dict):
                continue
            if plain(section) == "output":
                settings.output_directory = values.get("OutputDirectory", settings.output_directory)
                settings.generate_html = values.get("GenerateHtml", settings.generate_html)
            if (part := parts.get(plain(section))) is None:
                continue
            known = {plain(f.name): f.name for f in dataclasses.fields(part)}
            for key, value in values.items():
                if plain(key) == "datasource" and isinstance(value, dict):
                    part.data_source_search_paths += value.get("AdditionalSearchPaths", [])
                elif plain(key) == "showdataerrors":
                    settings.show_data_errors = bool(value)
                elif name := known.get(plain(key)):
                    old = getattr(part, name)
                    setattr(part, name, old + value if isinstance(old, list) and isinstance(value, list) else value)
        return settings
