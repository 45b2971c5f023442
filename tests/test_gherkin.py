from stepweave.operators.gherkin import CorpusParser, FeatureParser, explode, fingerprint, parse_features
from stepweave.settings import AnalysisSettings, CoverageSettings
from stepweave.sources.dialects import detect

SHOP = """@shop
Feature: Orders
  When in doubt this line is prose

  Background:
    Given a clean till

  @wip
  Scenario: Left out
    Given nothing

  @slow @DataSource:none.csv
  Scenario Outline: Missing file
    When <a> is sold

  Scenario: Mistyped
    When <item> goes for <price>
      | k | k |
      | 1 | 2 |
    Examples:
      | item | price |
      | pen  | 1     |
      | ink  | 2     |

  Scenario Outline: Holes
    When <ITEM> and <gone> and <gone> and <-1>
      | <row> | <gone> |
    But not
    Examples:

      # heading
      | item |
      | pen  |
"""


def parsed(text, **settings):
    return FeatureParser(AnalysisSettings(**settings), headers={}).parse("p", "/x/a.feature", text)


def test_data_errors_and_scenarios():
    out = parsed(SHOP)
    assert [(e["error_type"], e["line_no"], e["undefined"]) for e in out["errors"]] == [("DataSourceNotFound", 13, []), ("ScenarioWithExamples", 16, []), ("UndefinedPlaceholder", 26, ["gone", "gone", "row"])]
    assert out["errors"][1]["defined"] == ["item", "price"] and out["errors"][2]["defined"] == ["item"]
    assert [s["name"] for s in out["scenarios"]] == ["Missing file", "Mistyped", "Holes"] and out["excluded"] == 1
    assert [s["step_texts"][0] for s in out["scenarios"]] == ["a clean till"] * 3
    assert [len(s["step_fps"]) for s in out["scenarios"]] == [2, 2, 3] and len(out["steps"]) == 4
    assert out["scenarios"][1]["step_tables"][1] == [{"k": "2"}] and out["steps"][1]["fingerprint"] == fingerprint("When <item> goes for <price>", [{"k": "2"}])


def test_tags_filter_the_scenario_before():
    text = "Feature: f\n@a\nScenario: one\nGiven x\n@b\nScenario: two\nGiven y\n@c\n"
    assert [s["tags"] for s in parsed(text)["scenarios"]] == [["@b"], ["@c"]]
    assert [s["name"] for s in parsed(text, include_only_tags=["@A", "@B"], exclude_scenario_tags=[])["scenarios"]] == ["one"]


def test_data_source_headers(spark, tmp_path):
    (tmp_path / "d.csv").write_text(" name , size\nx,1\n")
    rows = [("p", str(tmp_path / "a.feature"), "Feature: f\n@x @datasource:d.csv\nScenario Outline: s\nGiven <NAME> <size> <other>\n"), ("p", str(tmp_path / "b.feature"), None)]
    found = parse_features(spark.createDataFrame(rows, "project string, path string, content string"), AnalysisSettings())
    errors = explode(found, "errors").collect()
    assert [(e["error_type"], e["undefined"], e["defined"], e["feature"]) for e in errors] == [("UndefinedPlaceholder", ["other"], ["name", "size"], "a.feature")]
    assert found.count() == 2


def test_localised():
    german = "# a comment\n# language: de\nFunktionalität: f\nSzenario: s\nAngenommen ein <x>\nwenn y\nSzenariogrundriss: t\nDann <z>\nBeispiele:\n|z|\n|1|\n"
    assert [e["undefined"] for e in parsed(german)["errors"]] == [["x"]] and len(parsed(german)["steps"]) == 3
    corpus = CorpusParser([]).parse("p", "a", german)["steps"]
    assert [(s["text"], s["keyword"]) for s in corpus] == [("ein <x>", None), ("<z>", None), ("1", None)]
    assert detect(["", "# language: xx"]).language == "en" and detect(["Feature: f", "# language: de"]).language == "en"


def test_corpus():
    out = CorpusParser(CoverageSettings().ignore_tags).parse("p", "a", SHOP)
    found = [(s["scenario"], s["text"], s["keyword"]) for s in out["steps"]]
    assert ("Background", "a clean till", "Given") == found[0] and not any("doubt" in t for _, t, _ in found)
    assert ("Mistyped", "pen goes for 1", "When") in found and ("Mistyped", "<item> goes for <price>", "When") in found
    assert ("Holes", "not", "When") in found and ("Holes", "<ITEM> and <gone> and <gone> and <-1>", "When") in found
    assert [(i["scenario"], i["reason"]) for i in out["ignored"]] == [("Left out", "@wip")]
    assert not any(s["scenario"] == "Left out" for s in CorpusParser(["@WIP"], include_ignored=False).parse("p", "a", SHOP)["steps"])


def test_keywords_are_case_sensitive_in_the_corpus():
    text = "Feature: f\nScenario: s\n* star\nGiven a\nand prose\nAnd\tb\n* c\nThen\n"
    assert [(s["text"], s["keyword"]) for s in CorpusParser([]).parse("p", "a", text)["steps"]] == [("star", None), ("a", "Given"), ("b", "Given"), ("c", "Given")]
    assert [s["text"] for s in parsed(text)["steps"]] == ["a", "prose"]


def test_batches_are_parsed_in_pieces_of_few_bytes(spark):
    import pyarrow as pa

    from stepweave.operators import gherkin as G

    contents = ["x" * 1000] * 1000 + [None, "", "y" * 3_000_000, "z"]
    batch = pa.RecordBatch.from_pydict({"project": ["p"] * 1004, "path": [str(i) for i in range(1004)], "content": contents})
    pieces = list(G._pieces(batch)) + list(G._pieces(batch.slice(1000)))
    assert [v for p in pieces for v in p.column(2).to_pylist()] == contents + contents[1000:]
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column(2).to_pylist()) <= G.PIECE for p in pieces)
    files = spark.createDataFrame([("p", str(i), f"Feature: f\nScenario: s\nGiven {'a' * 5000} {i}\n") for i in range(300)], "project string, path string, content string").coalesce(1)
    assert G.explode(G.parse_features(files, AnalysisSettings()), "steps").select("text").distinct().count() == 300
