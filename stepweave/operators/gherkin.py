"""Feature files to rows.

A file is one row; its lines depend on one another by a state machine, so each file is parsed as a whole in an Arrow batch,
files in parallel. Two readings are made, which differ in their rules as described: parse_features for steps,
scenarios and data errors, parse_corpus for the steps that bindings are matched with.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepweave.session import ready
from stepweave.settings import AnalysisSettings
from stepweave.sources.dialects import DIALECTS, Dialect, detect
from stepweave.sources.files import data_source_headers, resolve_data_source

#: Bytes of content that are parsed together.
PIECE = 1 << 19
TABLE = "array<map<string,string>>"
STEP = f"scenario string, ord int, line_no int, text string, original_text string, table {TABLE}, fingerprint string"
SCENARIO = f"name string, line_no int, type string, tags array<string>, step_fps array<string>, step_texts array<string>, norm_texts array<string>, original_texts array<string>, step_tables array<{TABLE}>, background_steps array<string>, fingerprint string"
ERROR = "scenario string, step_text string, line_no int, undefined array<string>, defined array<string>, error_type string, has_examples boolean"
CORPUS_STEP = "scenario string, ord int, line_no int, text string, full_text string, keyword string, ignored boolean"
IGNORED = "scenario string, line_no int, tags array<string>, reason string"
PARSED = f"project string, path string, steps array<struct<{STEP}>>, scenarios array<struct<{SCENARIO}>>, errors array<struct<{ERROR}>>, excluded int, failure string"
CORPUS = f"project string, path string, steps array<struct<{CORPUS_STEP}>>, ignored array<struct<{IGNORED}>>"

_KEYWORD = re.compile(r"^(Given|When|Then|And|But)\s+", re.I)
_NORMAL = ((re.compile(r"<[^>]+>"), "{PARAM}"), (re.compile(r'"[^"]*"'), "{STRING}"), (re.compile(r"'[^']*'"), "{STRING}"), (re.compile(r"\b\d+\.?\d*\b"), "{NUM}"), (re.compile(r"\b(?:a|an|the)\b", re.I), ""), (re.compile(r"\s+"), " "))
_NAME = re.compile(r"<([A-Za-z_][A-Za-z0-9_]*)>")


def normalize(text: str) -> str:
    """The step's normalised text for fuzzy comparison."""
    text = _KEYWORD.sub("", text).strip()
    for pattern, token in _NORMAL:
        text = pattern.sub(token, text)
    return text.strip().lower()


def short_hash(text: str, length: int = 20) -> str:
    return base64.b64encode(hashlib.sha256(text.encode()).digest()).decode()[:length]


def fingerprint(text: str, table: list[dict[str, str]]) -> str:
    cells = "".join(f"|{k}={row[k]}" for row in table for k in sorted(row))
    return short_hash(_KEYWORD.sub("", text).strip() + cells)


def _cells(line: str) -> list[str]:
    """Cells of a table row; empty ones are dropped before trimming."""
    return [c.strip() for c in line.split("|") if c]


def data_table(lines: list[str], at: int) -> tuple[list[dict[str, str]], list[str]]:
    """The table whose rows begin at a line: rows by heading (of equal headings the last cell counts), and its lines."""
    rows = []
    while at < len(lines) and lines[at].startswith("|"):
        rows.append(lines[at])
        at += 1
    heads = _cells(rows[0]) if rows else []
    return [dict(zip(heads, _cells(r))) for r in rows[1:]], rows


def examples(lines: list[str], at: int, dialect: Dialect) -> tuple[list[str], bool]:
    """The columns of the first Examples table after a scenario's heading, and whether there is one."""
    for i in range(at + 1, len(lines)):
        kind = dialect.block(lines[i])
        if kind == "examples":
            for line in lines[i + 1 :]:
                if line.startswith("|"):
                    return list({c.lower(): c for c in reversed(_cells(line)) if c}.values())[::-1], True
                if line and line[0] != "#":
                    break
            return [], True
        if kind in ("scenario", "outline"):
            break
    return [], False


@dataclass
class _Steps:
    """Steps of a scenario or background, side by side."""

    prints: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    normal: list[str] = field(default_factory=list)
    original: list[str] = field(default_factory=list)
    tables: list[list[dict[str, str]]] = field(default_factory=list)

    def add(self, line: str, table: list[dict[str, str]]) -> str:
        self.prints.append(fingerprint(line, table))
        self.texts.append(_KEYWORD.sub("", line).strip())
        self.normal.append(normalize(line))
        self.original.append(line)
        self.tables.append(table)
        return self.prints[-1]

    def extended(self) -> _Steps:
        return _Steps(*(list(x) for x in (self.prints, self.texts, self.normal, self.original, self.tables)))


class FeatureParser:
    """The reading for data errors, scenarios and duplicates. Tags stand until the next heading, and a scenario is filtered
    by the tags that stand when it ends; feature tags belong to the first scenario."""

    def __init__(self, settings: AnalysisSettings, dialects: dict[str, Dialect] = DIALECTS, headers: dict[tuple[str, str], list[str] | None] | None = None):
        self.settings, self.dialects, self.headers = settings, dialects, headers or {}

    def excluded(self, tags: list[str]) -> bool:
        own = {t.lower() for t in tags}
        only = {t.lower() for t in self.settings.include_only_tags}
        return bool(own & {t.lower() for t in self.settings.exclude_scenario_tags}) or bool(only) and not own & only

    def parse(self, project: str | None, path: str, content: str) -> dict[str, Any]:
        lines = [x.strip() for x in re.split(r"\r\n|\r|\n", content)]
        dialect = detect(lines, self.dialects)
        words = self.settings.step_keywords if dialect.language == "en" else dialect.steps
        starts = tuple(f"{w.lower()} " for w in words)
        out: dict[str, Any] = {"project": project, "path": path, "steps": [], "scenarios": [], "errors": [], "excluded": 0, "failure": None}
        background, scenario = _Steps(), _Steps()
        name, heading, outline, in_background = "", 0, False, False
        defined: list[str] = []
        has_examples = failed = False
        tags: list[str] = []

        def error(kind: str, text: str, line: int, undefined: list[str], known: list[str], flag: bool) -> None:
            out["errors"].append({"scenario": name, "step_text": text, "line_no": line, "undefined": undefined, "defined": known, "error_type": kind, "has_examples": flag})

        def close() -> None:
            out["scenarios"].append({
                "name": name, "line_no": heading, "type": "ScenarioOutline" if outline else "Scenario", "tags": list(tags), "step_fps": scenario.prints, "step_texts": scenario.texts,
                "norm_texts": scenario.normal, "original_texts": scenario.original, "step_tables": scenario.tables, "background_steps": list(background.texts), "fingerprint": short_hash("||".join(sorted(scenario.prints))),
            })

        i = -1
        while (i := i + 1) < len(lines):
            line = lines[i]
            if line.startswith("@"):
                tags += [t for t in line.split(" ") if t.startswith("@")]
                continue
            kind = dialect.block(line)
            if kind == "background":
                background, in_background = _Steps(), True
            elif kind in ("scenario", "outline"):
                in_background = False
                if name and scenario.prints:
                    close()
                if self.excluded(tags):
                    out["excluded"] += 1
                    tags, name = [], ""
                    continue
                outline, name, heading = kind == "outline", line.split(":", 1)[1].strip(), i + 1
                scenario = background.extended() if self.settings.include_background_steps else _Steps()
                defined, has_examples = examples(lines, i, dialect)
                value = next((t[len("@DataSource:") :].strip() for t in tags if t.lower().startswith("@datasource:")), "")
                found = self.headers.get((path, value)) if value else []
                failed = found is None
                if failed:
                    error("DataSourceNotFound", f"@DataSource:{value}", heading, [], [f"CSV not found for @DataSource:{value}"], has_examples)
                else:
                    defined += [h for h in found if h.lower() not in {d.lower() for d in defined}]
                if not outline and has_examples:
                    error("ScenarioWithExamples", f"Scenario: {name}", heading, [], list(defined), True)
                tags = []
            elif kind is None and line and line[0] not in "|#" and line.lower().startswith(starts):
                table, rows = data_table(lines, i + 1)
                if in_background:
                    background.add(line, table)
                elif name:
                    if (outline or not has_examples) and not failed:
                        known = {d.lower() for d in defined}
                        missing = [n for n in _NAME.findall(line) if n.lower() not in known]
                        for n in (n for row in rows for n in _NAME.findall(row)):
                            if n.lower() not in known and n not in missing:
                                missing.append(n)
                        if missing:
                            error("UndefinedPlaceholder", line, i + 1, missing, list(defined), bool(defined))
                    own = scenario.add(line, table)
                    out["steps"].append({"scenario": name, "ord": len(out["steps"]), "line_no": i + 1, "text": scenario.texts[-1], "original_text": line, "table": table, "fingerprint": own})
                i += len(rows)
        if name and scenario.prints:
            if self.excluded(tags):
                out["excluded"] += 1
            else:
                close()
        return out


class CorpusParser:
    """The reading for coverage: steps of every block with the keyword that they resolve to, once as written and once for
    each row of each Examples table below them. Tag lines before the first block are the whole file's."""

    def __init__(self, ignore_tags: list[str], include_ignored: bool = True, dialects: dict[str, Dialect] = DIALECTS):
        self.ignore, self.include, self.dialects = {t.lower() for t in ignore_tags}, include_ignored, dialects

    def parse(self, project: str | None, path: str, content: str) -> dict[str, Any]:
        lines = [x.strip() for x in re.split(r"\r\n|\r|\n", content)]
        dialect = detect(lines, self.dialects)
        out: dict[str, Any] = {"project": project, "path": path, "steps": [], "ignored": []}
        of_feature: list[str] = []
        tags: list[str] = []
        scenario, in_background, ignored, in_examples, inside = "", False, False, False, False
        heads: list[str] | None = None
        block: list[tuple[str, str, int, str | None]] = []
        anchor: str | None = None

        def add(text: str, full: str, line: int, keyword: str | None) -> None:
            if not ignored or scenario == "Background" or self.include:
                out["steps"].append({"scenario": scenario, "ord": len(out["steps"]), "line_no": line, "text": text, "full_text": full, "keyword": keyword, "ignored": ignored})

        for number, line in enumerate(lines, 1):
            if not line or line[0] == "#":
                continue
            if line[0] == "@":
                (tags if scenario or in_background else of_feature).extend(re.findall(r"@[\w-]+", line))
                continue
            kind = dialect.block(line)
            inside |= kind in ("background", "scenario", "outline", "examples")
            if kind == "background":
                scenario, in_background, in_examples, block, anchor, tags = "Background", True, False, [], None, []
            elif kind in ("scenario", "outline"):
                scenario, in_background, in_examples, heads, block, anchor = line.split(":", 1)[1].strip(), False, False, None, [], None
                every = of_feature + tags
                reason = next((t for t in every if t.lower() in self.ignore), None)
                ignored, tags = reason is not None, []
                if ignored:
                    out["ignored"].append({"scenario": scenario, "line_no": number, "tags": every, "reason": reason})
            elif kind == "examples":
                in_examples, heads = True, None
            elif kind is None and line[0] == "|":
                if in_examples:
                    cells = [c.strip() for c in line.strip("|").split("|")]
                    if heads is None:
                        heads = cells
                    else:
                        for text, full, at, keyword in block:
                            for head, cell in zip(heads, cells):
                                text = text.replace(f"<{head}>", cell)
                            add(text, full, at, keyword)
            elif kind is None and inside and scenario and (step := dialect.step(line)):
                anchor = step[0] if step[0] in ("Given", "When", "Then") else anchor
                block.append((step[1], line, number, anchor))
                add(step[1], line, number, anchor)
        return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of no more than PIECE bytes of content, or of one file: what is parsed is many times larger than its
    text, and a batch has so many rows, whatever their size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(size, before + PIECE, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _parsed(files: DataFrame, parser: FeatureParser | CorpusParser, schema: str) -> DataFrame:
    arrow = _arrow(files.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in _pieces(batch)):
            rows = []
            for project, path, content in zip(*(piece.column(i).to_pylist() for i in range(3))):
                rows.append(parser.parse(project, path, content or ""))
            yield from pa.Table.from_pylist(_maps(rows, arrow), schema=arrow).to_batches()

    ready(files.sparkSession)
    return files.select("project", "path", "content").mapInArrow(run, schema)


def _maps(rows: list[Any], schema: pa.Schema) -> list[Any]:
    """Dictionaries as lists of pairs where the schema has maps."""

    def fit(value: Any, kind: pa.DataType) -> Any:
        if value is None:
            return None
        if pa.types.is_map(kind):
            return list(value.items())
        if pa.types.is_list(kind):
            return [fit(v, kind.value_type) for v in value]
        if pa.types.is_struct(kind):
            return {f.name: fit(value[f.name], f.type) for f in kind}
        return value

    return [{f.name: fit(r[f.name], f.type) for f in schema} for r in rows]


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def parse_features(files: DataFrame, settings: AnalysisSettings, dialects: dict[str, Dialect] = DIALECTS) -> DataFrame:
    """A row for each file of files (project, path, content): steps, scenarios, errors, how many scenarios tags excluded.

    The files that @DataSource tags name are looked up on the driver: they are few and lie beside the feature files."""
    tag = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?im)^\s*@(?:.*\s@|)DataSource:(\S*)"), F.lit(1))))
    headers: dict[tuple[str, str], list[str] | None] = {}
    for path, value in files.where(F.lower("content").contains("@datasource:")).select("path", tag).collect():
        at = resolve_data_source(value, path, settings.data_source_search_paths)
        try:
            headers[path, value] = data_source_headers(at) if at else None
        except (OSError, UnicodeDecodeError):
            headers[path, value] = None
    return _parsed(files, FeatureParser(settings, dialects, headers), PARSED)


def parse_corpus(files: DataFrame, ignore_tags: list[str], include_ignored: bool = True, dialects: dict[str, Dialect] = DIALECTS) -> DataFrame:
    """A row for each file of files (project, path, content): corpus steps and ignored scenarios."""
    return _parsed(files, CorpusParser(ignore_tags, include_ignored, dialects), CORPUS)


def explode(parsed: DataFrame, column: str) -> DataFrame:
    """The rows of one of the lists, with project, path and feature file."""
    name = F.substring_index("path", "/", -1).alias("feature")
    return parsed.select("project", "path", name, F.explode(column).alias("row")).select("project", "path", "feature", "row.*")


def feature_name(path: str) -> str:
    return os.path.basename(path)
