"""Reports: a text summary and one HTML page, from frames as small as a report is."""

from __future__ import annotations

import html
import os
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

ERROR_LABELS = {
    "ScenarioWithExamples": "Scenario with an Examples table",
    "UndefinedPlaceholder": "Undefined placeholder",
    "DataSourceNotFound": "Data source not found",
}


@dataclass
class Report:
    """What was found, gathered."""

    features: int = 0
    scenarios: int = 0
    steps: int = 0
    errors: list[Row] = field(default_factory=list)
    coverage: Row | None = None
    unused_steps: list[Row] = field(default_factory=list)
    indeterminate: list[Row] = field(default_factory=list)
    unused_code: list[Row] | None = None
    scanned: dict[str, int] = field(default_factory=dict)

    def unused(self, kind: str) -> list[Row]:
        return [r for r in self.unused_code or [] if r["kind"] == kind]

    def percentage(self, kind: str) -> float:
        """Unused declarations of a kind among those looked at."""
        scanned = self.scanned.get(kind, 0)
        return len(self.unused(kind)) * 100 / scanned if scanned else 0.0

    def findings(self) -> int:
        return len(self.errors) + len(self.unused_steps) + len(self.unused_code or [])


class Reporter(Protocol):
    """Writes a report to a folder."""

    file_name: str

    def write(self, report: Report, folder: str) -> str: ...


def _save(folder: str, name: str, text: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


class TextReporter:
    file_name = "summary.txt"

    def write(self, report: Report, folder: str) -> str:
        rows: list[tuple[str, object] | None] = [("Feature files scanned", report.features), ("Scenarios analysed", report.scenarios), ("Steps analysed", report.steps), None, ("Data errors", len(report.errors))]
        if report.coverage is not None:
            rows += [None, ("Step coverage", f"{report.coverage['coverage']:.1f}%"), ("Unused step defs", len(report.unused_steps))]
        if report.unused_code is not None:
            rows += [None, *((f"Unused {name}", len(report.unused(kind))) for kind, name in (("Method", "methods"), ("Class", "classes"), ("Interface", "interfaces")))]
        lines = ["Suite hygiene summary", "=" * 21, *("" if r is None else f"{r[0]:<22}: {r[1]}" for r in rows)]
        return _save(folder, self.file_name, "\n".join(lines) + "\n")


def short_path(path: str) -> str:
    """The last two parts."""
    return "/".join(path.replace("\\", "/").split("/")[-2:])


def marked(text: str, names: list[str]) -> str:
    """Escaped text with <name> of the names set off."""
    out = html.escape(text)
    for name in names:
        tag = html.escape(f"<{name}>")
        out = out.replace(tag, f"<mark>{tag}</mark>")
    return out


class HtmlReporter:
    file_name = "report.html"

    def write(self, report: Report, folder: str) -> str:
        cards = [("feature files", report.features), ("scenarios", report.scenarios), ("steps", report.steps), ("data errors", len(report.errors))]
        if report.coverage is not None:
            cards += [("step coverage", f"{report.coverage['coverage']:.1f} %"), ("unused steps", len(report.unused_steps))]
        if report.unused_code is not None:
            cards.append(("unused code", len(report.unused_code)))
        total = report.findings()
        parts = [f"<p class=status>{f'{total} to look at' if total else 'nothing to look at'}</p>", "".join(f"<div class=card><b>{html.escape(str(v))}</b> {k}</div>" for k, v in cards)]
        if report.unused_code is not None:
            scanned = ", ".join(f"{report.scanned.get(kind, 0)} {name} ({report.percentage(kind):.1f} % unused)" for kind, name in (("Method", "methods"), ("Class", "classes"), ("Interface", "interfaces")))
            parts.append(f"<h2>Unused code</h2><p>Looked at {scanned}.</p>" + _table(("kind", "name", "visibility", "place", "note"), [(r["kind"], f"{r['containing']}.{r['signature']}".lstrip("."), r["visibility"], f"{short_path(r['path'])}:{r['line_no']}", f"named by a string at {r['hint']}" if r["hint"] else "") for r in report.unused_code], "All code is in use."))
        if report.coverage is not None:
            place = lambda r: (r["type"], r["pattern"], f"{r['class']}.{r['method']}", f"{short_path(r['path'])}:{r['line_no']}")
            parts.append("<h2>Unused step definitions</h2>" + _table(("type", "pattern", "method", "place"), [place(r) for r in report.unused_steps], "Scenarios use them all."))
            if report.indeterminate:
                parts.append("<h2>Step definitions of unknown use</h2>" + _table(("type", "pattern", "method", "place", "reason"), [(*place(r), r["reason"]) for r in report.indeterminate]))
        parts.append("<h2>Data errors</h2>" + ("".join(self._errors(report.errors)) or "<p>None found.</p>"))
        page = "<!DOCTYPE html><html lang=en><meta charset=utf-8><title>Suite hygiene</title><style>body{font:15px sans-serif;margin:2em}.card{display:inline-block;padding:1em;margin:.3em;background:#eef}table{border-collapse:collapse}td,th{padding:.2em .8em;text-align:left;border-bottom:1px solid #ccc}mark{background:#fc9}</style>"
        return _save(folder, self.file_name, f"{page}<body><h1>Suite hygiene</h1>{''.join(parts)}</body></html>\n")

    @staticmethod
    def _errors(errors: list[Row]) -> list[str]:
        out = []
        for kind, label in ERROR_LABELS.items():
            own = [e for e in errors if e["error_type"] == kind]
            if own:
                out.append(f"<h3>{label} ({len(own)})</h3>")
            for path, scenario in dict.fromkeys((e["path"], e["scenario"]) for e in own):
                here = [e for e in own if (e["path"], e["scenario"]) == (path, scenario)]
                missing = list(dict.fromkeys(n for e in here for n in e["undefined"]))
                lines = "".join(f"<li>{marked(e['step_text'], e['undefined'])} (line {e['line_no']})</li>" for e in here)
                out.append(f"<div><b>{html.escape(scenario)}</b> in {html.escape(short_path(path))}" + (f"; missing: {html.escape(', '.join(missing))}" if missing else "") + f"<ul>{lines}</ul></div>")
        return out


def _table(heads: tuple[str, ...], rows: list[tuple], empty: str = "") -> str:
    """An HTML table, or the text empty if there are no rows and one is given."""
    if empty and not rows:
        return f"<p>{html.escape(empty)}</p>"
    cells = lambda row, tag: "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in row)
    return f"<table><tr>{cells(heads, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>"


def error_cards(errors: DataFrame) -> DataFrame:
    """(error_type, path, scenario, errors, missing): data errors by kind, file and scenario, with the different
    placeholders that are missing."""
    found = errors.groupBy("error_type", "path", "scenario").agg(F.count("*").alias("errors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("undefined")))).alias("missing"))
    order = F.array_position(F.array(*map(F.lit, ERROR_LABELS)), F.col("error_type"))
    return found.orderBy(order, "path", "scenario")
