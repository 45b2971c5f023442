"""Keyword tables of feature files by language.

English and German are built in; load_dialects() reads a full table from a JSON file of the usual shape (language to
lists named feature, background, scenario, scenarioOutline, examples, given, when, then, and, but).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

HEADER = re.compile(r"#\s*language\s*:\s*([\w-]+)", re.I | re.A)


@dataclass(frozen=True)
class Dialect:
    language: str
    feature: tuple[str, ...]
    background: tuple[str, ...]
    scenario: tuple[str, ...]
    outline: tuple[str, ...]
    examples: tuple[str, ...]
    steps: tuple[str, ...]

    def block(self, line: str) -> str | None:
        """feature, background, outline, scenario or examples, if the line heads one; outlines go before scenarios."""
        for kind in ("background", "outline", "scenario", "examples", "feature"):
            for word in getattr(self, kind):
                if line[len(word) : len(word) + 1] == ":" and line[: len(word)].lower() == word.lower():
                    return kind
        return None

    def step(self, line: str) -> tuple[str, str] | None:
        """(keyword, text) of a step line, in the keyword's own case; any white space may follow the keyword."""
        for word in self.steps:
            if line.startswith(word) and line[len(word) : len(word) + 1].isspace():
                text = line[len(word) :].strip()
                return (word, text) if text else None
        return None


def _dialect(language: str, table: dict[str, list[str]]) -> Dialect:
    steps: dict[str, str] = {}
    for concept in ("given", "when", "then", "and", "but"):
        for word in table.get(concept, []):
            if word := word.rstrip():
                steps.setdefault(word.lower(), word)
    get = lambda name: tuple(table.get(name, []))
    return Dialect(language, get("feature"), get("background"), get("scenario"), get("scenarioOutline"), get("examples"), tuple(steps.values()))


_BUILT_IN = {
    "en": {
        "feature": ["Feature", "Business Need", "Ability"], "background": ["Background"], "scenario": ["Example", "Scenario"],
        "scenarioOutline": ["Scenario Outline", "Scenario Template"], "examples": ["Examples", "Scenarios"],
        "given": ["* ", "Given "], "when": ["* ", "When "], "then": ["* ", "Then "], "and": ["* ", "And "], "but": ["* ", "But "],
    },
    "de": {
        "feature": ["Funktionalität", "Funktion"], "background": ["Grundlage", "Hintergrund", "Voraussetzungen", "Vorbedingungen"], "scenario": ["Beispiel", "Szenario"],
        "scenarioOutline": ["Szenariogrundriss", "Szenarien"], "examples": ["Beispiele"],
        "given": ["* ", "Angenommen ", "Gegeben sei ", "Gegeben seien "], "when": ["* ", "Wenn "], "then": ["* ", "Dann "], "and": ["* ", "Und "], "but": ["* ", "Aber "],
    },
}
DIALECTS: dict[str, Dialect] = {k: _dialect(k, v) for k, v in _BUILT_IN.items()}


def load_dialects(path: str) -> dict[str, Dialect]:
    """The built-in tables and those of a JSON file, which replace them."""
    with open(path, encoding="utf-8-sig") as f:
        return DIALECTS | {k.lower(): _dialect(k, v) for k, v in json.load(f).items()}


def detect(lines: list[str], dialects: dict[str, Dialect] = DIALECTS, fallback: str = "en") -> Dialect:
    """The dialect that a comment before all content names; an unknown one or none gives the fallback."""
    for line in filter(None, (x.strip() for x in lines)):
        if m := HEADER.match(line):
            return dialects.get(m[1].lower(), dialects[fallback])
        if line[0] != "#":
            break
    return dialects[fallback]
