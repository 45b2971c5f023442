"""Comparison of scenarios step by step, for the tests."""

from __future__ import annotations

from dataclasses import dataclass

from stepweave.operators.gherkin import normalize
from stepweave.settings import AnalysisSettings


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def text_similarity(a: str, b: str, at_least: float = 0.0) -> float:
    """As functions.text.similarity; texts whose lengths alone keep them below at_least give 0."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    x, y = normalize(a), normalize(b)
    if x == y:
        return 100.0
    longest = max(len(x), len(y))
    if (1 - abs(len(x) - len(y)) / longest) * 100 < at_least - 1:
        return 0.0
    return round((1 - edit_distance(x, y) / longest) * 100, 1)


@dataclass
class Match:
    """Comparison of two scenarios."""

    overlap: float
    fuzzy: float
    matching: int
    additional: int
    same_sequence: bool
    match_type: str
    matching_texts: list[str]
    unique_a: list[str]
    unique_b: list[str]


def compare(a: dict, b: dict, settings: AnalysisSettings) -> Match:
    """Equal steps, then greedily for each step left of a the first unused step of b that is near enough."""
    shared = set(a["step_fps"]) & set(b["step_fps"])
    rest_a = [i for i, f in enumerate(a["step_fps"]) if f not in shared]
    rest_b = [i for i, f in enumerate(b["step_fps"]) if f not in shared]
    used: dict[int, tuple[int, float]] = {}
    for i in rest_a:
        for j in rest_b:
            if j in used:
                continue
            if settings.enable_parameter_agnostic_matching and a["norm_texts"][i] == b["norm_texts"][j]:
                near = 100.0
            elif settings.enable_fuzzy_matching:
                near = text_similarity(a["step_texts"][i], b["step_texts"][j], settings.fuzzy_match_threshold)
            else:
                continue
            if near >= settings.fuzzy_match_threshold:
                used[j] = i, near
                break
    smaller = min(len(a["step_fps"]), len(b["step_fps"]))
    percent = lambda k: round(k / smaller * 100, 1) if smaller else 0.0
    texts_a, texts_b = {a["step_texts"][i] for i, _ in used.values()}, {b["step_texts"][j] for j in used}
    order_a, order_b = ([f for f in s["step_fps"] if f in shared] for s in (a, b))
    return Match(
        percent(len(shared)), percent(len(shared) + len(used)), len(shared), len(used), bool(order_a) and order_a == order_b, match_type([s for _, s in used.values()]),
        [t for t, f in zip(a["step_texts"], a["step_fps"]) if f in shared],
        [a["step_texts"][i] for i in rest_a if a["step_texts"][i] not in texts_a],
        [b["step_texts"][j] for j in rest_b if b["step_texts"][j] not in texts_b],
    )


def match_type(similarities: list[float]) -> str:
    exact, near = any(s == 100 for s in similarities), any(s < 100 for s in similarities)
    return "Mixed" if exact and near else "ParameterVariation" if exact else "FuzzyMatch" if near else "Exact"
