"""Binding patterns: which grammar they are in, the regular expression that they stand for, and words they can't do without.

The expressions are made for the JVM's engine, which runs them in rlike; a binding table is small, so they are made on
the driver, once for each binding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

_WHOLE = r"-?\d+"
_MARK = r"\p{Pc}\p{Po}"
_GROUPED = rf"\d+(?:[{_MARK}\p{{Pd}} ]?\d+)*"
_FRACTION = rf"(?:[{_MARK}](?=\d.*))?\d*"
_FLOAT = "".join((r"(?=.*\d.*)", "[-+]?", f"(?:{_GROUPED})*", _FRACTION, r"(?:\d+[E]-?\d+)?"))
_ANY = ".*"
#: Built-in parameter types: name to expression.
PARAMETER_TYPES: dict[str, str] = {
    **dict.fromkeys(("int", "long", "byte", "Int16", "Int32", "Int64", "Byte"), _WHOLE),
    **dict.fromkeys(("Single", "Double", "Decimal", "decimal", "double", "float"), _FLOAT),
    **dict.fromkeys(("", "string", "Guid", "DateTime", "Char", "Boolean"), _ANY),
    "word": r"[^\s]+",
}
NEVER = "(?!)"
_SPECIAL = re.compile(r"([\\*+?|{\[()^$.#\s])")
_WORD = re.compile(r"[^\W_]+")
MIN_WORD = 3


class UnknownParameterType(ValueError):
    """A pattern names a parameter type that nothing defines."""


def escape(text: str) -> str:
    """The text as an expression for itself."""
    return _SPECIAL.sub(lambda m: {"\n": r"\n", "\t": r"\t", "\r": r"\r", "\f": r"\f"}.get(m[1], "\\" + m[1]), text)


def is_cucumber(pattern: str) -> bool:
    """Whether a pattern is a Cucumber expression and not a regular one. The order of the tests matters."""
    if pattern[:1] == "^" or pattern[-1:] == "$":
        return False
    if re.search(r"\{\w*\}", pattern):
        return True
    return not re.search(r"\([^)]+[*+]\)|\.\*|\\\.|\\d\+", pattern)


def is_literal(pattern: str) -> bool:
    """Whether a Cucumber expression is plain text."""
    return not set(pattern) & set("{}()/\\")


def cucumber_regex(pattern: str, types: dict[str, str] | None = None) -> str:
    """The anchored expression of a Cucumber expression."""
    return f"^{_segment(pattern, PARAMETER_TYPES if types is None else types)}$"


_PART = re.compile(r"\\(?P<escaped>.)|\{(?P<type>[^}]*)\}|(?P<open>\()|(?P<word>[^\s({\\]+)|(?P<other>.)", re.S)


def _segment(text: str, types: dict[str, str]) -> str:
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        at = m.end()
        if m["type"] is not None:
            if m["type"] not in types:
                raise UnknownParameterType(f"no parameter type {{{m['type']}}} is known")
            out.append(f"(?:{types[m['type']]})")
        elif m["open"]:
            end = re.compile(r"(?:\\.|[^)\\]|\\$)*", re.S).match(text, at).end()
            if end < len(text):
                out.append(f"(?:{_segment(text[at:end], types)})?")
                at = end + 1
            else:
                out.append(escape("("))
        elif m["word"] and "/" in m["word"]:
            out.append(f"(?:{'|'.join(map(escape, m['word'].split('/')))})")
        else:
            out.append(escape(m["escaped"] or m["word"] or m["other"]))
    return "".join(out)


def effective_regex(pattern: str) -> str:
    """A regular pattern with the anchors that its text lacks; it is searched for, so an alternation stays loose."""
    return ("" if pattern.startswith("^") else "^") + pattern + ("" if pattern.endswith("$") else "$")


def convention_text(method: str, parameters: int) -> str | None:
    """The step text that a method without pattern binds by its name; None if it can bind none."""
    if parameters or not method:
        return None
    words = re.findall(r"[A-Z][a-z0-9]*", method)
    return " ".join(words[1:] if len(words) > 1 and words[0] in ("Given", "When", "Then", "And", "But") else words)


def convention_regex(text: str) -> str:
    return rf"(?i)^{escape(text)}\.?$"


def required_words(pattern: str, method: str = "", parameters: int = 0) -> list[str]:
    """Words in lower case that every match holds, in pattern order: of MIN_WORD characters at least, between white space or
    anchors, and outside all brackets. An alternation requires none."""
    if not pattern:
        pattern = convention_text(method, parameters) or ""
    if "|" in pattern:
        return []
    depth, flat = 0, []
    for i, c in enumerate(pattern):
        depth += (c in "([{") - (c in ")]}" and depth > 0)
        flat.append("\0" if depth or c in ")]}" else c)
        if c == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "()[]{}":
            return []
    flat = "".join(flat)
    words = []
    for m in _WORD.finditer(flat):
        before, after = flat[m.start() - 1 : m.start()], flat[m.end() : m.end() + 1]
        if len(m[0]) >= MIN_WORD and all(not c or c.isspace() or c in "^$" for c in (before, after)):
            words.append(m[0].lower())
    return list(dict.fromkeys(words))


@dataclass(frozen=True)
class Compiled:
    """A binding's expression: kind cucumber, regex, convention or never; or the reason why it can't be evaluated."""

    kind: str | None
    regex: str | None
    literal: bool = False
    required: tuple[str, ...] = ()
    reason: str | None = None


def jvm_accepts(spark: SparkSession, regex: str) -> str | None:
    """None, or why the engine that runs it rejects the expression."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except Exception as e:  # the gateway wraps PatternSyntaxException in one of several classes
        return str(e).splitlines()[0]
    return None


def compile_binding(spark: SparkSession, pattern: str, method: str = "", parameters: int = 0, unresolvable: bool = False, types: dict[str, str] | None = None) -> Compiled:
    """Never raises: what can't be evaluated is indeterminate, not unused."""
    if unresolvable:
        return Compiled(None, None, reason="the pattern is no string literal")
    if not pattern:
        text = convention_text(method, parameters)
        if text is None:
            return Compiled("never", NEVER)
        return Compiled("convention", convention_regex(text), required=tuple(required_words("", method, parameters)))
    if is_cucumber(pattern):
        try:
            regex, kind = cucumber_regex(pattern, types), "cucumber"
        except UnknownParameterType as e:
            return Compiled(None, None, reason=str(e))
    else:
        regex, kind = effective_regex(pattern), "regex"
    if problem := jvm_accepts(spark, regex):
        return Compiled(None, None, reason=f"invalid pattern: {problem}")
    return Compiled(kind, regex, kind == "cucumber" and is_literal(pattern), tuple(required_words(pattern)))
