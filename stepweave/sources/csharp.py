"""C# sources to rows: a lexer that knows every form of string, and a reader of declarations.

There is no semantic model: a reference is a name with its number of arguments, where known. What is done with it errs
towards "in use".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.session import ready

_CLASS = "name string, type_id string, is_class boolean, has_binding boolean, bases array<string>"
_ENUM = "name string, members array<string>"
_TRANSFORM = "name string, regex string"
_BINDING = "class string, method string, type string, pattern string, line_no int, parameter_count int, unresolvable boolean"
_DECLARATION = "id string, kind string, name string, containing string, type_id string, line_no int, visibility string, is_static boolean, is_abstract boolean, is_override boolean, is_explicit boolean, attributes array<string>, parameter_types array<string>, least int, most int, bases array<string>, has_main boolean, signature string"
_REFERENCE = "name string, arguments int, enclosing string, line_no int"
_LITERAL = "value string, line_no int"
SOURCE = f"path string, classes array<struct<{_CLASS}>>, enums array<struct<{_ENUM}>>, transforms array<struct<{_TRANSFORM}>>, bindings array<struct<{_BINDING}>>, declarations array<struct<{_DECLARATION}>>, references array<struct<{_REFERENCE}>>, literals array<struct<{_LITERAL}>>"

STEP_ATTRIBUTES = frozenset(("Given", "When", "Then", "And", "But", "StepDefinition"))
_MODIFIERS = frozenset("public private protected internal static abstract virtual override sealed partial async readonly const extern unsafe new required file volatile ref".split())
_TYPES = frozenset(("class", "struct", "interface", "record", "enum"))
_KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*\#[^\n]*)
    |(?P<raw>\$*"{3,})|(?P<string>(?:\$@|@\$|\$|@)?")|(?P<char>'(?:\\.[^'\n]*|[^'\\\n])')
    |(?P<name>@?[^\W\d]\w*)|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<sign>=>|::|\?\?|&&|\|\||[<>=!]=|.)""",
    re.X | re.S | re.M,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{1,4}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "e": "\x1b"}


@dataclass(slots=True)
class Token:
    """kind is name, string (plain literal), interpolated, number, char or sign."""

    kind: str
    text: str
    line: int


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def _hole_end(text: str, at: int) -> int:
    """The end of an interpolation's hole that begins at a position."""
    depth = 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m["string"] or m["raw"]:
            _, at = _string(text, m)
            continue
        depth += (m[0] == "{") - (m[0] == "}")
        at = m.end()
        if not depth:
            break
    return at


def _string(text: str, m: re.Match) -> tuple[list[tuple[str, str, int]], int]:
    """(kind, text, position) of a string literal and of what its holes hold, and the literal's end."""
    mark, at = m[0], m.end()
    if m["raw"]:
        quotes, dollars = mark.lstrip("$"), mark.count("$")
        end = text.find(quotes, at)
        end = len(text) if end < 0 else end
        while text[end + len(quotes) : end + len(quotes) + 1] == '"':
            end += 1
        body = text[at:end]
        lines = body.split("\n")
        if len(lines) > 1 and not lines[0].strip() and not lines[-1].strip():
            indent = lines[-1]
            body = "\n".join(x.removeprefix(indent).rstrip("\r") for x in lines[1:-1])
        if not dollars:
            return [("string", body, m.start())], end + len(quotes)
        opening = "{" * dollars
        holes, i = [], text.find(opening, at, end)
        while i >= 0:
            close = _hole_end(text, i + dollars)
            holes.append(("hole", text[i + dollars : close - 1], i + dollars))
            i = text.find(opening, close, end)
        return [("interpolated", body, m.start()), *holes], end + len(quotes)
    verbatim, dollar = "@" in mark, "$" in mark
    parts: list[str] = []
    holes = []
    while at < len(text):
        c = text[at]
        if c == '"':
            if verbatim and text[at + 1 : at + 2] == '"':
                parts.append('"')
                at += 2
                continue
            break
        if c == "\\" and not verbatim:
            e = _ESCAPE.match(text, at)
            parts.append(_unescape(e[0]) if e else c)
            at = e.end() if e else at + 1
        elif c == "{" and dollar and text[at + 1 : at + 2] != "{":
            close = _hole_end(text, at + 1)
            holes.append(("hole", text[at + 1 : close - 1], at + 1))
            at = close
        elif c in "{}" and dollar and text[at + 1 : at + 2] == c:
            parts.append(c)
            at += 2
        elif c == "\n" and not verbatim:
            break
        else:
            parts.append(c)
            at += 1
    return [("interpolated" if dollar else "string", "".join(parts), m.start()), *holes], at + 1


def lex(text: str, line: int = 1) -> list[Token]:
    """The tokens of a source; what the holes of an interpolated string hold follows it in parentheses."""
    out, at, seen = [], 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        line += text.count("\n", seen, at)
        seen = at
        kind = m.lastgroup
        if kind in ("string", "raw"):
            parts, end = _string(text, m)
            for what, body, position in parts:
                here = line + text.count("\n", seen, position)
                if what == "hole":
                    # a format after a colon is no code
                    out += [Token("sign", "(", here), *lex(body, here), Token("sign", ")", here)]
                else:
                    out.append(Token(what, body, here))
            at = max(end, m.end())
            continue
        if kind not in ("space", "comment", "directive"):
            out.append(Token(kind, m[0].lstrip("@") if kind == "name" else m[0], line))
        at = m.end()
    return out


@dataclass
class Attribute:
    name: str
    arguments: list[Token]
    line: int

    def groups(self) -> list[list[Token]]:
        """Arguments between commas."""
        out: list[list[Token]] = [[]]
        depth = 0
        for t in self.arguments:
            depth += (t.text in "([{" and t.kind == "sign") - (t.text in ")]}" and t.kind == "sign")
            if t.kind == "sign" and t.text == "," and not depth:
                out.append([])
            else:
                out[-1].append(t)
        return [g for g in out if g]

    def pattern(self) -> tuple[str, bool]:
        """The first positional argument if it is a plain string; whether there is one that isn't."""
        for g in self.groups():
            if len(g) > 1 and g[0].kind == "name" and g[1].text == "=":
                continue
            if len(g) > 2 and g[0].kind == "name" and g[1].text == ":":
                g = g[2:]
            return (g[0].text, False) if len(g) == 1 and g[0].kind == "string" else ("", True)
        return "", False

    def named(self, name: str) -> str | None:
        for g in self.groups():
            if len(g) == 3 and g[0].text == name and g[1].text == "=" and g[2].kind == "string":
                return g[2].text
        return None


@dataclass
class Reader:
    """Reads the declarations of one file."""

    tokens: list[Token]
    out: dict[str, list[dict[str, Any]]] = field(default_factory=lambda: {k: [] for k in ("classes", "enums", "transforms", "bindings", "declarations", "references", "literals")})
    at: int = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind in ("name", "sign") else ""

    def is_name(self, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i].kind == "name"

    def skip(self, opening: str, closing: str) -> tuple[int, int]:
        """Past a bracketed part that begins here; the positions of its inside."""
        start, depth = self.at + 1, 0
        while self.at < len(self.tokens):
            text = self.peek()
            depth += (text == opening) - (text == closing)
            self.at += 1
            if not depth:
                break
        return start, max(start, self.at - 1)

    def angles(self) -> None:
        """Past type arguments, if they begin here."""
        if self.peek() == "<":
            self.skip("<", ">")

    def refer(self, start: int, end: int, enclosing: str | None) -> None:
        """Names and strings between two positions, as used by a method or outside of all."""
        for i in range(start, min(end, len(self.tokens))):
            t = self.tokens[i]
            if t.kind == "string":
                self.out["literals"].append({"value": t.text, "line_no": t.line})
            if t.kind != "name" or t.text in _KEYWORDS:
                continue
            j = i + 1
            if j < end and self.tokens[j].text == "<":
                depth, k = 0, j
                while k < end and (self.tokens[k].kind == "name" or self.tokens[k].text in "<>,.?[]"):
                    depth += (self.tokens[k].text == "<") - (self.tokens[k].text == ">")
                    k += 1
                    if not depth:
                        break
                j = k if not depth and k > j else j
            arguments = -1
            if j < end and self.tokens[j].text == "(" and self.tokens[j].kind == "sign":
                arguments, depth, k, some = 0, 0, j, False
                while k < end:
                    text = self.tokens[k].text if self.tokens[k].kind == "sign" else ""
                    depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
                    if not depth:
                        break
                    some |= k > j
                    arguments += depth == 1 and text == ","
                    k += 1
                # a type argument's comma may have been counted, so the number is at most this
                arguments = arguments + 1 if some else 0
            self.out["references"].append({"name": t.text, "arguments": arguments, "enclosing": enclosing, "line_no": t.line})

    def attributes(self) -> list[Attribute]:
        found = []
        while self.peek() == "[":
            start, end = self.skip("[", "]")
            i, depth = start, 0
            if end - start > 1 and self.tokens[start].kind == "name" and self.tokens[start + 1].text == ":":
                i = start + 2
            while i < end:
                line, name = self.tokens[i].line, ""
                while i < end and (self.tokens[i].kind == "name" or self.tokens[i].text in (".", "::")):
                    name = self.tokens[i].text if self.tokens[i].kind == "name" else name
                    i += 1
                arguments: list[Token] = []
                while i < end and (depth or self.tokens[i].text != ","):
                    t = self.tokens[i]
                    sign = t.text if t.kind == "sign" else ""
                    depth -= sign in (")", "]", "}")
                    if depth > 0:
                        arguments.append(t)
                    depth += sign in ("(", "[", "{")
                    if depth > 1 and sign in ("(", "[", "{") and depth - 1 == 0:
                        arguments.append(t)
                    i += 1
                i += 1
                if name:
                    found.append(Attribute(name.removesuffix("Attribute") or name, arguments, line))
            self.refer(start, end, None)
        return found

    def read(self) -> dict[str, list[dict[str, Any]]]:
        while self.at < len(self.tokens):
            before = self.at
            self.members(None, "")
            if self.peek() == "}" or self.at == before:
                self.at += 1
        return self.out

    def members(self, owner: dict[str, Any] | None, scope: str) -> None:
        """Declarations up to the closing brace of their owner."""
        while self.at < len(self.tokens) and self.peek() != "}":
            before = self.at
            self.member(owner, scope)
            if self.at == before:
                self.at += 1

    def member(self, owner: dict[str, Any] | None, scope: str) -> None:
        attributes = self.attributes()
        modifiers: list[str] = []
        while self.peek() in _MODIFIERS or self.peek() == "event":
            modifiers.append(self.peek())
            self.at += 1
        word = self.peek()
        if word == "namespace":
            self.at += 1
            name = ""
            while self.is_name() or self.peek() == ".":
                name += self.peek()
                self.at += 1
            inner = f"{scope}{name}."
            if self.peek() == "{":
                self.at += 1
                self.members(None, inner)
            else:
                self.at += 1
                self.members(None, inner)
                return
            self.at += 1
        elif word in ("using", "extern") and owner is None:
            start = self.at
            self.until(";")
            if any(t.text in ("static", "=") for t in self.tokens[start : self.at]):
                self.refer(start, self.at, None)
        elif word in _TYPES and self.is_name(1) and not (word == "record" and self.peek(2) in ("(", "=", ";") and owner is not None and self.peek(2) != "(" and False):
            self.type(attributes, modifiers, owner, scope)
        elif word == "delegate":
            start = self.at
            self.until(";")
            self.refer(start, self.at, None)
        elif word in (";", "}"):
            self.at += word == ";"
        else:
            self.callable(attributes, modifiers, owner)

    def until(self, sign: str) -> None:
        while self.at < len(self.tokens) and self.peek() != sign:
            self.at += 1
        self.at += 1

    def type(self, attributes: list[Attribute], modifiers: list[str], owner: dict[str, Any] | None, scope: str) -> None:
        kind = self.peek()
        self.at += 1
        if kind == "record" and self.peek() in ("class", "struct"):
            self.at += 1
        name, line = self.peek(), self.tokens[self.at].line
        self.at += 1
        type_id = f"{owner['type_id']}+{name}" if owner else f"{scope}{name}"
        start = self.at
        self.angles()
        if self.peek() == "(":
            self.skip("(", ")")
        bases: list[str] = []
        if self.peek() == ":":
            self.at += 1
            while self.at < len(self.tokens) and self.peek() not in ("{", ";", "where"):
                last = ""
                while self.is_name() or self.peek() in (".", "::"):
                    last = self.peek() if self.is_name() else last
                    self.at += 1
                    self.angles()
                if last and kind != "enum":
                    bases.append(last)
                if self.peek() == "(":
                    self.skip("(", ")")
                elif self.peek() not in ("{", ";", "where"):
                    self.at += 1
        while self.at < len(self.tokens) and self.peek() not in ("{", ";"):
            self.at += 1
        self.refer(start, self.at, None)
        names = [a.name for a in attributes]
        own = {"name": name, "type_id": type_id, "kind": kind, "has_main": False}
        self.out["classes"].append({"name": name, "type_id": type_id, "is_class": kind == "class", "has_binding": "Binding" in names and kind == "class", "bases": bases})
        record = None
        if kind in ("class", "record", "interface"):
            record = self.declaration("Interface" if kind == "interface" else "Class", name, owner, line, modifiers, names, type_id, "private" if owner else "internal")
            record.update(bases=bases, id=type_id, type_id=type_id, signature=name)
            self.out["declarations"].append(record)
        if self.peek() == ";":
            self.at += 1
            return
        self.at += 1
        if kind == "enum":
            members = []
            while self.at < len(self.tokens) and self.peek() != "}":
                self.attributes()
                if self.is_name():
                    members.append(self.peek())
                    self.at += 1
                start = self.at
                while self.at < len(self.tokens) and self.peek() not in (",", "}"):
                    self.at += 1
                self.refer(start, self.at, None)
                self.at += self.peek() == ","
            if members:
                self.out["enums"].append({"name": name, "members": members})
        else:
            self.members(own, scope)
            if record is not None:
                record["has_main"] = own["has_main"]
        self.at += 1
        self.at += self.peek() == ";"

    def declaration(self, kind: str, name: str, owner: dict[str, Any] | None, line: int, modifiers: list[str], attributes: list[str], type_id: str, default: str) -> dict[str, Any]:
        levels = [m for m in modifiers if m in ("public", "private", "protected", "internal")]
        order = ("private", "protected", "internal", "public")
        return {
            "id": "", "kind": kind, "name": name, "containing": owner["name"] if owner else "", "type_id": type_id, "line_no": line,
            "visibility": " ".join(sorted(levels, key=order.index)) or default, "is_static": "static" in modifiers, "is_abstract": "abstract" in modifiers, "is_override": "override" in modifiers,
            "is_explicit": False, "attributes": attributes, "parameter_types": [], "least": 0, "most": 0, "bases": [], "has_main": False, "signature": "",
        }

    def parameters(self, start: int, end: int) -> tuple[list[str], int, int]:
        """Simple type names, and how many arguments a call has at least and at most (-1: any number)."""
        groups = [g for g in Attribute("", self._flat(start, end), 0).groups() if any(t.kind == "name" for t in g)]
        types, least, unlimited = [], 0, False
        for i, g in enumerate(groups):
            words = [t.text for t in g]
            optional = "=" in words
            unlimited |= "params" in words
            least += not optional and "params" not in words and not (i == 0 and words[0] == "this")
            named = [t.text for t in (g[: words.index("=")] if optional else g) if t.kind == "name" and t.text not in ("this", "ref", "out", "in", "params", "scoped", "readonly")]
            types.append(named[-2] if len(named) > 1 else named[0] if named else "")
        return types, least, -1 if unlimited else len(groups)

    def _flat(self, start: int, end: int) -> list[Token]:
        """Parameter tokens without attributes and type arguments."""
        out, depth = [], 0
        for t in self.tokens[start:end]:
            sign = t.text if t.kind == "sign" else ""
            depth += sign in ("<", "[")
            if not depth:
                out.append(t)
            depth -= sign in (">", "]") and depth > 0
        return out

    def callable(self, attributes: list[Attribute], modifiers: list[str], owner: dict[str, Any] | None) -> None:
        """A method, constructor, property, field, operator or a statement outside of all types."""
        start, name_at, explicit, depth = self.at, -1, False, 0
        while self.at < len(self.tokens):
            text = self.peek()
            if not depth and (text in ("{", ";", "=", "=>") or (text == "(" and self.at > start)):
                # a tuple type begins with a parenthesis; so does what follows a name
                if text != "(" or self.is_name(-1) or self.peek(-1) == ">":
                    break
            if text == "(":
                self.skip("(", ")")
                continue
            if text == "<":
                self.skip("<", ">")
                continue
            if text == "}":
                return
            if self.is_name() and text not in ("where",):
                name_at = self.at
                explicit = self.peek(-1) == "." and self.at - 1 > start
            self.at += 1
        if self.peek() != "(" or name_at < 0 or owner is None:
            self.body(start, None, skip_name=name_at if owner is not None else -1)
            return
        name, line = self.tokens[name_at].text, self.tokens[name_at].line
        ordinary = name_at > start and "operator" not in (t.text for t in self.tokens[start : self.at]) and self.peek(-1) != "~" and self.tokens[name_at - 1].text != "~"
        opening = self.at
        inside = self.skip("(", ")")
        types, least, most = self.parameters(*inside)
        names = [a.name for a in attributes]
        method = f"{owner['type_id']}.{name}({','.join(types)})" if ordinary else None
        if ordinary:
            in_interface = owner["kind"] == "interface"
            record = self.declaration("Method", name, owner, line, modifiers, names, owner["type_id"], "public" if in_interface else "private")
            record.update(id=method, is_explicit=explicit, parameter_types=types, least=least, most=most, is_abstract="abstract" in modifiers or in_interface, signature=f"{name}({', '.join(types)})")
            self.out["declarations"].append(record)
            owner["has_main"] |= name == "Main" and "static" in modifiers
            if owner["kind"] == "class":
                self.steps(attributes, name, owner, len(types), self.tokens[start:name_at])
        self.refer(start, name_at, method)
        self.refer(opening, self.at, method)
        self.body(self.at, method)

    def steps(self, attributes: list[Attribute], method: str, owner: dict[str, Any], parameters: int, returns: list[Token]) -> None:
        for a in attributes:
            pattern, unresolvable = a.pattern()
            if a.name in STEP_ATTRIBUTES:
                self.out["bindings"].append({"class": owner["name"], "method": method, "type": a.name, "pattern": pattern, "line_no": a.line, "parameter_count": parameters, "unresolvable": unresolvable})
            elif a.name == "StepArgumentTransformation" and a.groups() and not unresolvable:
                flat, depth = [], 0
                for t in returns:
                    depth += t.text == "<"
                    if t.kind == "name" and not depth:
                        flat.append(t.text)
                    depth -= t.text == ">"
                name = a.named("Name") or (flat[-1] if flat else "")
                if name and (pattern or any(g[0].kind == "string" for g in a.groups())):
                    self.out["transforms"].append({"name": name, "regex": pattern})

    def body(self, start: int, method: str | None, skip_name: int = -1) -> None:
        """From here to the member's end: a block (and what follows a property's), an expression or nothing."""
        while self.at < len(self.tokens):
            text = self.peek()
            if text == "{":
                self.skip("{", "}")
                if self.peek() == "=":
                    continue
                break
            if text == ";":
                self.at += 1
                break
            if text == "}":
                break
            if text in ("=", "=>"):
                depth = 0
                while self.at < len(self.tokens):
                    sign = self.peek()
                    if sign == ";" and not depth:
                        break
                    depth += (sign in ("(", "[", "{")) - (sign in (")", "]", "}"))
                    if depth < 0:
                        break
                    self.at += 1
                continue
            self.at += 1
        for a, b in ((start, skip_name), (skip_name + 1, self.at)) if skip_name >= 0 else ((start, self.at),):
            self.refer(a, b, method)


def read_source(path: str, content: str) -> dict[str, Any]:
    return {"path": path, **Reader(lex(content)).read()}


def parse_sources(files: DataFrame) -> DataFrame:
    """A row for each C# file of files (path, content), with its classes, enums, transforms, step bindings, declarations,
    references and string literals; see SOURCE."""
    from stepweave.operators.gherkin import _arrow, _maps

    arrow = _arrow(files.sparkSession, SOURCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_source(p, c or "") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield from pa.Table.from_pylist(_maps(rows, arrow), schema=arrow).to_batches()

    ready(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SOURCE)


def explode(parsed: DataFrame, column: str) -> DataFrame:
    """The rows of one of the lists, with the path."""
    return parsed.select("path", F.explode(column).alias("row")).select("path", "row.*")
