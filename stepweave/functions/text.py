"""Column functions on step texts and their fingerprints. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORD = r"(?i)^(Given|When|Then|And|But)\s+"
#: What stands for a parameter, in the order in which it is replaced.
PARAMETERS = ((r"<[^>]+>", "{PARAM}"), (r'"[^"]*"', "{STRING}"), (r"'[^']*'", "{STRING}"), (r"\b\d+\.?\d*\b", "{NUM}"))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_keyword(text: Column) -> Column:
    """Without the leading English step keyword."""
    return strip(F.regexp_replace(text, KEYWORD, ""))


def normalize_parameters(text: Column) -> Column:
    """Placeholders, quoted strings and numbers as tokens."""
    for pattern, token in PARAMETERS:
        text = F.regexp_replace(text, pattern, F.lit(token))
    return text


def normalize_fuzzy(text: Column) -> Column:
    """Keyword and articles dropped, parameters as tokens, one space between words, lower case."""
    text = normalize_parameters(normalize_keyword(text))
    text = F.regexp_replace(text, r"(?i)\b(a|an|the)\b", "")
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def similarity_of(x: Column, y: Column, at_least: float = 0.0) -> Column:
    """0 to 100, by characters that an edit of two normalised texts leaves; less than at_least may come as 0."""
    longest = F.greatest(F.length(x), F.length(y)).cast("double")
    # so many edits leave less than at_least, if only by rounding; counting stops there
    most = F.floor(longest * (1 - (at_least - 1) / 100)).cast("int")
    edits = F.call_function("levenshtein", x, y, most) if at_least else F.levenshtein(x, y)
    apart = F.abs(F.length(x) - F.length(y)) > most
    return F.when(x == y, 100.0).when(apart, 0.0).otherwise(F.when(edits < 0, 0.0).otherwise(F.bround((F.lit(1.0) - edits / longest) * 100, 1)))


def similarity(a: Column, b: Column) -> Column:
    """similarity_of the normalised texts; a blank text is like a blank one alone."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(blank(a) & blank(b), 100.0).when(blank(a) | blank(b), 0.0).otherwise(similarity_of(normalize_fuzzy(a), normalize_fuzzy(b)))


def digest(text: Column, length: int) -> Column:
    """The first characters of the base64 SHA-256."""
    return F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, length)


def step_fingerprint(text: Column, table: Column | None = None) -> Column:
    """Of a step and its table (array of maps): cells by key, row after row."""
    body = normalize_keyword(text)
    if table is not None:
        cells = lambda row: F.transform(F.array_sort(F.map_keys(row)), lambda k: F.concat(F.lit("|"), k, F.lit("="), row[k]))
        body = F.concat(body, F.coalesce(F.array_join(F.flatten(F.transform(table, cells)), ""), F.lit("")))
    return digest(body, 20)


def scenario_fingerprint(prints: Column) -> Column:
    """Of a scenario's step fingerprints, in any order."""
    return digest(F.array_join(F.array_sort(prints), "||"), 20)


def step_signature(prints: Column) -> Column:
    """Of the first three steps, in any order."""
    return F.when(F.size(prints) == 0, "empty").otherwise(digest(F.array_join(F.array_sort(F.slice(prints, 1, 3)), "|"), 8))


def tokens(text: Column) -> Column:
    """The different runs of letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def step_key(text: Column) -> Column:
    """What a literal binding and a step must share: no keyword, no anchors, one space between words; case stays."""
    return F.regexp_replace(strip_match(text), r"\s+", " ").alias("key")


def strip_match(text: Column) -> Column:
    """A pattern or step without leading keyword and anchors."""
    bare = strip(F.regexp_replace(strip(text), r"(?i)^(?:Given |When |Then |And |But |\* )", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"^\^+", ""), r"\$+$", "")
