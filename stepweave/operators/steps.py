"""Duplicate steps: steps (project, ord, text, original_text, fingerprint, ...) with one fingerprint or one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_duplicates(steps: DataFrame, excluded_keywords: list[str]) -> DataFrame:
    """Steps whose original text doesn't begin with an excluded keyword."""
    words = "|".join(f"\\Q{k}\\E" for k in excluded_keywords)
    return steps.where(~F.col("original_text").rlike(f"(?i)^(?:{words}) ")) if words else steps


def exact_duplicates(steps: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(fingerprint, text, occurrences, projects, category): a row for each fingerprint with several steps that reviewed
    (fingerprint) doesn't hold; CrossProject if they are in several projects. Partial counts are merged before the shuffle."""
    if reviewed is not None:
        steps = steps.join(reviewed.select("fingerprint").distinct(), "fingerprint", "left_anti")
    found = steps.groupBy("fingerprint").agg(F.min_by("text", "ord").alias("text"), F.count("*").alias("occurrences"), F.count_distinct("project").alias("projects"))
    kind = F.when(F.col("projects") > 1, "CrossProject").otherwise("WithinProject")
    return found.where("occurrences > 1").withColumn("category", kind)


def ranked(duplicates: DataFrame) -> DataFrame:
    return duplicates.orderBy(F.desc("occurrences"), "text", "fingerprint")


def variations(steps: DataFrame) -> DataFrame:
    """(text, fingerprint, occurrences, total): texts that come with several fingerprints, a row for each of these."""
    each = steps.groupBy("text", "fingerprint").agg(F.count("*").alias("occurrences"))
    several = each.groupBy("text").agg(F.count("*").alias("kinds"), F.sum("occurrences").alias("total")).where("kinds > 1")
    return each.join(several.select("text", "total"), "text")
