"""Feature files as they arrive: an extension, for suites that are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import text as T
from stepweave.operators import gherkin as G
from stepweave.settings import AnalysisSettings


def watch(spark: SparkSession, folder: str, pattern: str = "*.feature") -> DataFrame:
    """A stream of (project, path, content, arrived) of the files that appear below a folder; the project is the folder
    that holds the file."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return files.select(F.regexp_extract(path, "([^/]+)/[^/]*$", 1).alias("project"), path.alias("path"), F.col("value").alias("content"), F.current_timestamp().alias("arrived"))


def errors(files: DataFrame, settings: AnalysisSettings | None = None) -> DataFrame:
    """Data errors of each file as it arrives: no state. @DataSource files can't be looked up from a stream; their tags
    count as unresolved."""
    return G.explode(G._parsed(files, G.FeatureParser(settings or AnalysisSettings()), G.PARSED), "errors")


def repeated_steps(files: DataFrame, settings: AnalysisSettings | None = None) -> DataFrame:
    """(fingerprint, text, occurrences) of steps that were seen more than once so far; for complete or update output."""
    steps = G.explode(G._parsed(files, G.FeatureParser(settings or AnalysisSettings()), G.PARSED), "steps")
    counted = steps.groupBy(T.step_fingerprint(F.col("original_text")).alias("fingerprint")).agg(F.first("text").alias("text"), F.count("*").alias("occurrences"))
    return counted.where("occurrences > 1")
