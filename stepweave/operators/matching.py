"""Which bindings the steps of a corpus use.

Steps are reduced to their different (key, keyword) before any join. One theta-join is split in three that are disjoint by
binding: plain-text bindings by equality of keys; bindings with required words by equality on their rarest required word,
with the expression as residual; and the few others against every step.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.functions import expressions as E
from stepweave.functions.text import step_key, strip_match, tokens

BINDING = "binding_id long, project string, path string, class string, method string, type string, pattern string, line_no int, parameter_count int, unresolvable boolean"
COMPILED = "binding_id long, kind string, regex string, is_literal boolean, required array<string>, reason string"
PREFERENCE = ("Given", "When", "Then", "And", "But", "StepDefinition")


def compile_bindings(bindings: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """(binding_id, kind, regex, is_literal, required, reason). Bindings are source code, not data: their table is gathered
    and compiled on the driver, where the JVM checks each expression."""
    spark = bindings.sparkSession
    rows = []
    for b in bindings.collect():
        c = E.compile_binding(spark, b["pattern"], b["method"], b["parameter_count"], b["unresolvable"], types)
        # Unicode classes, as in the language that the patterns were written for
        rows.append((b["binding_id"], c.kind, None if c.regex is None else f"(?U){c.regex}", c.literal, list(c.required), c.reason))
    return spark.createDataFrame(rows, COMPILED)


def compatible(kind: Column, keyword: Column) -> Column:
    """Whether a binding's keyword binds a step's: the same, one that binds any, or a step without one."""
    return ~kind.isin("Given", "When", "Then") | keyword.isNull() | (kind == keyword)


def step_keys(steps: DataFrame) -> DataFrame:
    """(key, keyword, text): each different step once, with the text that comes first."""
    return steps.groupBy(step_key(F.col("text")), "keyword").agg(F.min_by("text", F.struct("path", "ord")).alias("text"))


def rarest_words(compiled: DataFrame) -> DataFrame:
    """(binding_id, word): of each binding the required word that the fewest bindings require, the first of equals."""
    words = compiled.where("not is_literal").select("binding_id", F.posexplode("required").alias("pos", "word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("f"))
    return words.join(frequency, "word").groupBy("binding_id").agg(F.min_by("word", F.struct("f", "pos")).alias("word"))


def literal_matches(keys: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    plain = bindings.join(compiled.where("is_literal").select("binding_id"), "binding_id").select("binding_id", "type", step_key(F.col("pattern")))
    return keys.join(plain, "key").where(compatible(F.col("type"), F.col("keyword"))).select("key", "keyword", "binding_id")


def indexed_matches(keys: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """An equi-join on the rarest required word."""
    side = bindings.select("binding_id", "type").join(compiled, "binding_id").join(rarest_words(compiled), "binding_id").select("binding_id", "type", "regex", "required", "word")
    spread = keys.withColumn("tokens", tokens(F.col("text"))).withColumn("word", F.explode("tokens"))
    holds = (F.size(F.array_except("required", "tokens")) == 0) & compatible(F.col("type"), F.col("keyword"))
    return spread.join(side, "word").where(holds & F.rlike("text", F.col("regex"))).select("key", "keyword", "binding_id")


def scanned_matches(keys: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """Bindings without required word against every different step; Catalyst broadcasts the smaller side by its size."""
    side = compiled.where("regex is not null and not is_literal and size(required) = 0 and kind <> 'never'").join(bindings.select("binding_id", "type"), "binding_id").select("binding_id", "type", "regex")
    return keys.crossJoin(side).where(compatible(F.col("type"), F.col("keyword")) & F.rlike("text", F.col("regex"))).select("key", "keyword", "binding_id")


def matches(keys: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """(key, keyword, binding_id): every binding of every different step."""
    parts = (f(keys, bindings, compiled) for f in (literal_matches, indexed_matches, scanned_matches))
    first, second, third = parts
    return first.unionByName(second).unionByName(third)


def usages(steps: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each step and binding that it uses."""
    keyed = steps.withColumn("key", step_key(F.col("text")))
    m = matched.withColumnsRenamed({"key": "m_key", "keyword": "m_keyword"})
    return keyed.join(m, (F.col("key") == F.col("m_key")) & F.col("keyword").eqNullSafe(F.col("m_keyword"))).drop("m_key", "m_keyword", "key")


def literal_counts(steps: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """(binding_id, n): how many steps plain-text bindings have. Bindings are few and sent to the steps, which aren't."""
    plain = bindings.join(compiled.where("is_literal").select("binding_id"), "binding_id").select("binding_id", "type", step_key(F.col("pattern")))
    met = steps.select(step_key(F.col("text")), "keyword").join(F.broadcast(plain), "key").where(compatible(F.col("type"), F.col("keyword")))
    return met.groupBy("binding_id").agg(F.count("*").alias("n"))


def expression_counts(steps: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """(binding_id, n): how many steps the other bindings have. Steps are counted by key first, so no step row is multiplied."""
    counted = steps.groupBy(step_key(F.col("text")), "keyword").agg(F.min_by("text", F.struct("path", "ord")).alias("text"), F.count("*").alias("n"))
    keys = counted.select("key", "keyword", "text")
    matched = indexed_matches(keys, bindings, compiled).unionByName(scanned_matches(keys, bindings, compiled)).withColumnsRenamed({"key": "m_key", "keyword": "m_keyword"})
    return counted.join(matched, (F.col("key") == F.col("m_key")) & F.col("keyword").eqNullSafe(F.col("m_keyword"))).groupBy("binding_id").agg(F.sum("n").alias("n"))


def usage_counts(steps: DataFrame, bindings: DataFrame, compiled: DataFrame) -> DataFrame:
    """bindings with usage_count and reason. Steps are read once for plain-text bindings, and again only if there are others."""
    n = literal_counts(steps, bindings, compiled)
    if not compiled.where("regex is not null and not is_literal and kind <> 'never'").isEmpty():
        n = n.unionByName(expression_counts(steps, bindings, compiled))
    n = n.groupBy("binding_id").agg(F.sum("n").alias("usage_count"))
    return bindings.join(compiled.select("binding_id", "reason"), "binding_id").join(n, "binding_id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)).cast("long"))


def coverage_summary(counted: DataFrame) -> DataFrame:
    """One row: total, used, unused, indeterminate, coverage."""
    used, unknown = F.col("usage_count") > 0, F.col("reason").isNotNull()
    found = counted.agg(F.count("*").alias("total"), F.count_if(used).alias("used"), F.count_if(~used & ~unknown).alias("unused"), F.count_if(~used & unknown).alias("indeterminate"))
    return found.withColumn("coverage", F.when(F.col("total") > 0, F.col("used").cast("double") / F.col("total") * 100).otherwise(100.0))


def unused(counted: DataFrame) -> DataFrame:
    return counted.where("usage_count = 0 and reason is null").orderBy("path", "line_no")


def indeterminate(counted: DataFrame) -> DataFrame:
    """Bindings without a known use whose expression can't be evaluated, with the reason."""
    return counted.where("usage_count = 0 and reason is not null").orderBy("path", "line_no")


def single_use(counted: DataFrame) -> DataFrame:
    return counted.where("usage_count = 1").orderBy("path", "line_no")


def most_used(counted: DataFrame, n: int = 20) -> DataFrame:
    return counted.orderBy(F.desc("usage_count"), "binding_id").limit(n)


def accepted(unused: DataFrame, issues: DataFrame) -> DataFrame:
    """unused with the comment of the first known issue (ord, source_file, method, comment) that names its method and,
    if it names a file, ends its path; null if none."""
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    i = issues.select(F.col("ord").alias("i_ord"), F.col("source_file").alias("i_file"), F.col("method").alias("i_method"), F.col("comment").alias("i_comment"))
    hit = (F.col("method") == F.col("i_method")) & ((F.col("i_file") == "") | F.endswith(plain(F.col("path")), plain(F.col("i_file"))))
    first = unused.join(i, hit).groupBy("binding_id").agg(F.min_by("i_comment", "i_ord").alias("comment"))
    return unused.join(first, "binding_id", "left")


def line_gap(partition: list[str]) -> Column:
    """Lines since the one before in the partition."""
    return F.col("line_no") - F.lag("line_no").over(Window.partitionBy(*partition).orderBy("line_no"))


def without_aliases(bindings: DataFrame, partition: Iterable[str] = ()) -> DataFrame:
    """Of attributes on one method no more than five lines apart, that with the preferred type; others stay."""
    keys = [*partition, "path", "method"]
    preference = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("type")), F.lit(0))
    gap = bindings.withColumn("__gap", line_gap(keys))
    wide = gap.withColumn("__wide", F.max("__gap").over(Window.partitionBy(*keys)))
    first = wide.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(preference, "binding_id")))
    return first.where("__wide is null or __wide > 5 or __first = 1").drop("__gap", "__wide", "__first")


def duplicate_definitions(bindings: DataFrame) -> DataFrame:
    """(pattern, definitions, projects, cross_project): patterns that several bindings have, whatever their case, aliases
    left out."""
    keyed = bindings.withColumn("normal", F.lower(strip_match(F.col("pattern"))))
    found = without_aliases(keyed, ["normal"]).groupBy("normal").agg(F.min_by("pattern", "binding_id").alias("pattern"), F.count("*").alias("definitions"), F.array_sort(F.collect_set("project")).alias("projects"))
    found = found.where("definitions > 1").withColumn("cross_project", F.size("projects") > 1)
    return found.select("pattern", "definitions", "projects", "cross_project").orderBy(F.desc("cross_project"), F.desc("definitions"), "pattern")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BINDING)
