"""Step bindings of C# sources: which classes bind, by themselves or by inheritance, and what their parameter types are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.expressions import PARAMETER_TYPES, escape
from stepweave.session import cut
from stepweave.sources import csharp
from stepweave.sources.files import with_project


def merged_classes(classes: DataFrame) -> DataFrame:
    """(name, has_binding, bases): parts of one class, by simple name, as one."""
    return classes.groupBy("name").agg(F.bool_or("has_binding").alias("has_binding"), F.array_distinct(F.flatten(F.collect_list("bases"))).alias("bases"))


def binding_status(classes: DataFrame) -> DataFrame:
    """(name, status) of each class (name, has_binding, bases): Confirmed if it or an ancestor binds, else Unconfirmable if
    an ancestor isn't in the sources, else NotABinding. What a class is told (binds: true, or unknown: false) it tells those
    derived from it once, all classes at once, so cycles end; no pairs of class and ancestor are made. Joins are by
    sort, so that nothing is gathered on the driver."""
    own = cut(classes.select("name", "has_binding", "bases"))
    bases = cut(own.where("name is not null").select(F.col("name").alias("child"), F.explode("bases").alias("name")))
    known_names = own.where("name is not null").select("name").distinct()
    missing = bases.join(known_names.hint("merge"), "name", "left_anti").select(F.col("child").alias("name"), F.lit(False).alias("binds"))
    itself = own.where("has_binding is null or has_binding or name is null").select("name", F.coalesce(F.col("has_binding") & F.col("name").isNotNull(), F.lit(False)).alias("binds"))
    frontier = cut(itself.union(missing).distinct())
    told = [frontier]
    while not frontier.isEmpty():
        step = bases.join(frontier.hint("merge"), "name").select(F.col("child").alias("name"), "binds").distinct()
        seen = reduce(DataFrame.union, told)
        # what is known to bind needs not be told of unknown ancestors
        frontier = cut(step.join(seen.select("name", F.explode(F.when(F.col("binds"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("binds")).hint("merge"), ["name", "binds"], "left_anti"))
        told.append(frontier)
        if len(told) > 5:
            told = [cut(reduce(DataFrame.union, told).distinct().coalesce(classes.sparkSession.sparkContext.defaultParallelism))]
    every = reduce(DataFrame.union, told, own.select("name", F.lit(None).cast("boolean").alias("binds")))
    found = every.groupBy("name").agg(F.bool_or("binds").alias("yes"))
    return found.select("name", F.when(F.col("yes"), "Confirmed").when(~F.col("yes"), "Unconfirmable").otherwise("NotABinding").alias("status"))


def parameter_types(sources: DataFrame) -> dict[str, str]:
    """Built-in types, enumerations by name, and named transformations; later files replace earlier ones."""
    types = dict(PARAMETER_TYPES)
    for r in sources.select("path", "enums", "transforms").where("size(enums) + size(transforms) > 0").orderBy("path").collect():
        for e in r["enums"]:
            types[e["name"]] = f"(?i:{'|'.join(map(escape, e['members']))})"
        for t in r["transforms"]:
            types[t["name"]] = t["regex"]
    return types


def discover(sources: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Bindings of classes that bind, those of classes that may, and the parameter types, of parsed sources."""
    status = binding_status(merged_classes(csharp.explode(sources, "classes").where("is_class")))
    raw = csharp.explode(sources, "bindings")
    raw = raw.withColumn("binding_id", F.row_number().over(Window.orderBy("path", "line_no", "method", "type", "pattern")).cast("long"))
    known = with_project(raw, "Unknown").join(status, F.col("class") == F.col("name")).drop("name")
    return known.where("status = 'Confirmed'").drop("status"), known.where("status = 'Unconfirmable'").drop("status"), parameter_types(sources)


_LEGACY = r'\[(Given|When|Then|And|But|StepDefinition)\s*\(\s*@?"(.+?)"\s*\)\]'
_LEGACY_METHOD = r"(?:[\w<>\[\],?.]+)\s+(\w+)\s*\("


def legacy_bindings(files: DataFrame) -> DataFrame:
    """Bindings (path, project, content) by line patterns alone: the method is the first declared in the 14 lines after
    the attribute, the class the file's first, whether it binds or not."""
    lines = files.select("path", "project", F.regexp_extract("content", r"class\s+(\w+)", 1).alias("class"), F.posexplode(F.split("content", "\n")).alias("i", "line"))
    trimmed = F.ltrim("line")
    named = F.when(~F.startswith(trimmed, F.lit("[")), F.nullif(F.regexp_extract("line", _LEGACY_METHOD, 1), F.lit("")))
    stop = F.contains(trimmed, F.lit("class ")) & ~F.contains(trimmed, F.lit('"class'))
    after = Window.partitionBy("path").orderBy("i").rowsBetween(1, 14)
    first = F.min(F.when(stop, F.col("i"))).over(after)
    found = lines.withColumn("method", named).withColumn("stop", first)
    place = F.min(F.when(F.col("method").isNotNull(), F.struct("i", "method"))).over(after)
    each = found.withColumn("m", place).where(F.col("line").rlike(_LEGACY))
    method = F.when(F.col("stop").isNull() | (F.col("m.i") < F.col("stop")), F.col("m.method"))
    return each.select(
        F.monotonically_increasing_id().alias("binding_id"), "project", "path", F.coalesce(F.nullif("class", F.lit("")), F.lit("Unknown")).alias("class"), F.coalesce(method, F.lit("Unknown")).alias("method"),
        F.regexp_extract("line", _LEGACY, 1).alias("type"), F.regexp_extract("line", _LEGACY, 2).alias("pattern"), (F.col("i") + 1).alias("line_no"), F.lit(0).alias("parameter_count"), F.lit(False).alias("unresolvable"),
    )
