"""Declarations that nothing refers to, and what becomes unused with unused bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import cut
from stepweave.settings import UnusedCodeSettings
from stepweave.sources.files import wildcard

CONTAINERS = (
    "IObjectContainer IServiceProvider IServiceScope IServiceCollection IContainer ContainerBuilder IApplicationBuilder WebApplicationBuilder IWebHostBuilder IHostBuilder IKernel IUnityContainer IWindsorContainer"
).split()


def _excluded_name(settings: UnusedCodeSettings) -> Column:
    found = F.lit(False)
    for pattern in settings.exclude_patterns:
        found = found | F.col("name").rlike(wildcard(pattern))
    return found


def _excluded_attribute(settings: UnusedCodeSettings) -> Column:
    short = [F.lit(a.lower().removesuffix("attribute")) for a in settings.exclude_attributes]
    return F.arrays_overlap(F.transform("attributes", F.lower), F.array(*short)) if short else F.lit(False)


def _visible(settings: UnusedCodeSettings, methods: bool) -> Column:
    level = F.col("visibility")
    out = F.lit(settings.include_public_members) | ~level.isin("public", "protected")
    if methods:
        out &= F.lit(settings.include_private_methods) | (level != "private")
        out &= F.lit(settings.include_internal_methods) | ~level.isin("internal", "private protected", "protected internal")
    return out


def interface_methods(declarations: DataFrame) -> DataFrame:
    """(id) of methods that an interface of their type, or of a base, declares by name and number of parameters. Types whose
    bases aren't in the sources may implement anything publicly."""
    types = declarations.where("kind <> 'Method'").select("type_id", "name", "kind", "bases")
    edges = types.select(F.col("name").alias("child"), F.explode("bases").alias("base")).distinct()
    reach = cut(edges)
    frontier = reach
    while not frontier.isEmpty():
        step = frontier.join(edges.select(F.col("child").alias("base"), F.col("base").alias("next")), "base").select("child", F.col("next").alias("base")).distinct()
        frontier = cut(step.join(reach, ["child", "base"], "left_anti"))
        reach = cut(reach.union(frontier))
    methods = declarations.where("kind = 'Method'")
    contract = methods.join(types.where("kind = 'Interface'").select("type_id", F.col("name").alias("base")), "type_id").select("base", "name", F.size("parameter_types").alias("n"))
    inherited = reach.join(contract, "base").select(F.col("child").alias("containing"), "name", "n").distinct()
    known = types.select(F.col("name").alias("base")).distinct()
    foreign = reach.join(known, "base", "left_anti").select(F.col("child").alias("containing")).distinct()
    own = methods.join(inherited, (methods["containing"] == inherited["containing"]) & (methods["name"] == inherited["name"]) & (F.size("parameter_types") == F.col("n")), "left_semi").select("id")
    open_ended = methods.where("visibility = 'public'").join(foreign, "containing", "left_semi").select("id")
    return own.union(open_ended).distinct()


def method_candidates(declarations: DataFrame, settings: UnusedCodeSettings) -> DataFrame:
    """Methods that may be reported: not abstract, override, part of a contract, a hook or excluded."""
    plain = ~F.col("is_abstract") & ~F.col("is_override") & ~F.col("is_explicit")
    hook = F.arrays_overlap("parameter_types", F.array(*map(F.lit, CONTAINERS)))
    kept = declarations.where((F.col("kind") == "Method") & plain & _visible(settings, True) & ~_excluded_name(settings) & ~_excluded_attribute(settings) & ~hook)
    return kept.join(interface_methods(declarations), "id", "left_anti")


def type_candidates(declarations: DataFrame, settings: UnusedCodeSettings) -> DataFrame:
    kinds = [k for k, on in (("Class", settings.analyze_classes), ("Interface", settings.analyze_interfaces)) if on]
    kept = declarations.where(F.col("kind").isin(*kinds) & _visible(settings, False) & ~_excluded_name(settings) & ~_excluded_attribute(settings) & ~F.col("has_main"))
    parts = kept.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("path", "line_no")))
    return parts.where("__n = 1").drop("__n")


def _names(references: DataFrame) -> DataFrame:
    return references.groupBy("name").agg(F.max("arguments").alias("arguments"), F.bool_or(F.col("arguments") < 0).alias("bare"))


def referenced_methods(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(id) of methods whose name is used without a call, or called with enough arguments."""
    names = _names(references).withColumnsRenamed({"name": "r_name"})
    holds = (F.col("name") == F.col("r_name")) & (F.col("bare") | (F.col("arguments") >= F.col("least")))
    return declarations.where("kind = 'Method'").join(names, holds, "left_semi").select("id", "type_id")


def referenced_types(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(id) of types whose name is used, as an attribute too, or a method of which is."""
    names = references.select("name").distinct()
    types = declarations.where("kind <> 'Method'")
    by_name = types.join(names, "name", "left_semi").select("id")
    short = types.where("endswith(name, 'Attribute')").withColumn("name", F.regexp_replace("name", "Attribute$", "")).join(names, "name", "left_semi").select("id")
    return by_name.union(short).union(referenced_methods(declarations, references).select(F.col("type_id").alias("id"))).distinct()


def literal_hints(literals: DataFrame) -> DataFrame:
    """(name, hint): string literals that could be a name, with the first place."""
    shaped = literals.where(F.col("value").rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$"))
    place = F.concat(F.substring_index("path", "/", -1), F.lit(":"), F.col("line_no").cast("string"))
    return shaped.groupBy(F.col("value").alias("name")).agg(F.min_by(place, F.struct("path", "line_no")).alias("hint"))


def without_names(candidates: DataFrame, markup: DataFrame) -> DataFrame:
    """candidates whose name markup (name) doesn't mention."""
    return candidates.join(markup, "name", "left_anti")


def unused_code(declarations: DataFrame, references: DataFrame, literals: DataFrame, markup: DataFrame, settings: UnusedCodeSettings) -> DataFrame:
    """(kind, project?, path, line_no, containing, name, visibility, signature, hint) of candidates that neither code nor
    markup (name) refers to."""
    found = []
    if settings.analyze_methods:
        found.append(method_candidates(declarations, settings).join(referenced_methods(declarations, references), "id", "left_anti"))
    if settings.analyze_classes or settings.analyze_interfaces:
        found.append(type_candidates(declarations, settings).join(referenced_types(declarations, references), "id", "left_anti"))
    if not found:
        return declarations.limit(0).withColumn("hint", F.lit(None).cast("string"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return without_names(every, markup).join(literal_hints(literals), "name", "left")


def totals(declarations: DataFrame, settings: UnusedCodeSettings) -> DataFrame:
    """(kind, scanned): methods after candidacy, types before."""
    methods = method_candidates(declarations, settings).groupBy("kind").agg(F.count("*").alias("scanned"))
    types = declarations.where("kind <> 'Method'").select("kind", "id").distinct().groupBy("kind").agg(F.count("*").alias("scanned"))
    return methods.unionByName(types)


def fixpoint(declared: DataFrame, references: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, round) of what newly dies: in each round the reportable methods of declared (id, reportable) that no live method
    and no code outside methods refers to by references (from_id, to_id). dead (id) grows, so this ends."""
    rounds, k = None, 0
    dead = cut(dead.select("id").distinct())
    while True:
        k += 1
        live = references.join(dead.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(F.col("to_id").alias("id")).distinct()
        new = cut(declared.where("reportable").select("id").join(dead, "id", "left_anti").join(live, "id", "left_anti").withColumn("round", F.lit(k)))
        rounds = new if rounds is None else rounds.union(new)
        if new.isEmpty():
            return rounds
        dead = cut(dead.union(new.select("id")))


def cascade(declared: DataFrame, references: DataFrame, seed: DataFrame) -> DataFrame:
    """(id, round): methods that die because those of seed (id) do. What is dead while the seed lives is no consequence."""
    if seed.isEmpty():
        return seed.select("id", F.lit(0).alias("round")).limit(0)
    baseline = fixpoint(declared, references, seed.limit(0)).select("id")
    return fixpoint(declared, references, seed.select("id").union(baseline))


def reference_graph(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """(from_id, to_id): references (name, arguments, enclosing) to the methods that they can mean; from_id is null outside
    methods."""
    m = declarations.where("kind = 'Method'").select(F.col("id").alias("to_id"), F.col("name").alias("m_name"), "least")
    holds = (F.col("name") == F.col("m_name")) & ((F.col("arguments") < 0) | (F.col("arguments") >= F.col("least")))
    return references.join(m, holds).select(F.col("enclosing").alias("from_id"), "to_id").distinct()


def seed_methods(dead_bindings: DataFrame, declarations: DataFrame) -> DataFrame:
    """(id) of the methods of bindings (path, class, method, line_no): of overloads the nearest at or after the attribute."""
    m = declarations.where("kind = 'Method'").select("id", F.col("path").alias("m_path"), F.col("containing").alias("m_class"), F.col("name").alias("m_name"), F.col("line_no").alias("m_line"))
    hit = dead_bindings.join(m, (F.col("path") == F.col("m_path")) & (F.col("class") == F.col("m_class")) & (F.col("method") == F.col("m_name")))
    all_of = Window.partitionBy("binding_id")
    many = hit.withColumn("__n", F.count("*").over(all_of)).where("__n = 1 or m_line >= line_no")
    near = many.withColumn("__k", F.row_number().over(all_of.orderBy("m_line", "id")))
    return near.where("__k = 1").select("id").distinct()
