"""Duplicate scenarios: pairs that share most steps, their kind, and groups by their first scenario.

Scenarios are (project, feature, ord, path, line_no, fingerprint, step_fps, step_texts, norm_texts). Pairs share enough
fingerprints to be accepted only if they share one of the rarest few of each, so candidates come from an equi-join on
those; scenarios that share only frequent steps never meet. With fuzzy matching candidates pass the bounds of filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import digest, normalize_fuzzy, similarity_of, step_signature
from stepweave.operators import filters
from stepweave.session import cut, ready
from stepweave.settings import AnalysisSettings

MEMBER = ("ord", "path", "line_no", "feature")
PAIR_COLUMNS = ("ord", "path", "line_no", "feature", "fingerprint", "step_fps", "step_texts", "norm_texts", "plain_texts")


def size_prune(n1: Column, n2: Column, threshold: float) -> Column:
    """Whether the numbers of steps are near enough. In double arithmetic, by which 4 and 5 steps are too far at 80."""
    allowed = F.greatest(n1, n2) * (F.lit(1.0) - F.lit(float(threshold)) / F.lit(100.0).cast("double"))
    return F.abs(n1 - n2) <= allowed


def overlap(a: Column, b: Column) -> Column:
    """Different shared fingerprints for 100 steps of the smaller scenario."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.bround(F.size(F.array_intersect(a, b)).cast("double") / smaller * 100, 1)).otherwise(0.0)


def only_in(a: Column, b: Column) -> Column:
    """Elements of a that b lacks; repeats stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def same_sequence(a: Column, b: Column) -> Column:
    """Whether the shared elements, with repeats, come in one order."""
    x, y = F.filter(a, lambda e: F.array_contains(b, e)), F.filter(b, lambda e: F.array_contains(a, e))
    return (F.size(x) > 0) & (x == y)


def comparable(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    return scenarios.where(F.size("step_fps") >= settings.min_steps_for_scenario_comparison)


def located(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Scenarios that can be in pairs, with home, within which they are compared, and kind, by their steps in order."""
    known = comparable(scenarios, settings).where("project is not null and ord is not null and path is not null and line_no is not null")
    if settings.enable_cross_feature_comparison:
        home = ["project"]
    else:
        known, home = known.where("feature is not null"), ["project", "feature"]
    return known.withColumn("home", F.to_json(F.struct(*home))).withColumn("kind", digest(F.array_join("step_fps", "||"), 24))


def kinds(scenarios: DataFrame) -> DataFrame:
    """A row for each home and kind, with its first scenario and the first that stands elsewhere (structs one and two): of all
    its scenarios only these can be in the first pair with another kind. Whether a pair is accepted hangs on its kinds
    alone, and not on which comes first: as each side takes steps in order, greedy matching gives the same pairs of
    steps from either side."""
    names = [c for c in PAIR_COLUMNS if c in scenarios.columns and c not in MEMBER]
    each = scenarios.select("home", "kind", "project", F.size("step_fps").alias("n"), F.struct(*MEMBER).alias("m"), *names).repartition("home", "kind")
    place = each.withColumn("__i", F.row_number().over(Window.partitionBy("home", "kind", "m.path", "m.line_no").orderBy("m.ord"))).where("__i = 1")
    w = Window.partitionBy("home", "kind").orderBy("m.ord")
    first = place.withColumn("__i", F.row_number().over(w)).where("__i <= 2")
    return first.withColumn("two", F.lead("m").over(w)).where("__i = 1").withColumnRenamed("m", "one").drop("__i")


def _side(found: DataFrame, at: str) -> DataFrame:
    return found.select("home", *(F.col(c).alias(f"{at}_{c}") for c in found.columns if c != "home"))


def least_shared(n: Column, settings: AnalysisSettings) -> Column:
    """Of the smaller scenario's n steps those that must match. Rounding to one decimal can lift a share by 0.05."""
    return F.ceil(n * ((settings.scenario_overlap_threshold - 0.06) / 100) - 1e-9)


def exact_candidates(found: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """(home, x, y), x < y: pairs of kinds that can reach the threshold by equal steps. Of a scenario of n steps, d of them
    different, a partner of the least size allowed needs t shared steps, so one of the d - t + 1 rarest is shared: only
    these are joined on, and only where the steps before and after in that order allow t."""
    ratio = settings.scenario_overlap_threshold / 100.0
    steps = F.array_distinct("step_fps")
    distinct = found.select("home", "kind", F.explode(steps).alias("fp"), F.size(steps).alias("d"), "n")
    frequency = distinct.groupBy("home", "fp").agg(F.count("*").alias("f"))
    ranked = distinct.join(frequency.where("f > 1"), ["home", "fp"], "left")
    place = F.row_number().over(Window.partitionBy("home", "kind").orderBy(F.coalesce("f", F.lit(1)), "fp"))
    needed = F.greatest(F.lit(1), least_shared(F.ceil(F.col("n") * ratio - 1e-9), settings))
    keys = ranked.withColumn("i", place).where((F.col("f") > 1) & (F.col("i") <= F.col("d") - needed + 1)).select("home", "fp", "kind", "d", "n", "i")
    a = keys.withColumnsRenamed({"kind": "x", "d": "a_d", "n": "a_n", "i": "a_i"})
    b = keys.withColumnsRenamed({"kind": "y", "d": "b_d", "n": "b_n", "i": "b_i"})
    both = least_shared(F.least("a_n", "b_n"), settings)
    left = F.least("a_i", "b_i") + F.least(F.col("a_d") - F.col("a_i"), F.col("b_d") - F.col("b_i"))
    met = a.join(b, ["home", "fp"]).where((F.col("x") < F.col("y")) & size_prune(F.col("a_n"), F.col("b_n"), settings.scenario_overlap_threshold))
    return met.where((left >= both) & (F.col("a_i") <= F.col("a_d") - both + 1) & (F.col("b_i") <= F.col("b_d") - both + 1)).select("home", "x", "y").distinct()


def with_self(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of kinds, and each kind with itself that stands in two places."""
    return pairs.select("home", "x", "y").union(found.where("two is not null").select("home", F.col("kind").alias("x"), F.col("kind").alias("y")))


def _joined(pairs: DataFrame, found: DataFrame) -> DataFrame:
    return pairs.join(_side(found, "x").withColumnRenamed("x_kind", "x"), ["home", "x"]).join(_side(found, "y").withColumnRenamed("y_kind", "y"), ["home", "y"])


def _first_pair(joined: DataFrame) -> DataFrame:
    """Of pairs of kinds (columns x_ and y_) the first pair of scenarios, as columns a_ and b_."""
    pair = lambda a, b, turned: F.struct(F.col(f"{a}.ord").alias("i"), F.col(f"{b}.ord").alias("j"), F.lit(turned).alias("turned"), F.col(a).alias("a"), F.col(b).alias("b"))
    ways = [pair(f"x_{p}", f"y_{q}", False) for p in ("one", "two") for q in ("one", "two")] + [pair(f"y_{q}", f"x_{p}", True) for p in ("one", "two") for q in ("one", "two")]
    apart = lambda w: (w["a"]["path"] != w["b"]["path"]) | (w["a"]["line_no"] != w["b"]["line_no"])
    found = joined.withColumn("w", F.array_min(F.filter(F.array(*ways), lambda w: (w["i"] < w["j"]) & apart(w)))).where("w is not null")
    names = [c[2:] for c in joined.columns if c[:2] == "x_" and c[2:] not in ("one", "two", "kind", "n", "project", "signature", "bucketed", "wild")]
    turn = lambda side, name: F.when(F.col("w.turned"), F.col(f"{'yx'[side]}_{name}")).otherwise(F.col(f"{'xy'[side]}_{name}"))
    members = [F.col(f"w.{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in MEMBER]
    return found.select(F.col("x_project").alias("project"), *members, *(turn(k, c).alias(f"{side}_{c}") for k, side in enumerate("ab") for c in names))


def exact_pairs(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Accepted pairs by equal steps alone, one for each pair of scenario fingerprints: the first by project and order."""
    found = cut(kinds(located(scenarios, settings)))
    joined = _joined(with_self(found, exact_candidates(found, settings)), found)
    x, y, few = F.col("x_step_fps"), F.col("y_step_fps"), settings.max_unique_steps_for_duplicate
    near = size_prune(F.col("x_n"), F.col("y_n"), settings.scenario_overlap_threshold) & (overlap(x, y) >= settings.scenario_overlap_threshold)
    ok = joined.where(near).where((F.size(only_in(x, y)) <= few) & (F.size(only_in(y, x)) <= few))
    return with_scores(first_of_fingerprints(_first_pair(ok)))


def with_scores(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_step_fps"), F.col("b_step_fps")
    return pairs.select(
        "*",
        F.size(F.array_intersect(a, b)).alias("matching"),
        overlap(a, b).alias("overlap"),
        only_in(a, b).alias("unique_a"),
        only_in(b, a).alias("unique_b"),
        same_sequence(a, b).alias("same_sequence"),
    )


def first_of_fingerprints(pairs: DataFrame) -> DataFrame:
    """A pair of scenario fingerprints counts once, over all projects. Projects are in the order of their first scenario."""
    every = cut(pairs)
    start = every.groupBy("project").agg(F.min("a_ord").alias("__start"))
    w = Window.partitionBy(F.least("a_fingerprint", "b_fingerprint"), F.greatest("a_fingerprint", "b_fingerprint")).orderBy("__start", "a_ord", "b_ord")
    return every.join(F.broadcast(start), "project").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__start")


#: Scenarios of a bucket that one task pairs with as many others.
CHUNK = 1024


def reach(n: Column, settings: AnalysisSettings) -> tuple[Column, Column]:
    """The numbers of steps, first and last, whose buckets a scenario of n steps is in."""
    ratio = F.lit(float(settings.scenario_overlap_threshold)) / F.lit(100.0).cast("double")
    return F.ceil(n * ratio).cast("int"), F.least(F.floor(n / ratio), n + 10).cast("int")


def sizes_apart(a_n: Column, b_n: Column, settings: AnalysisSettings) -> Column:
    """Whether scenarios of so many steps, not equally many, share a number of steps in reach."""
    (a_from, a_to), (b_from, b_to) = reach(a_n, settings), reach(b_n, settings)
    # a sequence counts down where the last is less than the first
    low, high = F.greatest(F.least(a_from, a_to), F.least(b_from, b_to)), F.least(F.greatest(a_from, a_to), F.greatest(b_from, b_to))
    return (a_n != b_n) & (low <= high)


def met_in_buckets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of left (a_ord) with those of right (b_ord) of the same keys, a_ord < b_ord; large buckets in many tasks, so
    that none has more than CHUNK with CHUNK."""
    count = left.groupBy(*keys).agg(F.count("*").alias("__f"))
    parts = F.ceil(F.col("__f") / CHUNK).cast("int")
    of = lambda c: F.pmod(F.xxhash64(c), F.col("__g")).cast("int")
    sized = count.select(*keys, parts.alias("__g"))
    a = left.join(sized, keys).withColumn("__i", of("a_ord")).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__g") - 1))).drop("__g")
    b = right.join(sized, keys).withColumn("__j", of("b_ord")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__g") - 1))).drop("__g")
    return a.join(b, [*keys, "__i", "__j"]).where("a_ord < b_ord").drop("__i", "__j")


def blocked_pairs(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """(project, a_ord, b_ord) that share a bucket: the number of steps, or a number of steps in reach together with the
    signature of the first three. Pairs that differ in both are lost, as blocking means. A pair is found once: by its
    number of steps, or else by signature, so nothing is made distinct afterwards."""
    s = cut(scenarios.where("project is not null and ord is not null").select("project", "ord", F.size("step_fps").alias("n"), step_signature(F.col("step_fps")).alias("signature")).dropDuplicates())
    a = s.select("project", F.col("ord").alias("a_ord"), F.col("n").alias("a_n"), "signature", "n")
    b = s.select("project", F.col("ord").alias("b_ord"), F.col("n").alias("b_n"), "signature", "n")
    same = met_in_buckets(a.drop("signature", "a_n"), b.drop("signature", "b_n"), ["project", "n"])
    near = met_in_buckets(a.drop("n"), b.drop("n"), ["project", "signature"]).where(sizes_apart(F.col("a_n"), F.col("b_n"), settings))
    found = same.select("project", "a_ord", "b_ord").union(near.select("project", "a_ord", "b_ord"))
    # several scenarios of one ord may be paired in both ways
    return found if s.groupBy("project", "ord").agg(F.count("*").alias("f")).where("f > 1").isEmpty() else found.distinct()


def greedy(settings: AnalysisSettings) -> tuple[Column, Column, Column]:
    """Of the steps that a pair's scenarios don't share: their indexes in a and in b, and each of a with the first unused one
    of b that is near enough (array of structs i, j, near). The columns are those of both sides; texts are normalised."""
    shared = F.array_intersect("a_step_fps", "b_step_fps")
    rest = lambda side: F.filter(F.sequence(F.lit(0), F.size(f"{side}_step_fps") - 1), lambda i: ~F.array_contains(shared, F.get(F.col(f"{side}_step_fps"), i)))
    get = lambda side, name, i: F.get(F.col(f"{side}_{name}"), i)

    def near(i: Column, j: Column) -> Column:
        found = F.lit(0.0)
        if settings.enable_fuzzy_matching:
            found = similarity_of(get("a", "plain_texts", i), get("b", "plain_texts", j), settings.fuzzy_match_threshold)
        if settings.enable_parameter_agnostic_matching:
            found = F.when(get("a", "norm_texts", i) == get("b", "norm_texts", j), 100.0).otherwise(found)
        return found

    def step(done: Column, i: Column) -> Column:
        unused = F.filter("rest_b", lambda j: ~F.exists(done, lambda d: d["j"] == j))
        # an array of one, so that a similarity is computed once; after the first that is near enough no more are
        hit = lambda j: F.get(F.transform(F.array(near(i, j)), lambda v: F.when(v >= settings.fuzzy_match_threshold, F.struct(i.alias("i"), j.alias("j"), v.alias("near")))), F.lit(0))
        first = F.aggregate(unused, F.lit(None).cast("struct<i:int,j:int,near:double>"), lambda got, j: F.when(got.isNotNull(), got).otherwise(hit(j)))
        return F.get(F.transform(F.array(first), lambda m: F.when(m.isNotNull(), F.array_append(done, m)).otherwise(done)), F.lit(0))

    return rest("a"), rest("b"), F.aggregate("rest_a", F.array().cast("array<struct<i:int,j:int,near:double>>"), step)


def match_type(near: Column) -> Column:
    """Of an array of similarities."""
    exact, fuzzy = F.exists(near, lambda x: x == 100), F.exists(near, lambda x: x < 100)
    return F.when(exact & fuzzy, "Mixed").when(exact, "ParameterVariation").when(fuzzy, "FuzzyMatch").otherwise("Exact")


def with_fuzzy_scores(pairs: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Equal steps, then near ones greedily, in the JVM."""
    rest_a, rest_b, found = greedy(settings)
    # computed once: in one projection each use of a column, in each element of an array, would compute it again
    x = cut(cut(pairs.withColumns({"rest_a": rest_a, "rest_b": rest_b})).withColumn("near", found))
    a, b = F.col("a_step_fps"), F.col("b_step_fps")
    texts = lambda side, key: F.transform("near", lambda m: F.get(F.col(f"{side}_step_texts"), m[key]))
    left = lambda side, key: F.filter(F.transform(f"rest_{side}", lambda i: F.get(F.col(f"{side}_step_texts"), i)), lambda t: ~F.array_contains(texts(side, key), t))
    matching, smaller = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    shared = F.filter(F.arrays_zip(F.col("a_step_texts").alias("t"), a.alias("f")), lambda s: F.array_contains(b, s["f"]))
    return x.select(
        *pairs.columns,
        overlap(a, b).alias("overlap"),
        F.when(smaller > 0, F.bround((matching + F.size("near")).cast("double") / smaller * 100, 1)).otherwise(0.0).alias("fuzzy"),
        matching.alias("matching"),
        F.size("near").alias("additional"),
        same_sequence(a, b).alias("same_sequence"),
        match_type(F.col("near.near")).alias("match_type"),
        F.transform(shared, lambda s: s["t"]).alias("matching_texts"),
        left("a", "i").alias("unique_a"),
        left("b", "j").alias("unique_b"),
    )


def duplicate_type(matching: Column, n_a: Column, n_b: Column, overlap: Column, match: Column) -> Column:
    """Of a group by its best match, the first that holds: the base is contained, it contains, equal, by how steps match."""
    return (
        F.when((matching == n_a) & (n_b > n_a), "Superset")
        .when((matching == n_b) & (n_a > n_b), "Subset")
        .when((F.abs(overlap - 100) < 0.1) & (n_a == n_b), "Exact")
        .when(match == "ParameterVariation", "ParameterVariation")
        .when(match == "FuzzyMatch", "FuzzyMatch")
        .otherwise("HighOverlap")
    )


def large_projects(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """(project) of those with more pairs than max_comparisons_per_project."""
    n = scenarios.groupBy("project").agg(F.count("*").alias("n"))
    return n.where(F.col("n") * (F.col("n") - 1) / 2 > settings.max_comparisons_per_project).select("project")


def filtered_pairs(found: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """(home, x, y): pairs of kinds of which bounds on lengths and letters don't say that too few texts match. Where bucketed, both
    have one number of steps, else numbers in reach. Kinds are dealt to parts, and parts are compared with parts."""
    part = F.greatest(F.lit(16), F.least(F.lit(CHUNK), F.floor(F.lit(200_000) / F.col("n"))))
    kept = found.where("not wild").select("home", "kind", "n", "bucketed", "plain_texts")
    schema = f"home string, kind string, n int, bucketed boolean, {filters.FEATURES}"
    ready(found.sparkSession)
    each = cut(kept.mapInArrow(filters.features, schema))
    sizes = each.groupBy("home", "n", "bucketed").agg(F.count("*").alias("f")).select("home", "n", "bucketed", F.ceil(F.col("f") / part).cast("int").alias("g"))
    a = sizes.withColumnsRenamed({"n": "a_n", "g": "a_g"})
    b = sizes.select("home", F.col("n").alias("b_n"), F.col("g").alias("b_g"))
    near = (F.col("a_n") == F.col("b_n")) | ~F.col("bucketed") & (F.col("a_n") < F.col("b_n")) & size_prune(F.col("a_n"), F.col("b_n"), settings.scenario_overlap_threshold)
    plan = cut(a.join(b, "home").where(near).drop("bucketed"))
    same, own = F.col("a_n") == F.col("b_n"), lambda g: F.pmod(F.xxhash64("kind"), F.col(g)).cast("int")
    none = F.array().cast("array<int>")
    left = each.join(plan, (each["home"] == plan["home"]) & (each["n"] == plan["a_n"])).drop(plan["home"]).withColumn("i", own("a_g"))
    left = left.withColumn("j", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(0), F.col("b_g") - 1))).withColumn("side", F.when(same & (F.col("i") == F.col("j")), 2).otherwise(0))
    right = each.join(plan, (each["home"] == plan["home"]) & (each["n"] == plan["b_n"])).drop(plan["home"]).withColumn("j", own("b_g"))
    before = F.when(same, F.col("j")).otherwise(F.col("a_g")) - 1
    right = right.withColumn("i", F.explode(F.when(before >= 0, F.sequence(F.lit(0), before)).otherwise(none))).withColumn("side", F.lit(1))
    names = ["home", "a_n", "b_n", "i", "j", "kind", "n", "side", "lengths", "letters"]
    near_percent = settings.fuzzy_match_threshold if settings.enable_fuzzy_matching else 100.0
    task = filters.candidates(settings.scenario_overlap_threshold, near_percent)
    return left.select(names).union(right.select(names)).groupBy("home", "a_n", "b_n", "i", "j").applyInArrow(task, filters.FOUND)


def candidates(found: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """(home, x, y): pairs of kinds to compare, each once. In a bucketed project they share a bucket. Those whose normalised
    texts aren't the ones that are compared by edits (wild) have no bounds and are all compared."""
    a = lambda f: f.select("home", F.col("kind").alias("x"), F.col("n").alias("a_n"), F.col("signature").alias("a_s"), "bucketed", F.col("wild").alias("a_w"))
    b = lambda f: f.select("home", F.col("kind").alias("y"), F.col("n").alias("b_n"), F.col("signature").alias("b_s"), F.col("wild").alias("b_w"))
    prune = size_prune(F.col("a_n"), F.col("b_n"), settings.scenario_overlap_threshold)
    wild = a(found.where("wild")).join(b(found), "home").where(prune & (~F.col("b_w") & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))) & (~F.col("bucketed") | (F.col("a_n") == F.col("b_n"))))
    left, right = a(found.where("bucketed")).withColumnRenamed("a_s", "s"), b(found.where("bucketed")).withColumnRenamed("b_s", "s")
    signed = left.join(right, ["home", "s"]).where(prune & (F.col("x") < F.col("y")) & sizes_apart(F.col("a_n"), F.col("b_n"), settings))
    ids = ["home", "x", "y"]
    return filtered_pairs(found, settings).select(ids).union(wild.select(ids)).union(signed.select(ids))


def pairs(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Accepted pairs by equal steps and with fuzzy step matching: of all pairs of a project, up to max_comparisons_per_project,
    beyond that of those that share a bucket or, with buckets off, of the first scenarios that the cap allows. Kinds
    are compared where bounds leave it open. Without fuzzy and parameter-agnostic matching pairs come from
    exact_pairs, with no cap."""
    if not settings.enable_fuzzy_matching and not settings.enable_parameter_agnostic_matching:
        found = exact_pairs(scenarios, settings)
        return found.select(*(c for c in found.columns if c[:2] in ("a_", "b_") or c == "project"), *_exact_scores())
    # written once: the kinds and the sizes of projects read it
    s = cut(located(scenarios, settings).withColumn("plain_texts", F.transform("step_texts", normalize_fuzzy)))
    large = large_projects(s, settings)
    if not settings.enable_bucket_optimization:
        s = cut(s.join(large, "project", "left_anti").unionByName(limited(s.join(large, "project", "left_semi"), settings)))
        large = large.limit(0)
    wild = F.lit(settings.enable_parameter_agnostic_matching) & (F.col("norm_texts") != F.col("plain_texts"))
    found = cut(kinds(s).join(large.withColumn("bucketed", F.lit(True)), "project", "left").withColumn("bucketed", F.coalesce("bucketed", F.lit(False))).withColumn("wild", wild).withColumn("signature", step_signature(F.col("step_fps"))))
    met = with_self(found, candidates(found, settings))
    joined = _first_pair(_joined(met, found))
    scored = with_fuzzy_scores(joined, settings).drop("a_plain_texts", "b_plain_texts")
    threshold, few = settings.scenario_overlap_threshold, settings.max_unique_steps_for_duplicate
    near = (F.col("overlap") >= threshold) | (F.lit(settings.enable_fuzzy_matching) & (F.col("fuzzy") >= threshold))
    return first_of_fingerprints(scored.where(near & (F.size("unique_a") <= few) & (F.size("unique_b") <= few)))


def _exact_scores() -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.col("overlap"), F.col("overlap").alias("fuzzy"), F.col("matching"), F.lit(0).alias("additional"), F.col("same_sequence"), F.lit("Exact").alias("match_type"), none.alias("matching_texts"), F.col("unique_a"), F.col("unique_b")]


def groups(pairs: DataFrame) -> DataFrame:
    """A row for each base scenario: its matches, best first, the kind of its best match, reuse, suggestions."""
    n_a, n_b = F.size("a_step_fps"), F.size("b_step_fps")
    match = F.struct((-F.col("overlap")).alias("o"), (-F.col("fuzzy")).alias("f"), F.col("b_ord"), "overlap", "fuzzy", "match_type", "same_sequence", "matching", "additional", "matching_texts", n_a.alias("n_a"), n_b.alias("n_b"))
    by_base = pairs.groupBy("project", "a_ord").agg(F.array_sort(F.collect_list(match)).alias("m"))
    # the best match is the first by overlap alone
    best = F.array_min(F.transform("m", lambda x, i: F.struct(x["o"], i, x.alias("x"))))["x"]
    g = by_base.withColumn("best", best)
    common = F.when(F.col("best.same_sequence") & (F.size("best.matching_texts") >= 2), F.slice("best.matching_texts", 1, 3)).otherwise(F.array().cast("array<string>"))
    return g.select(
        "project",
        F.col("a_ord").alias("ord"),
        F.size("m").alias("matches"),
        F.array_max("m.overlap").alias("best_overlap"),
        F.array_max("m.fuzzy").alias("best_fuzzy"),
        F.aggregate("m", F.lit(0), lambda s, x: s + x["matching"] + x["additional"]).alias("step_reuse"),
        duplicate_type(F.col("best.matching"), F.col("best.n_a"), F.col("best.n_b"), F.col("best.overlap"), F.col("best.match_type")).alias("duplicate_type"),
        F.exists("m", lambda x: (x["match_type"] == "ParameterVariation") & (x["overlap"] >= 90)).alias("suggest_outline"),
        common.alias("common_background"),
    )


def ranked(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("best_overlap"), F.desc("best_fuzzy"), F.desc("matches"), "project", "ord")


def limited(scenarios: DataFrame, settings: AnalysisSettings) -> DataFrame:
    """Where buckets are off, the first scenarios of each project that the comparison cap allows."""
    cap = settings.max_comparisons_per_project
    w = Window.partitionBy("project")
    counted = scenarios.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy("ord")))
    over = F.col("__n") * (F.col("__n") - 1) / 2 > cap
    return counted.where(~over | (F.col("__i") <= int((2 * cap) ** 0.5))).drop("__n", "__i")
