import random

import pytest
from brute import compare
from pyspark.sql import functions as F

from stepweave.functions import text as T
from stepweave.operators import scenarios as D
from stepweave.operators.gherkin import normalize
from stepweave.settings import AnalysisSettings


def frame(spark, rows):
    """rows: (project, steps)."""
    out = spark.createDataFrame([(p, i, "f", f"/{i}", 1, s, [normalize(x) for x in s]) for i, (p, s) in enumerate(rows)], "project string, ord long, feature string, path string, line_no int, step_texts array<string>, norm_texts array<string>")
    prints = out.withColumn("step_fps", F.transform("step_texts", lambda t: T.digest(t, 20)))
    return prints.withColumn("fingerprint", T.scenario_fingerprint(F.col("step_fps")))


def pairs(spark, rows, **settings):
    s = AnalysisSettings(**settings)
    return {(r["a_ord"], r["b_ord"]): r for r in D.pairs(frame(spark, rows), s).collect()}


ABC = ["alpha", "bravo", "charlie", "delta", "echo"]


def test_pair_memo_over_projects(spark):
    exact = {"enable_fuzzy_matching": False, "enable_parameter_agnostic_matching": False}
    rows = [("p", ABC), ("p", ABC[::-1]), ("p", ABC), ("q", ABC), ("q", ABC), ("p", ABC[:4])]
    for options in ({}, exact):
        found = pairs(spark, rows, **options)
        # 4 of 5 steps are too far in doubles; equal scenarios count once, over all projects
        assert set(found) == {(0, 1)}
        assert found[0, 1]["overlap"] == 100.0 and not found[0, 1]["same_sequence"]


def test_exact_equals_all_pairs(spark):
    import itertools

    r = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    rows = [("p", [r.choice(words) for _ in range(r.randrange(3, 11))]) for _ in range(90)]
    s = AnalysisSettings(enable_fuzzy_matching=False, enable_parameter_agnostic_matching=False, scenario_overlap_threshold=60)
    found = {(x["a_ord"], x["b_ord"]) for x in D.exact_pairs(frame(spark, rows), s).collect()}
    seen, expected = set(), set()
    for i, j in itertools.combinations(range(90), 2):
        a, b = rows[i][1], rows[j][1]
        shared, n = set(a) & set(b), min(len(a), len(b))
        key = tuple(sorted((tuple(sorted(a)), tuple(sorted(b)))))
        ok = abs(len(a) - len(b)) <= max(len(a), len(b)) * (1 - 60 / 100.0) and round(len(shared) / n * 100, 1) >= 60 and max(sum(x not in shared for x in y) for y in (a, b)) <= 5
        if ok and key not in seen:
            seen.add(key)
            expected.add((i, j))
    assert found == expected and expected


def test_fuzzy_matching_is_greedy(spark):
    a = ["user opens the red door", "count 5 pens", "third step here"]
    b = ["user opens the red doors", "count 7 pens", "third step here"]
    m = pairs(spark, [("p", a), ("p", b)])[0, 1]
    assert (m["overlap"], m["fuzzy"], m["match_type"], m["additional"]) == (33.3, 100.0, "Mixed", 2) and m["unique_a"] == m["unique_b"] == []
    m = pairs(spark, [("p", ["x is 1", "x is 2", "end here"]), ("p", ["x is 3", "x is 4", "end here"])])[0, 1]
    assert m["match_type"] == "ParameterVariation" and m["additional"] == 2


def test_pairs_match_brute_force_with_any_setting(spark):
    r = random.Random(4)
    words = "the user opens page types word saves file number one two".split()
    line = lambda: f"{' '.join(r.choice(words) for _ in range(4))} {r.randrange(3)}"
    rows = []
    for k in range(14):
        base = [line() for _ in range(r.randrange(3, 7))]
        vary = lambda t: t.replace("0", "1") if r.random() < 0.3 else t + "s" if r.random() < 0.3 else t
        rows += [("pq"[k % 2], base), ("pq"[k % 2], [vary(t) for t in base]), ("pq"[k % 2], [vary(t) for t in base] + [line()] * (k % 3))]
    for options in ({}, {"enable_parameter_agnostic_matching": False}, {"enable_fuzzy_matching": False}, {"max_comparisons_per_project": 20}, {"max_comparisons_per_project": 20, "enable_bucket_optimization": False}):
        s = AnalysisSettings(**options)
        one = lambda t: {"step_fps": t, "step_texts": t, "norm_texts": [normalize(x) for x in t]}
        blocked = {(x["a_ord"], x["b_ord"]) for x in D.blocked_pairs(D.comparable(frame(spark, rows), s), s).collect()}
        expected, seen = {}, set()
        for project in "pq":
            own = [i for i, (p, t) in enumerate(rows) if p == project]
            few = len(own) * (len(own) - 1) / 2 <= s.max_comparisons_per_project
            if not few and not s.enable_bucket_optimization:
                own = own[: int((2 * s.max_comparisons_per_project) ** 0.5)]
            for i in own:
                for j in own:
                    a, b = rows[i][1], rows[j][1]
                    if i >= j or not few and s.enable_bucket_optimization and (i, j) not in blocked or abs(len(a) - len(b)) > max(len(a), len(b)) * (1.0 - 80.0 / 100.0):
                        continue
                    m = compare(one(a), one(b), s)
                    key = tuple(sorted((tuple(sorted(a)), tuple(sorted(b)))))
                    if (m.overlap >= 80 or s.enable_fuzzy_matching and m.fuzzy >= 80) and max(len(m.unique_a), len(m.unique_b)) <= 5 and key not in seen:
                        seen.add(key)
                        expected[i, j] = (m.overlap, m.fuzzy, m.matching, m.additional, m.same_sequence, m.match_type, m.matching_texts, m.unique_a, m.unique_b)
        found = {k: tuple(v[c] for c in "overlap fuzzy matching additional same_sequence match_type matching_texts unique_a unique_b".split()) for k, v in pairs(spark, rows, **options).items()}
        assert found == expected and expected


@pytest.mark.parametrize(("matching", "a", "b", "overlap", "match", "kind"), [(4, 4, 4, 100.0, "Exact", "Exact"), (3, 3, 6, 100.0, "Exact", "Superset"), (3, 6, 3, 100.0, "Exact", "Subset"), (4, 5, 5, 80.0, "Exact", "HighOverlap"), (4, 5, 5, 80.0, "ParameterVariation", "ParameterVariation"), (4, 5, 5, 80.0, "FuzzyMatch", "FuzzyMatch"), (4, 5, 5, 80.0, "Mixed", "HighOverlap")])
def test_duplicate_types(spark, matching, a, b, overlap, match, kind):
    row = spark.createDataFrame([(matching, a, b, overlap, match)], "m int, a int, b int, o double, t string")
    assert row.select(D.duplicate_type(*map(F.col, "mabot"))).first()[0] == kind


def test_groups_and_blocking(spark):
    rows = [("p", ABC), ("p", [*ABC[:4], "zulu"]), ("p", ABC[::-1]), ("q", ["one", "two", "three"])]
    s = AnalysisSettings()
    p = D.pairs(frame(spark, rows), s)
    g = D.ranked(D.groups(p)).collect()
    assert [(r["ord"], r["matches"], r["best_overlap"], r["duplicate_type"]) for r in g] == [(0, 2, 100.0, "Exact")]
    assert g[0]["common_background"] == [] and g[0]["step_reuse"] == 9
    blocked = {(r["a_ord"], r["b_ord"]) for r in D.blocked_pairs(frame(spark, rows), s).collect()}
    assert blocked == {(0, 1), (0, 2), (1, 2)}
    few = AnalysisSettings(max_comparisons_per_project=1)
    assert D.limited(frame(spark, rows), few).where("project = 'p'").count() == 1


def test_production_queries_find_varied_scenarios(spark, tmp_path):
    from stepweave.plans.queries import QUERIES

    base = ["the user opens page 1", "the user types 5 words", "the user saves 7 files", "the page shows 3 rows"]
    edited = ["the user opens pages 1", "the user typed 5 words", "the user saves 7 filed", "the page shown 3 rows"]
    rows = [(1, base), (2, [x.replace("1", "2").replace("5", "6").replace("7", "8").replace("3", "4") for x in base]), (3, ["alpha", "bravo", "charlie", "delta"]), (4, edited)]
    spark.createDataFrame([(i, "\n".join(x), "en", "web") for i, x in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    settings, expected = AnalysisSettings(), {}
    for i, x in rows:
        for j, y in rows:
            if i < j:
                m = compare(*({"step_fps": z, "step_texts": z, "norm_texts": [normalize(t) for t in z]} for z in (x, y)), settings)
                if max(m.overlap, m.fuzzy) >= settings.scenario_overlap_threshold:
                    expected[i, j] = (m.overlap, m.fuzzy, m.match_type)
    assert expected.keys() >= {(1, 2)}
    found = {(r["a"], r["b"]): (r["overlap"], r["fuzzy"], r["match_type"]) for r in QUERIES["scenario_overlap_production"](spark, str(tmp_path)).collect()}
    assert found == expected
    assert {(r["a"], r["b"]) for r in QUERIES["scenario_duplicate_type_production"](spark, str(tmp_path)).collect()} == expected.keys()
    assert {r["doc_id"] for r in QUERIES["scenario_groups_ranked_production"](spark, str(tmp_path)).collect()} == {a for a, _ in expected}


def by_hand(rows, s):
    """(a, b) of accepted pairs by equal steps of rows (project, feature, place, steps), all compared."""
    found, seen = {}, set()
    for i, (p, f, at, x) in enumerate(rows):
        for j, (q, g, to, y) in enumerate(rows):
            shared, n = set(x) & set(y), min(len(x), len(y))
            if i >= j or p is None or p != q or at == to or n < 3 or f != g and not s.enable_cross_feature_comparison or abs(len(x) - len(y)) > max(len(x), len(y)) * (1.0 - s.scenario_overlap_threshold / 100.0):
                continue
            if round(len(shared) / n * 100, 1) >= s.scenario_overlap_threshold and max(sum(t not in shared for t in z) for z in (x, y)) <= s.max_unique_steps_for_duplicate:
                found[i, j] = p, tuple(sorted((tuple(sorted(x)), tuple(sorted(y))))), [t for t in x if t in shared] == [t for t in y if t in shared]
    start = {p: min(i for (i, _), v in found.items() if v[0] == p) for p in {v[0] for v in found.values()}}
    out = {}
    for (i, j), (p, key, order) in sorted(found.items(), key=lambda v: (start[v[1][0]], v[0])):
        if key not in seen:
            seen.add(key)
            out[i, j] = order
    return out


def test_copies_are_compared_once(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(7)]
    some = [[r.choice(words) for _ in range(r.randrange(2, 7))] for _ in range(25)]
    rows = []
    for _ in range(160):
        steps = r.choice(some)
        rows.append((r.choice(["p", "q", None]), r.choice("fg"), r.randrange(60), r.sample(steps, len(steps)) if r.random() < 0.5 else steps))
    for options in ({}, {"enable_cross_feature_comparison": False}, {"scenario_overlap_threshold": 60}):
        s = AnalysisSettings(enable_fuzzy_matching=False, enable_parameter_agnostic_matching=False, **options)
        given = frame(spark, [(p, x) for p, _, _, x in rows]).join(spark.createDataFrame([(i, f, f"/{at}") for i, (_, f, at, _) in enumerate(rows)], "ord long, g string, at string"), "ord")
        found = D.exact_pairs(given.withColumn("feature", F.col("g")).withColumn("path", F.col("at")), s).collect()
        assert {(x["a_ord"], x["b_ord"]): x["same_sequence"] for x in found} == by_hand(rows, s)
    # so many copies have a pair each with each other
    given = frame(spark, [("p", ABC)] * 300 + [("p", ABC[::-1])] * 300)
    found = D.kinds(D.located(given, s))
    assert found.count() == 2 and D.exact_candidates(found, s).count() == 1


def test_large_buckets_are_split_and_pairs_found_once(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 4)
    r = random.Random(3)
    rows = [(p, [r.choice(ABC[:3]) for _ in range(r.randrange(3, 9))]) for p in "ppq" for _ in range(25)]
    s = AnalysisSettings()
    given = frame(spark, rows)
    signature = {x["ord"]: x["s"] for x in given.select("ord", T.step_signature(F.col("step_fps")).alias("s")).collect()}
    import math

    def buckets(i, p, x):
        reach = range(math.ceil(len(x) * (80.0 / 100.0)), min(math.floor(len(x) / (80.0 / 100.0)), len(x) + 10) + 1)
        return {(p, len(x))} | {(p, t, signature[i]) for t in reach}

    own = [buckets(i, *x) for i, x in enumerate(rows)]
    expected = sorted((rows[i][0], i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if own[i] & own[j])
    found = D.blocked_pairs(given, s)
    assert sorted(tuple(x) for x in found.collect()) == expected
    # ords of two scenarios: still a row for each pair
    assert D.blocked_pairs(given.union(frame(spark, [(p, x + ABC[:1]) for p, x in rows])), s).groupBy("project", "a_ord", "b_ord").count().where("count > 1").count() == 0
    most = D.met_in_buckets(spark.range(100).select(F.lit("p").alias("k"), F.col("id").alias("a_ord")), spark.range(100).select(F.lit("p").alias("k"), F.col("id").alias("b_ord")), ["k"])
    assert most.count() == 4950


def test_fuzzy_pairs_of_copies_and_parts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 16)
    r = random.Random(12)
    words = "user opens page types word saves file number".split()
    line = lambda: " ".join(r.choice(words) for _ in range(4))
    bases = [[line() for _ in range(4)] for _ in range(12)]
    vary = lambda t: t[:-1] + r.choice("xyz") if r.random() < 0.4 else t
    rows = [("p", r.sample(b, 4) if r.random() < 0.3 else [vary(t) for t in b]) for b in r.choices(bases, k=70)]
    rows += r.choices(rows, k=30)
    one = lambda t: {"step_fps": t, "step_texts": t, "norm_texts": [normalize(x) for x in t]}
    for options in ({}, {"max_comparisons_per_project": 20}):
        s, expected, seen = AnalysisSettings(**options), {}, set()
        for i, (_, x) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                y = rows[j][1]
                key = tuple(sorted((tuple(sorted(x)), tuple(sorted(y)))))
                if key not in seen and max((m := compare(one(x), one(y), s)).overlap, m.fuzzy) >= 80 and max(len(m.unique_a), len(m.unique_b)) <= 5:
                    seen.add(key)
                    expected[i, j] = m.overlap, m.fuzzy, m.match_type, m.additional
        assert {k: (v["overlap"], v["fuzzy"], v["match_type"], v["additional"]) for k, v in pairs(spark, rows, **options).items()} == expected


def test_greedy_matching_is_the_same_from_either_side():
    r = random.Random(5)
    s = AnalysisSettings(fuzzy_match_threshold=80.0)
    one = lambda t: {"step_fps": t, "step_texts": t, "norm_texts": t}
    for _ in range(400):
        x, y = ([f"abc{r.choice('xyz')}{r.choice('xyz')}" for _ in range(4)] for _ in "xy")
        m, w = compare(one(x), one(y), s), compare(one(y), one(x), s)
        assert (m.overlap, m.fuzzy, m.additional, m.match_type, m.unique_a, m.unique_b) == (w.overlap, w.fuzzy, w.additional, w.match_type, w.unique_b, w.unique_a)


def test_bounds_pass_no_similar_scenarios():
    import itertools

    import numpy as np
    import pyarrow as pa
    from brute import text_similarity
    from stepweave.operators import filters

    r = random.Random(2)
    line = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(0, 30))).strip()
    edit = lambda t: "".join(r.choice("xyz") if r.random() < 0.08 else c for c in t)
    some = [[line() for _ in range(5)] for _ in range(12)]
    some += [[edit(t) for t in r.sample(s, 5)] for s in some]
    batch = pa.RecordBatch.from_pydict({"home": ["h"] * 24, "kind": [str(i) for i in range(24)], "n": pa.array([5] * 24, pa.int32()), "side": pa.array([2] * 24, pa.int32()), "texts": some})
    plain = [[normalize(t) for t in s] for s in some]
    table = pa.Table.from_batches(filters.features([batch.set_column(4, "texts", pa.array(plain))]))
    found = {frozenset(x.values()) for x in filters.candidates(80, 85.0)(table).select(["x", "y"]).to_pylist()}
    matched = lambda a, b: np.array([[t == u or text_similarity(t, u) >= 85 for u in b] for t in a])
    whole = {frozenset((str(i), str(j))) for i in range(24) for j in range(i) if max(sum(m[k, q[k]] for k in range(5)) for m in [matched(plain[i], plain[j])] for q in itertools.permutations(range(5))) >= 4}
    assert whole and whole <= found and len(found) < 100
