from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stepweave.functions.text import similarity
from stepweave.operators import matching as M
from brute import edit_distance, text_similarity

PATTERNS = [
    "count {int} sheep", "the barn is shut", "there is a(n) owl", "they hear/heard an owl", "^farmer feeds and leaves|locks barn$", "^farmer (.*) milks cow$", "weigh {int}kgs total", "pre{word}", "the sky is Blue",
    "I have (very big )apples", "^(?:the quick fox )?jumps$", "{word}", "(.*)thing(.*)", r"^\S+ owl$",
]
STEPS = [
    "count 5 sheep", "count many sheep", "the barn is shut", "there is a owl", "there is an owl", "they heard an owl", "farmer feeds and leaves for lunch", "farmer slowly milks cow", "weigh 7kgs total", "prefix",
    "the sky is Blue", "the sky is blue", "I have apples", "I have very big apples", "jumps", "the quick fox jumps", "the hen sits", "nothing at all", "anfarmer milks cow", "bell owl", "  count 5  sheep ",
]


def bindings(spark, patterns, kinds=None):
    rows = [(i, "p", "f.cs", "C", f"M{i}", kinds[i] if kinds else "StepDefinition", p, 10 * i, 0, False) for i, p in enumerate(patterns)]
    rows += [(900, "p", "f.cs", "C", "TheHenSits", "StepDefinition", "", 1, 0, False), (901, "p", "f.cs", "C", "TheHenSits", "StepDefinition", "", 1, 2, False)]
    return spark.createDataFrame(rows, M.BINDING)


def steps(spark, rows):
    return spark.createDataFrame([(t, k, "a.feature", i) for i, (t, k) in enumerate(rows)], "text string, keyword string, path string, ord int")


def test_index_equals_brute_force(spark):
    b = bindings(spark, PATTERNS)
    compiled = M.compile_bindings(b)
    keys = M.step_keys(steps(spark, [(s, None) for s in STEPS]))
    found = {(r["key"], r["binding_id"]) for r in M.matches(keys, b, compiled).collect()}
    brute = keys.crossJoin(compiled.where("regex is not null")).where("text rlike regex or (is_literal and key = trim(text) and text rlike regex)")
    expected = {(r["key"], r["binding_id"]) for r in brute.collect()}
    assert expected <= found and all(b == 1 for _, b in found - expected)


def test_index_joins_by_equality(spark, capsys):
    b = bindings(spark, ["count {int} sheep"])
    M.indexed_matches(M.step_keys(steps(spark, [("x", None)])), b, M.compile_bindings(b)).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_gate_both_paths(spark):
    b = bindings(spark, ["the sun shines", "the {word} shines", "the sun shines"], ["Given", "When", "And"])
    s = steps(spark, [("the sun shines", "When"), ("the sun shines", None), ("the sun  shines", "Given")])
    counted = {r["binding_id"]: r["usage_count"] for r in M.usage_counts(s, b, M.compile_bindings(b)).collect()}
    assert counted == {0: 2, 1: 2, 2: 3, 900: 0, 901: 0}


def test_buckets_reconcile(spark):
    b = bindings(spark, ["the sun shines", "a {Colour} moon"])
    c = M.usage_counts(steps(spark, [("the sun shines", "Given")]), b, M.compile_bindings(b))
    s = M.coverage_summary(c).first()
    assert (s["total"], s["used"], s["unused"], s["indeterminate"]) == (4, 1, 2, 1) and s["coverage"] == 25.0
    assert M.coverage_summary(c.limit(0)).first()["coverage"] == 100.0


def test_known_issues(spark, tmp_path):
    from stepweave.sources.files import known_issues

    p = tmp_path / "known.csv"
    p.write_text('# note\n\nSourceFile,MethodName,Comment\nSteps\\A.cs,M1,"first, ""quoted"", kept"\n,M2,any file, with commas\nB.cs,M1,later\n,,none\n')
    issues = known_issues(spark, str(p))
    rows = [(i, path, m) for i, (path, m) in enumerate([("/x/steps/a.cs", "M1"), ("/x/c.cs", "M1"), ("/x/c.cs", "M2"), ("/x/c.cs", "m2")])]
    found = M.accepted(spark.createDataFrame(rows, "binding_id long, path string, method string"), issues).orderBy("binding_id").collect()
    assert [r["comment"] for r in found] == ['first, "quoted", kept', None, "any file, with commas", None]


def test_aliases_and_duplicates(spark):
    rows = [(1, "p", "a", "C", "M", "When", "the key turns", 10, 0, False), (2, "p", "a", "C", "M", "Given", "The Key turns", 12, 0, False), (3, "q", "b", "C", "N", "Then", "^the key turns$", 5, 0, False), (4, "p", "a", "C", "M", "Then", "x", 13, 0, False), (5, "p", "c", "C", "O", "Given", "y", 1, 0, False), (6, "p", "c", "C", "O", "When", "y", 20, 0, False)]
    b = spark.createDataFrame(rows, M.BINDING)
    found = {r["pattern"]: (r["definitions"], r["projects"], r["cross_project"]) for r in M.duplicate_definitions(b).collect()}
    assert found == {"The Key turns": (2, ["p", "q"], True), "y": (2, ["p"], False)}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc É", max_size=8), st.text("abc É", max_size=8))
def test_similarity_is_symmetric(a, b):
    assert text_similarity(a, b) == text_similarity(b, a) and edit_distance(a, b) == edit_distance(b, a) <= max(len(a), len(b))


def test_similarity_column_agrees(spark):
    from pyspark.sql import functions as F

    pairs = [("Given the cat sat", "When a cat sat"), ("buy 5 pens", "buy 15 pens"), ("", ""), ("", "x"), ("the", "a"), ('say "hi"', "say 'no'"), ("größe ä", "grosse a"), ("abcd", "abxd")]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r["a"], r["b"], r["s"]) for r in found] == [(a, b, text_similarity(a, b)) for a, b in pairs]


def test_literal_bindings_of_lines_with_two_keywords(spark, tmp_path):
    import duckdb

    from stepweave.plans.queries import QUERIES, SQL

    text = "And and then some\nand then some\nthen some\nAnd and then some\n* * x\n* x\n^^a$\n^a\nGiven ^^b$\nGiven ^^b$\n(c)\n(c)\n"
    spark.createDataFrame([(1, text, "en", "s"), (2, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["literal_binding_match"](spark, str(tmp_path)).select("pattern", "usage_count").collect()
    expected = c.execute(SQL["literal_binding_match"]).fetchall()
    assert sorted(map(tuple, found)) == sorted(expected) and ("and then some", 4) in expected


def test_bit_vector_distances_equal_the_table():
    import random
    import time

    from stepweave.functions import edits

    r = random.Random(1)
    some = lambda: "".join(r.choice("abcdé€𝒳 ") for _ in range(r.choice([0, 1, 2, 63, 64, 65, 127, 128, 129, r.randrange(300)])))
    a, b = [some() for _ in range(150)], [some() for _ in range(150)]
    b[:30] = [x[:-3] + "qq" for x in a[:30]]
    assert edits.distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b)] and len(edits.distances([], [])) == 0
    # 400 million cells: work that a table cell by cell doesn't do in this time here
    began = time.perf_counter()
    edits.distances(["".join(r.choices("abcdefgh ", k=20_000))], ["".join(r.choices("abcdefgh ", k=20_000))])
    assert time.perf_counter() - began < 20


def test_plain_bindings_take_no_shuffle_of_steps(spark, capsys):
    b = bindings(spark, ["the sun shines", "a moon"]).where("pattern <> ''")
    rows = [("the sun shines", "Given"), ("the sun  shines", None), ("Given the sun shines", "Then"), ("x", None)]
    counted = M.usage_counts(steps(spark, rows), b, M.compile_bindings(b))
    assert {r["binding_id"]: r["usage_count"] for r in counted.collect()} == {0: 3, 1: 0}
    # before, lines were read for each way of matching, and their texts sent to be counted
    counted.explain()
    plan = capsys.readouterr().out
    assert "min_by" not in plan
