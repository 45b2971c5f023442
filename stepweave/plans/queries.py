"""The operators over the driver's tables, each with DuckDB SQL of the same rows where SQL can express it.

A document is a feature file and a scenario, its language the project, its lines the steps; a conversation is a block of
steps, its roles the keywords; pages are markup; labels are accepted issues. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import edits
from stepweave.functions import expressions as E
from stepweave.functions import text as T
from stepweave.operators import bindings as B
from stepweave.operators import gherkin as G
from stepweave.operators import matching as M
from stepweave.operators import scenarios as D
from stepweave.operators import steps as P
from stepweave.operators import unused as U
from stepweave.plans.analysis import Features
from stepweave.session import ready
from stepweave.settings import AnalysisSettings
from stepweave.sources.files import markup_names, wildcard

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EXACT = AnalysisSettings(enable_fuzzy_matching=False, enable_parameter_agnostic_matching=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/{name}.parquet")


def split_lines(df: DataFrame, *columns: str) -> DataFrame:
    """Non-blank trimmed lines of text, numbered from 1."""
    every = df.select(*columns, F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    return every.select(*columns, (F.col("i") + 1).cast("long").alias("line_no"), T.strip(F.col("raw")).alias("text")).where("text <> ''")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(read(spark, d, "documents"), "doc_id", "lang", "source")


LINES = r"""
raw AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
lines AS (SELECT doc_id, lang, source, line_no::BIGINT AS line_no, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM raw WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> '')
"""


def kw(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?i)^(Given|When|Then|And|But)\s+', ''), '^\s+|\s+$', '', 'g')"


def params(x: str) -> str:
    for pattern, token in (("<[^>]+>", "{PARAM}"), ('"[^"]*"', "{STRING}"), ("''[^'']*''", "{STRING}"), (r"\b\d+\.?\d*\b", "{NUM}")):
        x = f"regexp_replace({x}, '{pattern}', '{token}', 'g')"
    return x


def fuzzy(x: str) -> str:
    x = params(kw(x))
    for _ in range(2):  # two articles in a row share the space between them
        x = rf"regexp_replace({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return rf"lower(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


def sha(x: str, n: int) -> str:
    return f"substr(to_base64(unhex(sha256({x}))), 1, {n})"


def key(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '(?i)^(?:Given |When |Then |And |But |\* )', ''), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({bare}, '^\^+', ''), '\$+$', ''), '\s+', ' ', 'g')"


# steps and fingerprints


@query(f"WITH {LINES} SELECT doc_id, line_no, {kw('text')} AS step FROM lines")
def step_normalize_keyword(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.normalize_keyword(F.col("text")).alias("step"))


@query(f"WITH {LINES} SELECT doc_id, line_no, {params('text')} AS step FROM lines")
def step_normalize_params(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.normalize_parameters(F.col("text")).alias("step"))


@query(f"WITH {LINES} SELECT doc_id, line_no, {fuzzy('text')} AS step FROM lines")
def step_normalize_fuzzy(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.normalize_fuzzy(F.col("text")).alias("step"))


@query(f"WITH {LINES} SELECT doc_id, line_no, {sha(kw('text'), 20)} AS fingerprint FROM lines")
def step_fingerprint(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.step_fingerprint(F.col("text")).alias("fingerprint"))


_LETTERS = "translate({}, 'ßäçèéêíñóöüàáâëîïôùúûœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


@query(f"""WITH {LINES}, n AS (SELECT doc_id, line_no, text, {_LETTERS.format(fuzzy('text'))} AS x FROM lines), p AS (SELECT *, lead(x) OVER w AS y, lead(text) OVER w AS other FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, CASE WHEN x = y THEN 100.0::DOUBLE ELSE round_even((1.0::DOUBLE - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE) * 100, 1) END AS similarity FROM p WHERE other IS NOT NULL""")
def step_similarity(spark, d):
    """Each line with the next of its document. The SQL writes letters beyond ASCII as capitals, which normalised lines don't
    have: its edit distance counts bytes."""
    from pyspark.sql import Window

    after = F.lead("plain").over(Window.partitionBy("doc_id").orderBy("line_no"))
    plain = lines(spark, d).select("doc_id", "line_no", T.normalize_fuzzy(F.col("text")).alias("plain"))
    pairs = plain.withColumn("other", after).where("other is not null").withColumn("edits", edits.distance("plain", "other"))
    return pairs.select("doc_id", "line_no", edits.similarity_from(F.col("edits"), F.col("plain"), F.col("other")).alias("similarity"))


def scenarios(spark: SparkSession, d: str, texts: bool = False) -> DataFrame:
    """Lines become steps within their row, so only what is asked for is sent to the rows of the same document."""
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("i"), T.strip(t).alias("t"))), lambda x: x["t"] != "")
    steps = F.transform(trimmed, lambda x: F.struct(x["i"].alias("i"), T.normalize_keyword(x["t"]).alias("step")))
    printed = F.transform(steps, lambda x: F.struct(x["i"], T.digest(x["step"], 20).alias("fp"), *([x["step"]] if texts else [])))
    rows = read(spark, d, "documents").select("doc_id", "lang", "source", printed.alias("r")).where("size(r) > 0")
    rows = rows.groupBy("doc_id", "lang", "source").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    own = [F.col("r.step").alias("step_texts")] if texts else []
    s = rows.select(F.col("lang").alias("project"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line_no"), F.col("source").alias("feature"), F.col("r.fp").alias("step_fps"), *own)
    return s.withColumn("fingerprint", T.scenario_fingerprint(F.col("step_fps")))


SCENARIOS = f"""{LINES},
scenarios AS (
  SELECT lang AS project, doc_id AS ord, list({sha(kw('text'), 20)} ORDER BY line_no) AS fps FROM lines GROUP BY doc_id, lang, source
), printed AS (SELECT *, {sha("array_to_string(list_sort(fps), '||')", 20)} AS fp FROM scenarios)
"""


@query(f"WITH {SCENARIOS} SELECT ord AS doc_id, fp AS fingerprint FROM printed")
def scenario_fingerprint(spark, d):
    return scenarios(spark, d).select(F.col("ord").alias("doc_id"), "fingerprint")


SIGNATURE = sha("array_to_string(list_sort(fps[1:3]), '|')", 8)


@query(f"WITH {SCENARIOS} SELECT ord AS doc_id, {SIGNATURE} AS signature FROM printed")
def step_signature(spark, d):
    return scenarios(spark, d).select(F.col("ord").alias("doc_id"), T.step_signature(F.col("step_fps")).alias("signature"))


def step_rows(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    return x.select(F.col("lang").alias("project"), F.struct("doc_id", "line_no").alias("ord"), T.normalize_keyword(F.col("text")).alias("text"), F.col("text").alias("original_text"), T.step_fingerprint(F.col("text")).alias("fingerprint"))


DUPLICATES = f"""WITH {LINES}, found AS (
  SELECT {sha(kw('text'), 20)} AS fingerprint, any_value({kw('text')}) AS text, count(*) AS occurrences, count(DISTINCT lang) AS projects
  FROM lines WHERE NOT regexp_matches(text, '(?i)^(?:Given) ') GROUP BY 1 HAVING count(*) > 1
) SELECT *, CASE WHEN projects > 1 THEN 'CrossProject' ELSE 'WithinProject' END AS category FROM found"""


@query(DUPLICATES)
def exact_duplicate_steps(spark, d):
    return P.exact_duplicates(P.for_duplicates(step_rows(spark, d), ["Given"]))


@query(f"SELECT * FROM ({DUPLICATES}) WHERE projects > 1")
def cross_project_steps(spark, d):
    return exact_duplicate_steps(spark, d).where("category = 'CrossProject'")


@query(f"SELECT * FROM ({DUPLICATES}) WHERE projects = 1")
def within_project_steps(spark, d):
    return exact_duplicate_steps(spark, d).where("category = 'WithinProject'")


@query(f"""WITH {LINES}, each AS (SELECT {sha(kw('text'), 20)} AS fingerprint, count(*) AS n FROM lines GROUP BY 1)
SELECT fingerprint, n AS occurrences FROM each WHERE n > 1 AND fingerprint NOT IN (SELECT {sha(kw("regexp_replace(text, '^\\s+|\\s+$', '', 'g')"), 20)} FROM benchmark)""")
def unreviewed_duplicates(spark, d):
    """Duplicates whose fingerprint isn't that of a reviewed text: the benchmark's, here."""
    reviewed = read(spark, d, "benchmark").select(T.step_fingerprint(T.strip(F.col("text"))).alias("fingerprint"))
    return P.exact_duplicates(step_rows(spark, d), reviewed).select("fingerprint", "occurrences")


@query(f"""WITH {LINES}, each AS (SELECT {fuzzy('text')} AS text, {sha(kw('text'), 20)} AS fingerprint, count(*) AS occurrences FROM lines GROUP BY 1, 2),
several AS (SELECT text, sum(occurrences)::BIGINT AS total FROM each GROUP BY 1 HAVING count(*) > 1)
SELECT text, fingerprint, occurrences, total FROM each JOIN several USING (text)""")
def same_step_variations(spark, d):
    steps = lines(spark, d).select(T.normalize_fuzzy(F.col("text")).alias("text"), T.step_fingerprint(F.col("text")).alias("fingerprint"))
    return P.variations(steps)


# scenarios

PAIRS = f"""{SCENARIOS}, joined AS (
  SELECT a.project, a.ord AS a_ord, b.ord AS b_ord, a.fp AS a_fp, b.fp AS b_fp, a.fps AS x, b.fps AS y, len(list_intersect(a.fps, b.fps)) AS matching
  FROM printed a JOIN printed b ON a.project = b.project AND a.ord < b.ord AND len(a.fps) >= 3 AND len(b.fps) >= 3
  AND abs(len(a.fps) - len(b.fps)) <= greatest(len(a.fps), len(b.fps)) * (1.0::DOUBLE - 80.0::DOUBLE / 100.0::DOUBLE)
), scored AS (
  SELECT *, round_even(matching::DOUBLE / least(len(x), len(y)) * 100, 1) AS overlap,
    list_filter(x, lambda e: NOT list_contains(y, e)) AS only_x, list_filter(y, lambda e: NOT list_contains(x, e)) AS only_y,
    matching > 0 AND list_filter(x, lambda e: list_contains(y, e)) = list_filter(y, lambda e: list_contains(x, e)) AS same_sequence
  FROM joined WHERE matching > 0
), ok AS (SELECT * FROM scored WHERE overlap >= 80 AND len(only_x) <= 5 AND len(only_y) <= 5),
started AS (SELECT *, min(a_ord) OVER (PARTITION BY project) AS s FROM ok),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a_fp, b_fp), greatest(a_fp, b_fp) ORDER BY s, a_ord, b_ord) AS n FROM started) WHERE n = 1)
"""


@query(f"WITH {PAIRS} SELECT project, a_ord AS a, b_ord AS b, matching::INTEGER AS matching, overlap, len(only_x)::INTEGER AS unique_a, len(only_y)::INTEGER AS unique_b, same_sequence FROM pairs")
def scenario_overlap(spark, d):
    p = D.exact_pairs(scenarios(spark, d), EXACT)
    return p.select("project", F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "matching", "overlap", F.size("unique_a").alias("unique_a"), F.size("unique_b").alias("unique_b"), "same_sequence")


TYPE = """CASE WHEN matching = len(x) AND len(y) > len(x) THEN 'Superset' WHEN matching = len(y) AND len(x) > len(y) THEN 'Subset'
WHEN abs(overlap - 100) < 0.1 AND len(x) = len(y) THEN 'Exact' ELSE 'HighOverlap' END"""


@query(f"WITH {PAIRS} SELECT a_ord AS a, b_ord AS b, {TYPE} AS duplicate_type FROM pairs")
def scenario_duplicate_type(spark, d):
    p = D.exact_pairs(scenarios(spark, d), EXACT)
    kind = D.duplicate_type(F.col("matching"), F.size("a_step_fps"), F.size("b_step_fps"), F.col("overlap"), F.lit("Exact"))
    return p.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), kind.alias("duplicate_type"))


@query(f"""WITH {PAIRS}, typed AS (SELECT *, {TYPE} AS kind FROM pairs)
SELECT project, a_ord AS doc_id, count(*)::INTEGER AS matches, max(overlap) AS best_overlap, sum(matching)::INTEGER AS step_reuse, arg_min(kind, (-overlap, b_ord)) AS duplicate_type FROM typed GROUP BY project, a_ord""")
def scenario_groups_ranked(spark, d):
    g = D.ranked(D.groups(D.pairs(scenarios(spark, d), EXACT)))
    return g.select("project", F.col("ord").alias("doc_id"), "matches", "best_overlap", "step_reuse", "duplicate_type")


# The same with the settings that reports use: steps that differ in parameters or small edits match too. No SQL. The bounds
# are looked at for all pairs of a language's documents of one number of steps.


def production_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = scenarios(spark, d, texts=True).withColumn("norm_texts", F.transform("step_texts", T.normalize_fuzzy))
    return D.pairs(s, AnalysisSettings())


@query()
def scenario_overlap_production(spark, d):
    p = production_pairs(spark, d)
    return p.select("project", F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "matching", "additional", "overlap", "fuzzy", "match_type", F.size("unique_a").alias("unique_a"), F.size("unique_b").alias("unique_b"), "same_sequence")


@query()
def scenario_duplicate_type_production(spark, d):
    p = production_pairs(spark, d)
    kind = D.duplicate_type(F.col("matching"), F.size("a_step_fps"), F.size("b_step_fps"), F.col("overlap"), F.col("match_type"))
    return p.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), kind.alias("duplicate_type"))


@query()
def scenario_groups_ranked_production(spark, d):
    g = D.ranked(D.groups(production_pairs(spark, d)))
    return g.select("project", F.col("ord").alias("doc_id"), "matches", "best_overlap", "best_fuzzy", "step_reuse", "duplicate_type")


@query(f"""WITH {SCENARIOS}, keyed AS (
  SELECT project, ord, unnest(list_append(list_transform(range(ceil(len(fps) * (80::DOUBLE / 100::DOUBLE))::BIGINT, least(floor(len(fps) / (80::DOUBLE / 100::DOUBLE)), len(fps) + 10)::BIGINT + 1), lambda t: t || '_' || {SIGNATURE}), 'general_' || len(fps))) AS bucket
  FROM printed WHERE len(fps) >= 3)
SELECT DISTINCT a.project, a.ord AS a, b.ord AS b FROM keyed a JOIN keyed b ON a.project = b.project AND a.bucket = b.bucket AND a.ord < b.ord""")
def scenario_blocking(spark, d):
    s = D.comparable(scenarios(spark, d), EXACT)
    return D.blocked_pairs(s, EXACT).select("project", F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


# sequences


def as_files(df: DataFrame, project: str, path: str, lines: Column, head: str = "Feature: f") -> DataFrame:
    """Feature files of these lines (an array)."""
    return df.select(F.col(project).cast("string").alias("project"), F.col(path).cast("string").alias("path"), F.concat(F.lit(f"{head}\n"), F.array_join(lines, "\n")).alias("content"))


def conversation_files(spark: SparkSession, d: str, line: Callable[[Column], Column], head: str) -> DataFrame:
    """A feature file for each conversation: for each turn (struct turn, role), in order, a line or lines."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return as_files(rows, "conv_id", "conv_id", F.transform("r", line), head)


def by_role(role: Column, system: str, user: str, other: str) -> Column:
    return F.when(role == "system", system).when(role == "user", user).otherwise(other)


@query("""SELECT conv_id, turn, last_value(CASE role WHEN 'system' THEN 'Given' WHEN 'user' THEN 'When' END IGNORE NULLS)
OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS keyword FROM conversations""")
def keyword_inheritance(spark, d):
    """Turns as steps of one scenario, parsed from feature text."""
    files = conversation_files(spark, d, lambda r: F.concat(by_role(r["role"], "Given", "When", "And"), F.lit(" turn "), r["turn"].cast("string")), "Feature: f\nScenario: s")
    steps = G.explode(G.parse_corpus(files, []), "steps")
    return steps.select(F.col("path").cast("long").alias("conv_id"), F.substring_index("text", " ", -1).cast("long").alias("turn"), "keyword")


HEADER = "position('!!' IN text) > 0"


def block_steps(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feature files: a line with !! heads a scenario named by its number, others are steps."""
    x = lines(spark, d).withColumn("as", F.concat(F.when(F.contains("text", F.lit("!!")), "Scenario: ").otherwise("Given "), F.col("line_no").cast("string")))
    rows = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "as"))).alias("r"))
    steps = G.explode(G.parse_corpus(as_files(rows, "doc_id", "doc_id", F.transform("r", lambda r: r["as"])), []), "steps")
    return steps.select(F.col("path").cast("long").alias("doc_id"), F.col("text").cast("long").alias("line_no"), F.col("scenario").cast("long").alias("block"))


@query(f"WITH {LINES} SELECT doc_id, line_no, block FROM (SELECT doc_id, line_no, text, max(CASE WHEN {HEADER} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines) WHERE block IS NOT NULL AND NOT {HEADER}")
def block_ids(spark, d):
    """The block of each step, by its heading's line."""
    return block_steps(spark, d)


@query(f"WITH {LINES} SELECT doc_id, count(*) AS inside FROM (SELECT doc_id, text, bool_or({HEADER}) OVER (PARTITION BY doc_id ORDER BY line_no) AS inside FROM lines) WHERE inside AND NOT {HEADER} GROUP BY 1")
def inside_block_flag(spark, d):
    """How many lines of a document are steps because a heading stands above them."""
    return block_steps(spark, d).groupBy("doc_id").agg(F.count("*").alias("inside"))


@query("""WITH b AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS background FROM conversations)
SELECT conv_id, turn, background FROM b WHERE role = 'user'""")
def background_of_block(spark, d):
    """User turns as scenarios, system turns as backgrounds: that which stands above a scenario."""
    line = lambda r: F.concat(by_role(r["role"], "Background:\nGiven b ", "Scenario: s\nWhen w ", "Then t "), r["turn"].cast("string"))
    s = G.explode(G.parse_features(conversation_files(spark, d, line, "Feature: f"), AnalysisSettings(include_background_steps=False)), "scenarios")
    number = lambda text: F.substring_index(text, " ", -1).cast("long")
    return s.select(F.col("path").cast("long").alias("conv_id"), number(F.col("step_texts")[0]).alias("turn"), number(F.get("background_steps", F.lit(0))).alias("background"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM lines")
def line_gaps(spark, d):
    return lines(spark, d).select("doc_id", "line_no", M.line_gap(["doc_id"]).alias("gap"))


# bindings: the lines of the benchmark's passages as patterns


def passage_bindings(spark: SparkSession, d: str) -> DataFrame:
    x = split_lines(read(spark, d, "benchmark"), "item_id")
    return x.select(
        (F.col("item_id") * 1000 + F.col("line_no")).alias("binding_id"), F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.lit("C").alias("class"),
        F.lit("m").alias("method"), F.lit("StepDefinition").alias("type"), F.col("text").alias("pattern"), F.col("line_no").cast("int"), F.lit(0).alias("parameter_count"), F.lit(False).alias("unresolvable"),
    )


def counted(spark: SparkSession, d: str) -> DataFrame:
    b = passage_bindings(spark, d)
    steps = lines(spark, d).select("text", F.lit(None).cast("string").alias("keyword"), F.col("doc_id").alias("path"), F.col("line_no").alias("ord"))
    return M.usage_counts(steps, b, M.compile_bindings(b))


COUNTED = rf"""{LINES}, passage AS (
  SELECT item_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM benchmark
), bindings AS (SELECT item_id * 1000 + line_no AS binding_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS pattern FROM passage WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''),
counted AS (SELECT binding_id, pattern, count(l.doc_id) AS usage_count FROM bindings b LEFT JOIN lines l ON {key('l.text')} = {key('b.pattern')} GROUP BY 1, 2)
"""


@query(f"WITH {COUNTED} SELECT binding_id, usage_count FROM counted")
def binding_usage(spark, d):
    return counted(spark, d).select("binding_id", "usage_count")


@query(f"WITH {COUNTED} SELECT count(*) AS total, count_if(usage_count > 0)::BIGINT AS used, count_if(usage_count = 0)::BIGINT AS unused, 0::BIGINT AS indeterminate, count_if(usage_count > 0)::DOUBLE / count(*) * 100 AS coverage FROM counted")
def coverage_summary(spark, d):
    return M.coverage_summary(counted(spark, d))


@query(f"WITH {COUNTED} SELECT binding_id, pattern FROM counted WHERE usage_count = 0")
def unused_bindings(spark, d):
    return M.unused(counted(spark, d)).select("binding_id", "pattern")


@query(f"WITH {COUNTED} SELECT binding_id, pattern FROM counted WHERE usage_count = 1")
def single_use(spark, d):
    return M.single_use(counted(spark, d)).select("binding_id", "pattern")


@query(f"WITH {COUNTED} SELECT binding_id, usage_count FROM counted ORDER BY usage_count DESC, binding_id LIMIT 20")
def most_used_top20(spark, d):
    return M.most_used(counted(spark, d)).select("binding_id", "usage_count")


@query(f"""WITH {LINES}, keyed AS (SELECT {key('text')} AS k, text FROM lines), b AS (SELECT DISTINCT k FROM keyed WHERE NOT regexp_matches(text, '[{{}}()/\\\\]')), steps AS (SELECT k, count(*) AS n FROM keyed GROUP BY 1)
SELECT k AS pattern, n AS usage_count FROM steps JOIN b USING (k) WHERE n > 1""")
def literal_binding_match(spark, d):
    """Lines that occur again, as plain-text bindings of all lines."""
    x = lines(spark, d)
    # a line of each key, not the key: a key that begins with a keyword has another key
    plain = x.where(~F.col("text").rlike(r"[{}()/\\]")).groupBy(T.step_key(F.col("text"))).agg(F.min("text").alias("pattern"))
    bindings = plain.select(F.xxhash64("key").alias("binding_id"), F.lit("StepDefinition").alias("type"), "pattern")
    steps = x.groupBy(T.step_key(F.col("text")), F.lit(None).cast("string").alias("keyword")).agg(F.count("*").alias("usage_count")).where("usage_count > 1")
    found = M.literal_matches(steps, bindings, bindings.select("binding_id", F.lit(True).alias("is_literal")))
    return found.select(F.col("key").alias("pattern")).join(steps.select(F.col("key").alias("pattern"), "usage_count"), "pattern")


@query(f"WITH {LINES} SELECT doc_id, line_no, item_id FROM lines JOIN benchmark b ON position(b.text IN lines.text) > 0")
def passage_containment(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return lines(spark, d).crossJoin(b).where(F.contains("text", F.col("passage"))).select("doc_id", "line_no", "item_id")


#: Patterns that Java and RE2 read alike: indexed by a required word, and without one.
PATTERNS = (r"^(.+) with the (.+)$", r"^(?:.+ )?idiot (.+)$", "^The (.+)\\.$", r"^(The|And) (.+)$", r"^(.+) und der (.+)$", r"^(\S+) que (.+)$", r"^(?:the quick fox )?(.+) that was (.+)$", r"^\S+$", "^(.*)dans(.*)$")


def inline_bindings(spark: SparkSession) -> DataFrame:
    rows = [(i, "p", "f", "C", "m", "StepDefinition", p, i, 0, False) for i, p in enumerate(PATTERNS)]
    return spark.createDataFrame(rows, M.BINDING)


_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))


@query(f"WITH {LINES}, k AS (SELECT {key('text')} AS key, arg_min(text, (doc_id, line_no)) AS text FROM lines GROUP BY 1) SELECT i::BIGINT AS binding_id, key FROM k JOIN (VALUES {_VALUES}) p(i, p) ON regexp_matches(text, p)")
def indexed_match_equals_bruteforce(spark, d):
    """By the index of required words; the SQL tests every pattern on every step."""
    b = inline_bindings(ready(spark))
    steps = lines(spark, d).select("text", F.lit(None).cast("string").alias("keyword"), F.col("doc_id").alias("path"), F.col("line_no").alias("ord"))
    return M.matches(M.step_keys(steps), b, M.compile_bindings(b)).select("binding_id", "key")


@query(f"WITH {LINES}, t AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS token FROM lines) SELECT token, count(*) AS steps FROM t GROUP BY 1")
def token_document_frequency(spark, d):
    return lines(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("steps"))


CUCUMBER = r"""CASE WHEN starts_with(text, '^') OR ends_with(text, '$') THEN false WHEN regexp_matches(text, '\{\w*\}') THEN true
WHEN regexp_matches(text, '\([^)]+[*+]\)|\.\*') THEN false WHEN regexp_matches(text, '\\\.|\\d\+') THEN false ELSE true END"""


def of_pattern(f: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """What a function of patterns says, a batch at a time. Bindings are few and compiled on the driver; here are many."""

    @F.pandas_udf(kind)
    def run(patterns: pd.Series) -> pd.Series:
        return patterns.map(f)

    return run


@query(f"WITH {LINES} SELECT doc_id, line_no, {CUCUMBER} AS cucumber FROM lines")
def grammar_router(spark, d):
    return lines(spark, d).select("doc_id", "line_no", of_pattern(E.is_cucumber, "boolean")(F.col("text")).alias("cucumber"))


@query(f"WITH {LINES} SELECT doc_id, line_no, (CASE WHEN starts_with(text, '^') THEN '' ELSE '^' END) || text || (CASE WHEN ends_with(text, '$') THEN '' ELSE '$' END) AS regex FROM lines")
def effective_regex(spark, d):
    return lines(spark, d).select("doc_id", "line_no", of_pattern(E.effective_regex, "string")(F.col("text")).alias("regex"))


KINDS = ("Given", "When", "Then", "StepDefinition", "And")


@query(f"""SELECT conv_id, turn, kind, kind NOT IN ('Given', 'When', 'Then') OR k IS NULL OR kind = k AS ok
FROM (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'Given' WHEN 'user' THEN 'When' END AS k FROM conversations), (VALUES {', '.join(f"('{k}')" for k in KINDS)}) t(kind)""")
def keyword_compatibility(spark, d):
    c = read(spark, d, "conversations")
    keyword = F.when(F.col("role") == "system", "Given").when(F.col("role") == "user", "When")
    kinds = c.select("conv_id", "turn", keyword.alias("k"), F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    return kinds.select("conv_id", "turn", "kind", M.compatible(F.col("kind"), F.col("k")).alias("ok"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN len(w) > 1 AND w[1] IN ('Given', 'When', 'Then', 'And', 'But') THEN w[2:] ELSE w END, ' ') AS step
FROM (SELECT p_partkey, regexp_extract_all(p_type || p_brand, '[A-Z][a-z0-9]*') AS w FROM part)""")
def convention_pattern(spark, d):
    return read(spark, d, "part").select("p_partkey", of_pattern(lambda m: E.convention_text(m, 0), "string")(F.concat("p_type", "p_brand")).alias("step"))


#: Cases of each matching rule: pattern, step, whether it binds.
CASES = (
    ("a basket is filled", "a basket is filled twice", False), ("a basket is filled", "a basket is filled", True), ("shopper pays the bill", "shopper pays the bill by card", False),
    ("^shopper opens and reads|closes a letter$", "shopper opens and reads a long letter", True), ("I own a(n) apple", "I own an apple", True), ("I own a(n) apple", "I own a apple", True),
    ("I see/saw a comet", "I saw a comet", True), ("I see/saw a comet", "I seek a comet", False), ("{Int32} boats leave", "7 boats leave", True), ("{int} boats leave", "7 boats leave", True),
    ("{int} boats leave", "some boats leave", False), ("^clerk stamps (.*) form$", "clerk stamps the blue form", True), ("^clerk stamps (.*) form$", "clerk burns the blue form", False),
    ("^the (SHOULD|should NOT) case stays$", "the SHOULD case stays", True),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, _, ok) in enumerate(CASES)) + ") t(id, bound)")
def matcher_cases(spark, d):
    """Whether the pattern of each case binds its step, through compilation, index and residual."""
    bindings = ready(spark).createDataFrame([(i, "p", "f", "C", "m", "StepDefinition", p, i, 0, False) for i, (p, _, _) in enumerate(CASES)], M.BINDING)
    steps = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "id int, text string").withColumn("key", T.step_key(F.col("text")))
    keys = M.step_keys(steps.select("text", F.lit(None).cast("string").alias("keyword"), F.lit("f").alias("path"), F.col("id").alias("ord")))
    found = M.matches(keys, bindings, M.compile_bindings(bindings)).select("key", F.col("binding_id").cast("int").alias("id"), F.lit(True).alias("hit"))
    return steps.join(found, ["key", "id"], "left").select("id", F.coalesce("hit", F.lit(False)).alias("bound"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS x FROM conversations GROUP BY 1), p AS (SELECT conv_id, x, lead(x) OVER (ORDER BY conv_id) AS y FROM c)
SELECT conv_id, len(list_filter(x, lambda e: list_contains(y, e))) > 0 AND list_filter(x, lambda e: list_contains(y, e)) = list_filter(y, lambda e: list_contains(x, e)) AS same FROM p WHERE y IS NOT NULL""")
def same_sequence(spark, d):
    """Whether a conversation's roles and those of the next come in one order."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", F.transform("r", lambda r: r["role"]).alias("x"))
    following = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("x").alias("y"))
    return c.join(following, "conv_id").select("conv_id", D.same_sequence(F.col("x"), F.col("y")).alias("same"))


def line_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Every line as a binding: its source the file, its first word the method, its language the project."""
    kind = F.element_at(F.array(*map(F.lit, M.PREFERENCE)), (F.col("line_no") % 6 + 1).cast("int"))
    return lines(spark, d).select(
        (F.col("doc_id") * 100000 + F.col("line_no")).alias("binding_id"), F.col("lang").alias("project"), F.col("source").alias("path"), F.split("text", " ")[0].alias("method"), kind.alias("type"), F.col("text").alias("pattern"), F.col("line_no")
    )


NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(?:Given |When |Then |And |But |\* )', ''), '^\s+|\s+$', '', 'g'), '^\^+', ''), '\$+$', '')"
ALIASES = f"""{LINES}, b AS (
  SELECT doc_id * 100000 + line_no AS binding_id, lang AS project, source AS path, string_split(text, ' ')[1] AS method, ['Given', 'When', 'Then', 'And', 'But', 'StepDefinition'][(line_no % 6 + 1)::INTEGER] AS type,
    line_no % 6 AS preference, text AS pattern, line_no, lower({NORMAL}) AS normal FROM lines
), gaps AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY normal, path, method ORDER BY line_no) AS gap FROM b),
wide AS (SELECT *, max(gap) OVER (PARTITION BY normal, path, method) AS widest, row_number() OVER (PARTITION BY normal, path, method ORDER BY preference, binding_id) AS k FROM gaps),
kept AS (SELECT * FROM wide WHERE widest IS NULL OR widest > 5 OR k = 1)
"""


@query(f"WITH {ALIASES} SELECT binding_id, type FROM kept")
def alias_collapse(spark, d):
    keyed = line_bindings(spark, d).withColumn("normal", F.lower(T.strip_match(F.col("pattern"))))
    return M.without_aliases(keyed, ["normal"]).select("binding_id", "type")


@query(f"""WITH {ALIASES} SELECT arg_min(pattern, binding_id) AS pattern, count(*) AS definitions, list_sort(list(DISTINCT project)) AS projects, count(DISTINCT project) > 1 AS cross_project
FROM kept GROUP BY normal HAVING count(*) > 1""")
def duplicate_definitions(spark, d):
    return M.duplicate_definitions(line_bindings(spark, d))


@query("SELECT d.doc_id AS binding_id, min(CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality END) AS comment FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def known_issue_split(spark, d):
    """Documents as unused bindings, labels as issues that accept them by name."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("binding_id"), F.col("source").alias("path"), F.col("doc_id").cast("string").alias("method"))
    issues = read(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.lit("").alias("source_file"), F.col("doc_id").cast("string").alias("method"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("comment"))
    return M.accepted(docs, issues).select("binding_id", "comment")


# markup and names

NAMES = r"""names AS (SELECT DISTINCT unnest(regexp_extract_all(place, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM (SELECT unnest(regexp_extract_all(html, '"[^"]*"|\{[^}]*\}')) AS place FROM pages))"""


@query(f"WITH {NAMES} SELECT name FROM names")
def markup_references(spark, d):
    return markup_names(read(spark, d, "pages").select(F.col("html").alias("content")))


@query(f"WITH {NAMES}, c AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '[A-Za-z]+')) AS name FROM part UNION SELECT n_name FROM nation) SELECT name FROM c WHERE name NOT IN (SELECT name FROM names)")
def unreferenced_names(spark, d):
    parts = read(spark, d, "part").select(F.explode(F.regexp_extract_all("p_name", F.lit("([A-Za-z]+)"), F.lit(1))).alias("name"))
    candidates = parts.union(read(spark, d, "nation").select(F.col("n_name"))).distinct()
    return U.without_names(candidates, markup_references(spark, d))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS value FROM pages)
SELECT value AS name, 'page:' || min(page_id) AS hint FROM l WHERE regexp_matches(value, '^[\\p{L}_][\\p{L}\\p{Nd}_]*$') GROUP BY 1""".replace("\\\\", "\\"))
def literal_hint(spark, d):
    found = read(spark, d, "pages").select(F.lit("page").alias("path"), F.col("page_id").alias("line_no"), F.explode(F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))).alias("value"))
    return U.literal_hints(found)


_DEFINED = ("P", "b", "li", "ul", "nav")


@query(f"""SELECT page_id, name FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([^>]+)>', 1)) AS name FROM pages)
WHERE regexp_matches(name, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND lower(name) NOT IN ({', '.join(f"'{x.lower()}'" for x in _DEFINED)})""")
def undefined_placeholders(spark, d):
    """A page's tags in the step of an outline whose Examples have some of them: the parser's data errors."""
    tags = F.regexp_replace(F.array_join(F.regexp_extract_all("html", F.lit("(<[^>]+>)"), F.lit(1)), " "), r"\s+", " ")
    lines_ = F.array(F.lit("Scenario Outline: o"), F.concat(F.lit("Given "), tags), F.lit("Examples:"), F.lit("| " + " | ".join(_DEFINED) + " |"), F.lit("| 1 " * len(_DEFINED) + "|"))
    pages = as_files(read(spark, d, "pages"), "page_id", "page_id", lines_)
    errors = G.explode(G.parse_features(pages, AnalysisSettings()), "errors").where("error_type = 'UndefinedPlaceholder'")
    return errors.select(F.col("path").cast("long").alias("page_id"), F.explode(F.array_distinct("undefined")).alias("name"))


# feature text

@query("SELECT r_name AS region, n_nationkey::VARCHAR AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def data_table_parse(spark, d):
    """Regions as steps with the table of their nations, parsed from feature text."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" |"), "n_name", F.lit("|")))).alias("rows"))
    files = as_files(rows, "r_name", "r_name", F.concat(F.array(F.lit("Given nations"), F.lit("| key | name |")), F.col("rows")), "Feature: f\nScenario: s")
    table = G.explode(G.parse_features(files, AnalysisSettings()), "steps").select("path", F.explode("table").alias("row"))
    return table.select(F.col("path").alias("region"), F.col("row")["key"].alias("key"), F.col("row")["name"].alias("name"))


@query("""SELECT s.conv_id AS block, 'step ' || s.turn || ' ' || r.role || ' ' || r.turn AS text FROM conversations s JOIN conversations r ON r.conv_id = s.conv_id AND r.turn > s.turn""")
def examples_expansion(spark, d):
    """Each turn as a step once for every later turn of its conversation, as an Examples row of role and turn."""
    turn = lambda r: r["turn"].cast("string")
    line = lambda r: F.concat(F.lit("Examples:\n| role | turn |\n| "), r["role"], F.lit(" | "), turn(r), F.lit(" |\nGiven step "), turn(r), F.lit(" <role> <turn>"))
    steps = G.explode(G.parse_corpus(conversation_files(spark, d, line, "Feature: f\nScenario Outline: s"), []), "steps")
    return steps.where("not contains(text, '<')").select(F.col("path").cast("long").alias("block"), "text")


@query("SELECT doc_id, list_filter(string_split('@' || lang || ' x @' || source, ' '), lambda t: starts_with(t, '@')) AS tags FROM documents WHERE lang <> 'fr' AND (source = 'src1' OR lang = 'en')")
def tag_filter(spark, d):
    """Scenarios that tags leave in, read by the parser; tags stand both where a scenario begins and where it ends."""
    tags = F.concat(F.lit("@"), "lang", F.lit(" x @"), "source")
    files = as_files(read(spark, d, "documents"), "lang", "doc_id", F.array(tags, F.lit("Scenario: s"), F.lit("Given a"), tags))
    s = G.explode(G.parse_features(files, AnalysisSettings(exclude_scenario_tags=["@FR"], include_only_tags=["@SRC1", "@en"])), "scenarios")
    return s.select(F.col("path").cast("long").alias("doc_id"), "tags")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^.*a.*e$')")
def wildcard_names(spark, d):
    return read(spark, d, "part").where(F.col("p_name").rlike(wildcard("*A*e"))).select("p_partkey", "p_name")


# counters and graphs


def document_files(spark: SparkSession, d: str) -> Features:
    """Documents as feature files of one scenario, their lines as steps."""
    steps = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("Given "), x))
    files = as_files(read(spark, d, "documents"), "lang", "doc_id", steps, "Feature: f\nScenario: s")
    return Features(G.parse_features(files, AnalysisSettings()))


@query(f"WITH {LINES} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(DISTINCT lang) FROM documents) AS projects, count(DISTINCT doc_id) AS scenarios, count(*) AS steps, 0::BIGINT AS excluded FROM lines")
def scan_counters(spark, d):
    return document_files(spark, d).counters()


@query(f"WITH {LINES} SELECT lang AS project, count(*) AS steps FROM lines GROUP BY 1")
def project_step_counts(spark, d):
    return document_files(spark, d).steps_by_project()


@query("""WITH RECURSIVE c AS (
  SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Elsewhere' WHEN c_custkey > 1 THEN (c_custkey // 2)::VARCHAR END AS base, c_mktsegment = 'BUILDING' AND c_nationkey = 3 AS yes FROM customer
), walk AS (SELECT id, id AS at FROM c UNION SELECT walk.id, c.base FROM walk JOIN c ON c.id = walk.at WHERE c.base IS NOT NULL)
SELECT walk.id AS name, CASE WHEN bool_or(coalesce(c.yes, false)) THEN 'Confirmed' WHEN bool_or(c.id IS NULL) THEN 'Unconfirmable' ELSE 'NotABinding' END AS status FROM walk LEFT JOIN c ON c.id = walk.at GROUP BY walk.id""")
def hierarchy_closure(spark, d):
    """Customers as classes, each derived from that of half its key, or of a class that isn't in the sources."""
    c = read(spark, d, "customer")
    base = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("Elsewhere")).when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2).cast("string"))
    return B.binding_status(c.select(F.col("c_custkey").cast("string").alias("name"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 3)).alias("has_binding"), F.array_compact(F.array(base)).alias("bases")))


@query()
def cascade_fixpoint(spark, d):
    """Suppliers of a nation as methods in a chain of calls, cut at those of low balance. Negation in a recursion has no SQL."""
    s = read(spark, d, "supplier")
    declared = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") > 2).alias("reportable"))
    chain = s.select(F.when(F.col("s_nationkey") != 3, F.floor(F.col("s_suppkey") / 2)).alias("from_id"), F.col("s_suppkey").alias("to_id"))
    return U.cascade(declared, chain, s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")))
