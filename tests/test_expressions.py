import re

import pytest

from stepweave.functions import expressions as E

CASES = [
    ("open the gate", "open the gate", True), ("open the gate", "open the gate wide", False), ("close gate", "close gate now please", False),
    ("^stock is counted|books are shut$", "stock is counted every month", True), ("see a(n) apple", "see an apple", True), ("see a(n) apple", "see a apple", True),
    ("they see/saw it", "they saw it", True), ("they see/saw it", "they sew it", False), ("{Int64} crates arrive", "12 crates arrive", True), ("{long} crates arrive", "-3 crates arrive", True),
    ("{int} crates arrive", "no crates arrive", False), ("^driver leaves (.*) depot$", "driver leaves the north depot", True), ("^driver leaves (.*) depot$", "driver enters the north depot", False),
    ("^doors (SHALL|shall NOT) open$", "doors SHALL open", True), ("weight is {double} kg", "weight is 1.50 kg", True), ("a {word} car", "a red car", True), ("a {word} car", "a dark red car", False),
    (r"cost \{int}", "cost {int}", True), (r"either\/or", "either/or", True), ("open (", "open (", True), ("total is 5$", "total is 5", True),
]


@pytest.mark.parametrize(("pattern", "step", "matches"), CASES)
def test_matching(spark, pattern, step, matches):
    c = E.compile_binding(spark, pattern)
    found = spark.createDataFrame([(step, c.regex)], "t string, r string").selectExpr("t rlike r").first()[0]
    assert found == matches


def test_router_order():
    cucumber = ["plain", "{int} x", "a {word} (.*)", "see a(n) apple", "it's 5 (five)"]
    regular = ["^x", "x$", "^{int}$", "a (.*) b", "any.*", "(x+)", r"a\.b", r"n \d+"]
    assert all(map(E.is_cucumber, cucumber)) and not any(map(E.is_cucumber, regular))


def test_indeterminate(spark):
    assert E.compile_binding(spark, "a {Colour} car").reason and E.compile_binding(spark, "^(unclosed$").reason and E.compile_binding(spark, "x", unresolvable=True).reason
    assert E.compile_binding(spark, "a {Colour} car", types=E.PARAMETER_TYPES | {"Colour": "(?i:red|blue)"}).regex == "^a\\ (?:(?i:red|blue))\\ car$"
    assert len(E.PARAMETER_TYPES) == 20


def test_convention(spark):
    assert E.convention_text("WhenTheTrainLeaves", 0) == "The Train Leaves" and E.convention_text("When", 0) == "When" and E.convention_text("GoHTTPNow", 0) == "Go H T T P Now"
    assert E.convention_text("GivenX", 1) is None and E.convention_text("", 0) is None
    c = E.compile_binding(spark, "", "TheTrainLeaves", 0)
    assert c.kind == "convention" and re.search(c.regex, "the train leaves.") and not re.search(c.regex, "the train leaves..")
    assert E.compile_binding(spark, "", "X", 2).kind == "never"


def test_required_words():
    assert E.required_words("I have (very big )apples") == ["have"] and E.required_words("^(?:the quick fox )?jumps high$") == ["high"]
    assert E.required_words("stop|start engines") == [] and E.required_words("weigh {int}kgs Total") == ["weigh", "total"] and E.required_words("a to {word}") == []
    assert E.required_words("", "TheTrainLeaves") == ["the", "train", "leaves"]
