from stepweave.operators import bindings as B
from stepweave.operators import unused as U
from stepweave.settings import UnusedCodeSettings
from stepweave.sources import csharp
from stepweave.sources.files import markup_names

STEPS = r'''
using System; using Alias = System.Text.StringBuilder;
namespace Farm.Steps;
[Binding] public partial class Base { }
public class Derived : Base {
    [Given(@"a ""quoted"" cow"), When("tab\t{int}")]
    [Scope(Tag = "x")] public async Task<List<int>> Feed(int n, string s = "a,b") { Helper<int>(n); await Local(); void Local() {} }
    [Then] public void ItMoos() => Log($"cow {Name(1)} {{}}");
    [Given($"made {Up}")] public void Made() { }
    [StepDefinition("""raw "text" here""")] public void Raw() { }
    private void Helper<T>(int n) { }
    private string Name(int k) => nameof(Derived) + k;
    private void Log(string s) { /* Dead(); */ // Dead();
    }
}
public class Foreign : Outside.Thing { [Given("from far")] public void Far() { } }
public class Plain { [Given("never")] public void Never() { } }
public enum Colour { Red, [Old] Dark = 4 }
public record Pair(int A, string B);
public class T { [StepArgumentTransformation(@"(\d+) days", Name = "days")] public TimeSpan D(int n) => default; [StepArgumentTransformation("now")] public DateTime Now() => default; }
'''
DEAD = r'''
namespace App {
  internal interface IUsed { void Go(int a); }
  internal interface IUnused { }
  internal class Worker : IUsed {
    public void Go(int a) { Step(a); }
    private void Step(int a) { }
    private void Step(int a, int b) { }
    private void ClickHandler() { }
    private void ByName() { }
    private void Gone() { }
    protected internal void TestThing() { }
    [Fact] private void Attributed() { }
    private void Register(IServiceCollection c) { }
    private static string Text => "ByName" + 'x' + @"C:\";
    private IUsed _w = new Worker();
  }
  internal static class Ext { internal static int Twice(this int x) => x * 2; }
  class Entry { static void Main() { 3.Twice(); } }
  internal class OddAttribute : Attribute { }
  internal class OldAttribute : Attribute { }
  [Odd] internal class Nobody { class Inner { } }
}
'''


def test_bindings(spark):
    sources = csharp.parse_sources(spark.createDataFrame([("/none/a.cs", STEPS)], "path string, content string"))
    found, unconfirmed, types = B.discover(sources)
    rows = {(r["method"], r["type"]): (r["pattern"], r["unresolvable"], r["parameter_count"], r["line_no"]) for r in found.collect()}
    assert rows == {
        ("Feed", "Given"): ('a "quoted" cow', False, 2, 6), ("Feed", "When"): ("tab\t{int}", False, 2, 6), ("ItMoos", "Then"): ("", False, 0, 8),
        ("Made", "Given"): ("", True, 0, 9), ("Raw", "StepDefinition"): ('raw "text" here', False, 0, 10),
    }
    assert [r["method"] for r in unconfirmed.collect()] == ["Far"]
    assert types["Colour"] == "(?i:Red|Dark)" and types["days"] == r"(\d+) days" and types["DateTime"] == "now" and types["int"] == r"-?\d+"


def test_hierarchy_with_cycles(spark):
    rows = [("A", False, ["B"]), ("B", False, ["A"]), ("C", False, ["D"]), ("D", True, []), ("E", False, ["Z"]), ("F", False, [])]
    found = {r["name"]: r["status"] for r in B.binding_status(spark.createDataFrame(rows, "name string, has_binding boolean, bases array<string>")).collect()}
    assert found == {"A": "NotABinding", "B": "NotABinding", "C": "Confirmed", "D": "Confirmed", "E": "Unconfirmable", "F": "NotABinding"}


def test_legacy_bindings(spark):
    text = 'class Steps {\n[Given("one")]\n[When(@"two")]\n\npublic void M() {}\n[Then("three")]\nclass Other\n'
    found = {r["pattern"]: (r["method"], r["type"], r["class"], r["line_no"]) for r in B.legacy_bindings(spark.createDataFrame([("p", "a.cs", text)], "project string, path string, content string")).collect()}
    assert found == {"one": ("M", "Given", "Steps", 2), "two": ("M", "When", "Steps", 3), "three": ("Unknown", "Then", "Steps", 6)}


def unused(spark, settings=None):
    parsed = csharp.parse_sources(spark.createDataFrame([("/none/d.cs", DEAD)], "path string, content string"))
    markup = markup_names(spark.createDataFrame([('<Button Click="ClickHandler" Text="{Binding Gone2}" Gone="no">',)], "content string"))
    return {(r["kind"], r["name"]): r["hint"] for r in U.unused_code(*(csharp.explode(parsed, c) for c in ("declarations", "references", "literals")), markup, settings or UnusedCodeSettings()).collect()}


def test_unused_code(spark):
    found = unused(spark)
    assert set(found) == {("Method", "ByName"), ("Method", "Gone"), ("Method", "Step"), ("Interface", "IUnused"), ("Class", "OldAttribute"), ("Class", "Nobody"), ("Class", "Inner")}
    assert found["Method", "ByName"] == "d.cs:15" and found["Method", "Gone"] is None
    assert ("Method", "Go") not in unused(spark, UnusedCodeSettings(include_public_members=True))
    assert not any(k == "Method" for k, _ in unused(spark, UnusedCodeSettings(analyze_methods=False)))


def run_cascade(spark, reportable, refs, seed):
    declared = spark.createDataFrame(list(reportable.items()), "id string, reportable boolean")
    return {(r["id"], r["round"]) for r in U.cascade(declared, spark.createDataFrame(refs, "from_id string, to_id string"), spark.createDataFrame([(s,) for s in seed], "id string")).collect()}


def test_cascade(spark):
    methods = {"dead": False, "live": False, "a": True, "b": True, "c": True, "pub": False, "own": True}
    assert run_cascade(spark, methods, [("dead", "a"), ("a", "b"), ("live", "c"), ("dead", "c"), (None, "pub")], ["dead"]) == {("a", 1), ("b", 2)}
    assert run_cascade(spark, methods, [("dead", "a"), ("live", "a")], ["dead"]) == set()
    assert run_cascade(spark, methods, [("dead", "a"), (None, "a")], ["dead"]) == set()
    assert run_cascade(spark, methods, [("dead", "a"), ("a", "a")], ["dead"]) == set()
    assert run_cascade(spark, methods, [("dead", "a")], []) == set()


def test_seeds_take_the_nearest_overload(spark):
    parsed = csharp.parse_sources(spark.createDataFrame([("/n.cs", "class C {\nvoid M(int a) {}\n[Given(\"x\")]\nvoid M() {}\nvoid M(string s) {}\n}")], "path string, content string"))
    dead = spark.createDataFrame([(1, "/n.cs", "C", "M", 3)], "binding_id long, path string, class string, method string, line_no int")
    assert [r["id"] for r in U.seed_methods(dead, csharp.explode(parsed, "declarations")).collect()] == ["C.M()"]


def test_lexer():
    kinds = [(t.kind, t.text) for t in csharp.lex('$"a{ F("}") :x}b" @"q""q" \'"\' #if X\n1.5f """\n  r\n  """')]
    assert kinds[0] == ("interpolated", "ab") and ("name", "F") in kinds and ("string", 'q"q') in kinds and ("string", "r") in kinds and kinds[-1][0] == "string"


def test_hierarchies_of_any_shape_and_what_the_driver_gets(spark):
    import random

    from stepweave.operators import bindings as B

    r = random.Random(4)
    names = [f"c{i}" for i in range(60)]
    rows = [(n, r.random() < 0.1, r.sample([*names, "gone", "lost"], r.choice([0, 1, 1, 2]))) for n in names] + [("loop", False, ["loop"]), ("own", None, []), ("null", False, [None])]
    own = {n: (h, b) for n, h, b in rows}

    def status(name):
        seen, todo = set(), [name]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += own.get(at, (None, []))[1]
        if any(own.get(n, (None, []))[0] for n in seen):
            return "Confirmed"
        return "Unconfirmable" if any(own.get(n, (None, []))[0] is None for n in seen) else "NotABinding"

    found = B.binding_status(spark.createDataFrame(rows, "name string, has_binding boolean, bases array<string>").repartition(3))
    assert {x["name"]: x["status"] for x in found.collect()} == {n: status(n) for n in own}
    assert {"Confirmed", "Unconfirmable", "NotABinding"} == {status(n) for n in own}
