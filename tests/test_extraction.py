import hashlib

from gaugeworks.functions.islands import functions
from gaugeworks.operators import extraction as x
from gaugeworks.plans.extraction_queries import QUERIES

PY = '''
from pkg.util import helper as h
import os

@server.tool(description="Adds numbers")
def add(a, b):
    """Unused."""
    if a and b:
        return h(a)
    return inner(b)

def inner(z):
    s = "call_in_string(1)"  # call_in_comment(2)
    for i in range(z):
        inner(i)
    return os.path(z)

class Box:
    def put(self, v):
        self.check(v)
        def local(q):
            if q: return 1
        return local(v)

    def check(self, v):
        return missing(v)
'''


def files(spark, *rows):
    return spark.createDataFrame([(i + 1, r, p, None, b, "mine") for i, (r, p, b) in enumerate(rows)], "file_id long, repo_name string, file_path string, file_lang string, body string, seq string")


def test_definitions_and_complexity(spark):
    got = {r.qualified_name: (r.start_line, r.end_line, r.complexity) for r in x.definitions(files(spark, ("r", "a/m.py", PY))).collect()}
    assert got["add"] == (6, 10, 2) and got["inner"] == (12, 16, 2) and got["Box.put"] == (19, 23, 1) and got["local"][2] == 2


def test_tools_and_resolution(spark):
    f = files(spark, ("r", "a/m.py", PY), ("r", "a/util.py", "def helper(q):\n    return deep(q)\n"), ("r", "b/c/util.py", "def helper(q):\n    pass\n\ndef deep(w):\n    pass\n"))
    tools = x.detected_tools(f).collect()
    assert [(t.name, t.description, t.description_is_literal, t.qualified_name) for t in tools] == [("add", "Adds numbers", True, "add")]
    r = {(c.caller, c.raw_text): (c.target, c.step, c.ambiguous) for c in x.resolve_calls(x.call_sites(f), x.definitions(f), x.imports(f)).collect()}
    assert r["add", "inner"] == ("inner", 2, False) and r["inner", "inner"] == ("inner", 2, False)
    assert r["Box.put", "self.check"] == ("Box.check", 1, False)
    assert r["helper", "deep"] == ("deep", 4, False) and r["inner", "os.path"][0] is None and r["Box.check", "missing"] == (None, 0, False)
    assert ("inner", "call_in_string") not in r and ("inner", "call_in_comment") not in r


def test_nearest_definition_equals_brute_force(spark):
    paths = ["a/x.py", "a/b/x.py", "a/b/c/x.py", "d/x.py", "x.py"]
    f = files(spark, *[("r", p, f"class K{i}:\n    pass\n\ndef only{i}():\n    target()\n") for i, p in enumerate(paths)], ("r", "a/b/t1.py", "class A:\n    def target(self):\n        pass\n"), ("r", "d/e/t2.py", "class B:\n    def target(self):\n        pass\n"))

    def dist(a, b):
        p, q = a.split("/")[:-1], b.split("/")[:-1]
        k = 0
        while k < min(len(p), len(q)) and p[k] == q[k]:
            k += 1
        return len(p) + len(q) - 2 * k

    got = {c.caller: (c.target, c.ambiguous) for c in x.resolve_calls(x.call_sites(f), x.definitions(f), x.imports(f)).where("callee = 'target'").collect()}
    for i, p in enumerate(paths):
        near = sorted((dist(p, q), t) for q, t in (("a/b/t1.py", "A.target"), ("d/e/t2.py", "B.target")))
        assert got[f"only{i}"] == (near[0][1], near[0][0] == near[1][0]), p


def test_closure_and_graph(spark):
    edges = spark.createDataFrame([("r", a, b) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]], "repo_name string, source string, target string")
    roots = spark.createDataFrame([("r", "a"), ("r", "e"), ("r", "zz")], "repo_name string, qualified_name string")
    got = sorted((r.root, r.name) for r in x.closure(edges, roots).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("e", "e"), ("zz", "zz")]


def test_nothing_to_parse(spark):
    f = files(spark, ("r", "a.py", None), ("r", "b.txt", "def x(): pass"), ("r", "c.py", ""), (None, "d.py", "def broken(:\n"))
    assert x.definitions(f).collect() == [] and x.detected_tools(f).collect() == []


def test_other_languages():
    go = 'package m\n// Does it.\nfunc (s *Box[T]) Put(a int) error {\n\tx := "} {"\n\treturn nil\n}\n'
    assert [(q, n, a) for q, n, a, *_ in functions(go, "go")] == [("Box.Put", "Put", 3)]
    ts = "export class A<T> {\n  private n = 1;\n  async run(x: {a: number}) { if (x) { return; } }\n}\nconst f = async (a) => {\n  return 1;\n};\n"
    assert [q for q, *_ in functions(ts, "typescript")] == ["A.run", "f"]
    rust = "impl<T> Show for Box<T> {\n    pub fn show(&self) -> u8 { 'a'; 1 }\n}\nmod m { fn free() {} }\n"
    assert [q for q, *_ in functions(rust, "rust")] == ["Box.show", "free"]
    java = 'class A {\n  private final int x = call(1);\n  @Tool(name = "n")\n  public <T> List<T> get(int a) throws E {\n    new B() { };\n    return x;\n  }\n}\n'
    assert ("A.get", 4) in [(q, a) for q, n, a, *_ in functions(java, "java")]
    cs = "namespace N { public class C {\n  public int P => 1;\n  /// <summary>Sum.</summary>\n  [X]\n  public static async Task<int> Add(int a)\n  { return a; }\n} }\n"
    assert ("C.Add", 5) in [(q, a) for q, n, a, *_ in functions(cs, "csharp")]
    rb = "module M\n  class C\n    # Adds.\n    def self.add(a)\n      a if a\n    end\n  end\nend\ndef free; end\n"
    assert [q for q, *_ in functions(rb, "ruby")] == ["C.add", "free"]


def tools(spark, path, body):
    return [(t.name, t.description, t.description_is_literal, t.sdk_pattern) for t in x.detected_tools(files(spark, ("r", path, body))).orderBy("seq").collect()]


def test_tools_of_every_language(spark):
    py = '@s.list_tools()\nasync def listing():\n    return [Tool(name="a", description="First."), Tool(name=dyn, description="no"), Tool(name="b")]\n'
    assert tools(spark, "a.py", py) == [("a", "First.", True, "python.list_tools_lowlevel"), ("b", "", True, "python.list_tools_lowlevel")]
    ts = "server.setRequestHandler(ListToolsRequestSchema, async () => ({ tools: [{ name: 'a', description: 'First.' }, { name: 'b' }] }));\nserver.tool('c', 'Third.', async () => {});\n// server.tool('no', 'x')\n"
    assert tools(spark, "a.ts", ts) == [("a", "First.", True, "typescript.set_request_handler_lowlevel"), ("b", "", True, "typescript.set_request_handler_lowlevel"), ("c", "Third.", True, "typescript.register_tool")]
    assert tools(spark, "a.dart", "void main() {\n  s.registerTool(Tool(name: 'a', description: 'First.'), run);\n}\n") == [("a", "First.", True, "dart.register_tool")]
    assert tools(spark, "a.kt", 'fun main() {\n  s.addTool(name = "a", description = "First.") { r -> ok(r) }\n}\n') == [("a", "First.", True, "kotlin.add_tool")]
    assert tools(spark, "a.go", 'func main() {\n\tmcp.AddTool(s, &mcp.Tool{Name: "a", Description: "First."}, run)\n}\n') == [("a", "First.", True, "go.register_tool".replace("register", "add"))]
    assert tools(spark, "a.rb", 'class A < Base::Tool\n  tool_name "a"\n  description "First."\n  def call(x)\n  end\nend\n') == [("a", "First.", True, "ruby.tool_class")]
    assert tools(spark, "A.java", 'class A {\n  @Tool(name = "a", description = "First.")\n  public int f(int x) {\n    return x;\n  }\n}\n') == [("a", "First.", True, "java.tool_annotation")]
    assert tools(spark, "a.cs", 'class A {\n  [McpServerTool, Description("First.")]\n  public static int F(int x)\n  { return x; }\n}\n') == [("F", "First.", True, "csharp.server_tool_attribute")]
    assert tools(spark, "a.rs", "impl A {\n    /// First.\n    #[tool]\n    fn f(&self) -> u8 { 1 }\n}\n") == [("f", "First.", True, "rust.tool_attribute")]


def test_dart_and_kotlin_functions():
    kt = "class A {\n  fun <T> run(x: Int): Int {\n    return x\n  }\n}\nfun free() { }\n"
    assert [q for q, *_ in functions(kt, "kotlin")] == ["A.run", "free"]
    dart = "class A {\n  Future<int> run(int x) async {\n    if (x > 1) { return 2; }\n    return x;\n  }\n}\n"
    assert [q for q, *_ in functions(dart, "dart")] == ["A.run"]


def test_long_quoted_and_joined_descriptions(spark):
    long = "Returns the user's name (and address). " * 30
    got = lambda path, body: [r[:3] for r in tools(spark, path, body)]
    want = [("a", long, True)]
    assert got("a.ts", f'server.registerTool("a", {{ inputSchema: {{ q: {{ description: "no" }} }}, description: "{long}" }}, run);\n') == want
    assert got("a.js", f'server.tool("a", "{long}", run);\n') == want
    assert got("a.go", f'func main() {{\n\tmcp.AddTool(s, &mcp.Tool{{Name: "a", Description: "{long}"}}, run)\n}}\n') == want
    assert got("a.py", f'@s.tool(\n    name="a",\n    description="{long}",\n)\ndef f(x):\n    pass\n') == want
    assert got("b.py", f'@s.list_tools()\nasync def listing():\n    return [Tool(name="a", inputSchema={{"name": 1}}, description="{long[:50]}"\n        "{long[50:]}")]\n') == want
    assert got("a.rb", f'class A < Base::Tool\n  tool_name "a"\n  description "{long}"\n  def call(x)\n  end\nend\n') == want
    assert got("A.java", f'class A {{\n  @Tool(name = "a", description = "{long}")\n  public int f(int x) {{\n    return x;\n  }}\n}}\n') == want
    assert got("a.dart", f'void main() {{\n  s.registerTool(Tool(name: "a", description: "{long}"), run);\n}}\n') == want
    assert got("a.rs", f'impl A {{\n    #[tool(name = "a", description = "{long}")]\n    fn f(&self) -> u8 {{ 1 }}\n}}\n') == want
    assert got("c.ts", "server.tool('a', 'It\\'s \"so\".', run);\n") == [("a", 'It\'s "so".', True)]


def test_third_party_add_tool(spark):
    ts = 'server.addTool({\n  name: "a",\n  parameters: { description: "no" },\n  description: "First.",\n  execute: async (x) => run(x),\n});\naddTool({ name: "b", execute: run });\naddTool({ name: "c" });\nserver.addTool(tool);\n// addTool({ name: "no" })\n'
    assert tools(spark, "a.ts", ts) == [("a", "First.", True, "typescript.add_tool"), ("b", "", True, "typescript.add_tool")]


def _tool_rows(spark, *rows):
    return {(t.name, t.description, t.description_is_literal, t.qualified_name, t.start_line, t.end_line) for t in x.detected_tools(files(spark, *rows)).collect()}


def test_python_names_and_descriptions(spark):
    body = '''
NAME = "const_name"
OTHER = NAME
TEXT = "Don't call twice (ever)."

@app.tool(
    name=OTHER,
    description=TEXT,
)
@app.tool("second")
def run(a):
    return a

@app.tool(description="Get x (all of it).")
def get(x):
    return x
'''
    got = _tool_rows(spark, ("r", "m.py", body))
    assert got == {("const_name", "Don't call twice (ever).", False, "run", 11, 12), ("get", "Get x (all of it).", True, "get", 15, 16)}


def test_registration_with_a_named_or_inline_handler(spark):
    body = '''
const DESC = "Looks things up.";
async function look(args) {
  if (args) { return deep(args); }
  return 1;
}
function deep(q) {
  return q;
}
server.registerTool("look_up", { description: DESC }, look);
server.tool("inline_one", "Does it inline.", async (a) => {
  if (a) { return deep(a); }
  return 2;
});
server.addTool({ name: "third", description: "Third one.", execute: look });
'''
    f = files(spark, ("r", "src/m.ts", body))
    got = _tool_rows(spark, ("r", "src/m.ts", body))
    assert got == {("look_up", "Looks things up.", False, "look", 3, 6), ("inline_one", "Does it inline.", True, "<call:11>", 11, 14), ("third", "Third one.", True, "look", 3, 6)}
    defs, tools = x.definitions(f), x.detected_tools(f)
    reach = x.closure(x.edges_of(x.resolve_calls(x.call_sites(f), defs, x.imports(f))), tools)
    assert {(r.root, r.name) for r in reach.collect()} == {("look", "look"), ("look", "deep"), ("<call:11>", "<call:11>"), ("<call:11>", "deep")}
    m = {r.qualified_name: (r.loc, r.complexity, r.functions) for r in x.tool_measures(tools, reach, defs).collect()}
    assert m == {"look": (7, 3, 2), "<call:11>": (7, 3, 2)}


def test_listed_tools_of_a_named_list_and_a_choice(spark):
    body = '''
const TOOLS = [
  { name: "one", description: "First." },
  ...(flag ? [{ name: "two", description: "A." }] : [{ name: "two", description: "B." }]),
];
const ALL = TOOLS;
server.setRequestHandler(ListToolsRequestSchema, async () => {
  return { tools: ALL.filter((t) => t).map((t) => t) };
});
'''
    assert {(n, d) for n, d, *_ in _tool_rows(spark, ("r", "m.ts", body))} == {("one", "First."), ("two", "A.")}


def test_values_across_files(spark):
    f = files(
        spark,
        ("r", "a/m.ts", 'import { TEXT } from "./texts";\nimport { WIDE } from "../far/wide.js";\nconst LOCAL = "here";\nserver.addTool({ name: "t", description: TEXT, execute: async () => 1 });\n'),
        ("r", "a/texts.ts", 'export const TEXT = DEEPER;\nexport const DEEPER = "Said " +\n  "elsewhere.";\n'),
        ("r", "b/texts.ts", 'export const TEXT = "Not this.";\n'),
        ("r", "far/wide.ts", 'export const WIDE = "w";\n'),
        ("r", "x/one.py", "ONLY = 'lone'\nOTHER: str = 'q'\nx = f(1)\n"),
    )
    table = x.values(f)
    assert {(r.file_path, r.bare_name): (r.literal, r.stands_for) for r in table.collect()} == {("a/m.ts", "LOCAL"): ("here", None), ("a/texts.ts", "TEXT"): (None, "DEEPER"), ("a/texts.ts", "DEEPER"): ("Said elsewhere.", None), ("b/texts.ts", "TEXT"): ("Not this.", None), ("far/wide.ts", "WIDE"): ("w", None), ("x/one.py", "ONLY"): ("lone", None), ("x/one.py", "OTHER"): ("q", None), ("x/one.py", "x"): (None, None)}
    refs = spark.createDataFrame([("r", "a/m.ts", n) for n in ("LOCAL", "TEXT", "WIDE", "ONLY", "NONE")], "repo_name string, file_path string, name string")
    got = {r.name: (r.step, r.target_file, r.ambiguous) for r in x.resolve_values(refs, table, x.imports(f)).collect()}
    assert got == {"LOCAL": (1, "a/m.ts", False), "TEXT": (2, "a/texts.ts", True), "WIDE": (2, "far/wide.ts", False), "ONLY": (3, "x/one.py", False), "NONE": (0, None, False)}
    followed = {r.name: (r.literal, r.hops) for r in x.followed_values(refs, table, x.imports(f)).collect()}
    assert followed == {"LOCAL": ("here", 1), "TEXT": ("Said elsewhere.", 2), "WIDE": ("w", 1), "ONLY": ("lone", 1), "NONE": (None, 1)}
    tools = x.described_tools(x.detected_tools(f), table, x.imports(f)).collect()
    assert [(t.name, t.description, t.description_is_literal) for t in tools] == [("t", "Said elsewhere.", False)]


def _reached(df):
    return sorted(((r.repo_name, r.root, r.name) for r in df.collect()), key=str)


def test_tool_closure_equals_the_general_one(spark, monkeypatch):
    monkeypatch.setattr(x, "ROOTS", 2)
    monkeypatch.setattr(x, "CHUNK", 3)
    server = "@mcp.tool()\ndef {0}(a):\n    return {1}(a) + near(a) + twice(a) + print(a)\n\nclass K:\n    def near(self):\n        return self.other()\n    def other(self):\n        return {0}(1)\n\ndef {1}(b):\n    return K.near(b) + outside(b)\n"
    rows = [("r", f"a/s{k}.py", server.format(f"t{k}", f"u{k}")) for k in range(5)]
    rows += [("r", "a/n.py", "def near(z):\n    return t0(z)\n"), ("r", "b/x.py", "def twice(z):\n    return 1\n"), ("r", "c/x.py", "def twice(z):\n    return self.lost(2)\n")]
    rows += [("r", "a/n.py", "def near(z):\n    return t4(z)\n"), (None, "a.py", server.format("t", "u")), ("q", "a.py", None), ("q", "s.py", server.format("t0", "u0"))]
    f = files(spark, *rows)
    u = x.unique_files(f)
    want = _reached(x.closure(x.edges_of(x.resolve_calls(x.call_sites(u), x.definitions(u), x.imports(u))), x.detected_tools(u)))
    assert len(want) > 20 and _reached(x.tool_closure(f)) == want
    monkeypatch.setattr(x, "FEW", -1)
    assert _reached(x.tool_closure(f)) == want


def test_closure_moves_no_texts_and_no_pairs(spark, tmp_path):
    """A ring of 300 tools (90,000 pairs) in files whose texts do not compress: what is shuffled stays far below both."""
    dull = lambda k: "".join(hashlib.sha256(f"{k}.{i}".encode()).hexdigest() for i in range(300))
    text = lambda k: f"# {dull(k)}\n@mcp.tool()\ndef tool_{k}(a):\n    return tool_{(k + 1) % 300}(a)\n"
    files(spark, *(("r", f"a/f{k}.py", text(k)) for k in range(300))).write.parquet(f"{tmp_path}/source_files.parquet")
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty(10_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = moved()
    assert QUERIES["ext07_closure"](spark, str(tmp_path)).count() == 300 * 300
    assert moved() - before < 1_000_000
