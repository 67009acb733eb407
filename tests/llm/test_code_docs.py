import ast

import pytest

from gaugeworks.llm import code_docs as c
from gaugeworks.sources.tables import read_table

FILES = "file_id long, file_path string, file_lang string, body string, name string, language string"


def got(spark, *rows):
    df = spark.createDataFrame([(i, p, l, b, "mine", "mine") for i, (p, l, b) in enumerate(rows)], FILES)
    return sorted((r.file_id, r.qualified_name, r.start_line) for r in c.found(df).collect())


PYTHON = '''
class A:
    """About the class."""
    @deco(
        "x")
    async def run(
        self, a: str = "):", b={"k": [1]},
    ) -> dict[str, int]:
        r"""Runs the job and returns rows."""
        def helper():
            """Helps to run the job."""

    def run_job(self):
        """Run job."""
    def no(self): pass
    def f(self):
        x = """Not a docstring at all."""
    def g(self):
        f"""Formatted {x} text is none."""
    def todo(self):
        """TODO: document"""
s = """
def fake():
    'Not code at all, this is text.'
"""
'''


def test_python(spark):
    assert got(spark, ("a.py", None, PYTHON), ("b.x", "Python", PYTHON.replace("\n", "\r\n"))) == [(i, q, n) for i in (0, 1) for q, n in (("A.run", 6), ("helper", 10))]


@pytest.mark.parametrize(
    ("path", "body", "want"),
    [
        ("a.ts", "import x from 'y'\n/** File header text here. */\nimport z from 'q'\n\n/**\n * Adds two numbers together.\n * @param a first\n */\n@dec({a: 1})\nexport async function add(a: {x: number}) {\n  /** inner note for nobody */\n  const t = `} /** x */ {`;\n}\n/** Builds the list of rows. */\nexport const build = async (n) => {\n};\n", [("add", 10), ("build", 15)]),
        ("a.js", "class B {\n  /** Puts one row into the box. */\n  static async put(a) { return '}'; }\n  /* Plain comment is none here. */\n  get(a) {}\n  /** @returns {number} */\n  only(a) {}\n}\n", [("B.put", 3)]),
        ("A.java", '/** About the class itself. */\npublic class A {\n  /** Fetches one row from the store. */\n  @Tool(name = "x")\n  @Override\n  public List<String> fetch(String a)\n      throws E {\n    String s = "/** no */ void x() {";\n  }\n}\n', [("A.fetch", 6)]),
        ("a.rs", "/// About the struct.\npub struct S;\nimpl<T> Show for S {\n    /// Shows one row to the user.\n    #[tool(x = 1)]\n    // plain\n    pub async fn show(&self) -> u8 { b'{' }\n    //! inner\n    fn bare(&self) {}\n}\n/// Counts all rows of it.\nfn count<'a>(x: &'a str) {}\n", [("S.show", 7), ("count", 12)]),
        ("a.cs", 'class C {\n  /// <summary>\n  /// Saves the row into a file.\n  /// </summary>\n  /// <param name="a">text</param>\n  [Server]\n  public static async Task<int> Save(string a)\n  { var s = @"c:\\"; return 1; }\n  /// <param name="a">only a parameter text</param>\n  public void No(int a) { }\n}\n', [("C.Save", 7)]),
        ("a.go", "// Part of the file header text.\npackage m\n\n// Puts one row into the box.\nfunc (b *Box) Put(a int) error {\n\ts := `func (b *Box) X() {`\n}\n\n// Too far away from the function.\n\nfunc Far() {}\n/*\nDeletes all rows of it.\n*/\nfunc Del() {}\n//go:noinline\nfunc Dir() {}\n", [("Box.Put", 5), ("Del", 15)]),
        ("a.rb", "# Class text is none of it.\nclass C\n  # Puts one row into it.\n  # @param a x\n  def put(a)\n    s = 'def x # no'\n  end\n\n  # Far away from there.\n\n  def far; end\n=begin\nReads the rows of it.\n=end\n  def self.read(a)\n  end\nend\n", [("C.put", 5), ("C.read", 15)]),
    ],
)
def test_languages(spark, path, body, want):
    assert got(spark, (path, "wrong", body)) == [(0, *w) for w in want]


def test_broken_files_keep_their_islands(spark):
    body = "<<<<<<< ours\n=======\n>>>>>>> theirs\n/** Reads all rows of a file. */\nfunction read(a) {\n  if (x { \n}\n/** Writes all rows of a file. */\nfunction write(a) {\n}\n"
    assert (0, "read", 5) in got(spark, ("a.js", None, body))
    assert got(spark, ("a.py", None, 'def f(a):\n    """Reads rows of the file."""\n  bad indent(\n')) == [(0, "f", 1)]


def test_trivial_texts():
    for doc in ("", "TODO", "tbd", "...", "***", "N/A", "Fetch row", "fetch_row", "FetchRow.", "docs", "TBD later", "todo write docs", "@param a first", "Args:\n    a: text"):
        assert c.is_trivial(doc, "fetch_row"), doc
    for doc in ("Fetches rows from disk.", "Todo lists are read and merged into one list here."):
        assert not c.is_trivial(doc, "fetch_row"), doc


def test_nulls_empty_and_repeats(spark):
    one = 'def f():\n    """Reads the rows of it."""\n'
    assert got(spark, (None, None, one), ("a.py", None, None), ("a.py", None, ""), ("a.py", None, one), ("b.py", None, one), ("a.py", None, "# x\n" * 50_000 + one)) == [(3, "f", 1), (4, "f", 1), (5, "f", 50_001)]
    assert got(spark) == []


def test_python_files_equal_ast(spark, sf):
    for r in read_table(spark, sf, "source_files").collect():
        if c.language_of(r.file_path, r.file_lang) != "python":
            continue
        try:
            tree = ast.parse(r.body.replace("\r\n", "\n"))
        except SyntaxError:
            continue
        want = set()

        def walk(node, own):
            for x in ast.iter_child_nodes(node):
                if isinstance(x, ast.ClassDef):
                    walk(x, x.name)
                elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    want.add((f"{own}.{x.name}" if own else x.name, x.lineno, bool((ast.get_docstring(x) or "").strip())))
                    walk(x, None)
                else:
                    walk(x, own)

        walk(tree, None)
        assert {(q, a, bool(doc.strip())) for q, _n, a, _z, doc, _code in c.functions(r.body, "python")} == want
