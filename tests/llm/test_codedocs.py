import ast
import time

import pytest

from siftmill.llm import codedocs as D

DOC = "Gives back the sorted rows of a table."


def names(text, language):
    return [(f.name, f.line, D.says_something(f.doc, f.name)) for f in D.functions(text, language)]


def documented(text, language):
    return [(n, line) for n, line, said in names(text, language) if said]


def test_python():
    text = f'''import os
x = """def hidden():
    '''+"'''"+f'''{DOC}'''+"'''"+f'''
"""
# def commented(): pass
def one(a, b: int = 3, *rest, **more) -> dict[str, int]:  # note
    """{DOC}"""
    def inner(): r\'{DOC}\'
    return inner
class C:
    @cached(seconds=3)
    async def two(self,
        other: "list[int]",
    ):
        # first a comment
        "{DOC[:20]}" "{DOC[20:]}"
    def bytes_(self):
        b"{DOC}"
    def formatted(self):
        f"{DOC}"
    def expression(self):
        "{DOC}" % 3
    def empty(self):
        """"""
    def three(self): """TODO: say what this does with rows"""
def four():
\t("{DOC}")
def five_name_of_it():
    "Five name of it"
def six():
"{DOC}"
print "broken %d" % 3
def seven(a, b:
    """{DOC}"""
def eight(): pass
'''
    assert documented(text, "python") == [("one", 6), ("inner", 8), ("two", 12), ("four", 26), ("seven", 33)]
    one = D.functions(text, "python")[0]
    assert one.args == ["a", "b: int = 3", "*rest", "**more"] and one.doc == DOC and one.code.endswith("return inner")


def test_python_agrees_with_the_parser():
    with open(D.__file__) as f:
        text = f.read()
    want = sorted((n.name, n.lineno, ast.get_docstring(n)) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))
    assert sorted((f.name, f.line, f.doc or None) for f in D.functions(text, "python")) == want


def test_javascript_and_typescript():
    text = f"""/** {DOC} */
import a from 'a';
/** {DOC} */
export default async function one(a, {{ b, c }}, [d] = [1, 2]) {{
  /** {DOC} */
  const inner = async (x) => {{ return x; }};
  if (x) {{ call(); }}
}}
// {DOC}
function two() {{}}
/* {DOC} */
let three = x => x + 1;
const s = `
/** {DOC} */
function hidden() {{ ${{ f(function () {{ return '}}' }}) }} }}
`;
class K extends L {{
  /**
   * {DOC}
   * @param {{string}} a something
   */
  @deco({{ a: 1 }})
  static async four<T>(a: Map<string, number>, b?: {{ c: number }}): Promise<{{ d: T }}> {{ return /[{{]/.test(a); }}
  /** @param a only a list of tags */
  five() {{ }}
  /** {DOC} */
  get six() {{ return 1; }}
  /** {DOC} */
  abstract seven(a: string): void;
  /** {DOC} */
  eight = (a: number): number => {{ return a; }};
}}
/** {DOC} */
exports.nine = function () {{ }};
const o = {{
  /** {DOC} */
  ten(a) {{ }},
  /** {DOC} */
  eleven: function (a) {{ }},
}};
/** {DOC} */
// and a remark
function twelve() {{}}
/** {DOC} */
function broken(a {{
/** {DOC} */
function thirteen(a) {{ return "
"""
    want = ["one", "inner", "four", "six", "eight", "nine", "ten", "eleven", "thirteen"]
    assert [n for n, _ in documented(text, "typescript")] == want
    assert [n for n, _ in documented(text.replace("\n", "\r\n"), "javascript")] == want
    found = {f.name: f for f in D.functions(text, "typescript")}
    assert found["one"].args == ["a", "{ b, c }", "[d] = [1, 2]"] and found["four"].line == 23 and found["four"].code.endswith(".test(a); }") and {"two", "three", "five", "twelve"} <= set(found)


def test_java():
    text = f"""package a;
/** {DOC} */
public class A {{
  /** {DOC} */
  public A(int x) {{ }}
  /** {DOC} */
  @Cached(seconds = 59)
  @Names({{"a", "b"}})
  public static <T extends B<T>> Map<String, List<T>> one(final int a, Map<String, Long> b) throws X, Y {{ new Foo() {{ }}; return null; }}
  /** {{@inheritDoc}} */
  void two() {{ if (a) {{ }} for (;;) {{ }} while (b()) {{ }} }}
  /** {DOC} */
  abstract void three();
  // {DOC}
  int[] four() {{ String s = "/** {DOC} */ void hidden() {{ }}"; char c = '{{'; return null; }}
  /** {DOC} */
  private final Function<A, B> five = (a) -> {{ return b(a); }};
  String t = \"\"\"
    /** {DOC} */ void hidden() {{ }}
    \"\"\";
  /** {DOC} */
  protected void six() {{
"""
    assert documented(text, "java") == [("A", 5), ("one", 9), ("five", 17), ("six", 22)]
    assert {n for n, _, _ in names(text, "java")} == {"A", "one", "two", "four", "five", "six"}


def test_go_and_rust():
    go = f"""// Package a {DOC}
package a

// One {DOC}
//go:noinline
func One(a []int64, f func(int) error) (int, error) {{ return 0, nil }}

// Two {DOC}

func Two() {{ s := `
// {DOC}
func hidden() {{}}
` }}
/* {DOC} */
func (s *S[T]) Three[T any](m map[string]int) {{ r := '{{'; f := func() {{}} }}
//
func four() {{}}
// Five {DOC}
var five = func(a int) {{ }}
"""
    assert documented(go, "go") == [("One", 6), ("Three", 15), ("five", 19)]
    rust = f"""//! {DOC}
/// {DOC}
#[must_use]
#[cfg(any(a, b))]
pub(crate) async fn one<'a, T: Into<Vec<u8>>>(x: &'a str, t: T) -> Result<T, Box<dyn E>> where T: X {{ let c = '{{'; let s = r#"fn hidden() {{ "#; x }}
// {DOC}
fn two() {{ }}
/* a /* nested */ /// {DOC}
fn hidden() {{}} */
trait T {{
    /// {DOC}
    fn three(&self) -> u64;
    /// {DOC}
    /// and more
    fn four(&self) -> u64 {{ 1 }}
}}
//// {DOC}
fn five() {{ }}
"""
    assert documented(rust, "rust") == [("one", 5), ("four", 15)]


@pytest.mark.parametrize("doc,name,want", [(None, "f", False), ("", "f", False), ("Just three words", "f", False), ("Now there are four", "f", True), ("TODO say more about it here", "f", False), ("todo: say more about it", "f", False), ("Split the big table", "splitTheBigTable", False), ("@param a of the rows\n:return: all of the rows", "f", False), ("It is x1 y2 z3", "f", True)])
def test_trivial(doc, name, want):
    assert D.says_something(doc, name) is want


def test_languages():
    assert D.language_of("PYTHON", ".txt", None) == "python" and D.language_of(None, ".TS", None) == "typescript"
    assert D.language_of(None, None, r"C:\a\b.rs") == "rust" and D.language_of("cobol", "", "x") is None


def test_documented(spark):
    body = f'def f(a):\n    """{DOC}"""\n    return a\n'
    rows = [(1, "a.py", ".py", "python", body), (1, "a.py", ".py", "python", body), (2, "b", None, None, body), (3, "c.py", ".py", None, None), (4, "d.py", ".PY", "PYTHON", ""), (5, "e.py", None, None, "x = 1\n" * 50_000 + body), (6, "f.py", ".py", "python", "def g(\n" * 2000)]
    df = spark.createDataFrame(rows, "file_id long, path string, extension string, language string, content string").selectExpr("*", "1 as name", "2 as docstring", "3 as id", "4 as code")
    out = D.documented(df).collect()
    assert sorted((r["file_id"], r["name"], r["line_number"]) for r in out) == [(1, "f", 1), (1, "f", 1), (5, "f", 50_001)]
    assert {(tuple(r["args"]), r["docstring"]) for r in out} == {(("a",), DOC)}
    assert D.documented(df.limit(0)).count() == 0


def test_long_return_type():
    from siftmill.llm import codedocs as C

    code = "(a: string): { " + " ".join(f"field{i}: number;" for i in range(200)) + " } => { return x }"
    at = code.index(")") + 1
    assert code[C.arrow_body(C.Code(code), at) :] == "{ return x }"
    assert C.arrow_body(C.Code("(a) : b) => c"), 3) == -1


def test_code_in_templates():
    text = f"""const a = `x {{ /** no */ function no() {{}} ${{ list.map(function () {{ return `${{ {{ b: 1 }}.b }}` }}) }} `;
const b = `${{(x) => x}}`;
const c = `
${{
  /** {DOC} */
  function one(a) {{ return a }}
}}
`;
/** {DOC} */
function two() {{ return `\\`${{`}}`}}` }}
/** {DOC} */
const three = (a) => `${{a}}`;
"""
    assert documented(text, "javascript") == [("one", 6), ("two", 10), ("three", 12)]


LONG = [
    ("javascript", "function f(a) {\n x = 1;\n" * 60_000), ("javascript", "`${ " * 20_000), ("javascript", "x = {" + ",".join(f"a{i}:{i}" for i in range(120_000)) + "}"), ("typescript", "f(a: b): c\n" * 100_000), ("javascript", "a." * 500_000 + "b = 1"), ("javascript", "@a(" * 300_000),
    ("python", "def f(\n" * 150_000), ("python", "def f() " + "[a]" * 40_000 + "\n    pass\n"), ("python", "def f(a):\n    '''x\n" * 60_000), ("java", "void f(int a) { if (x) {\n" * 50_000), ("java", "f(f<" * 200_000), ("go", "func f(a int)\n" * 100_000), ("go", "x := func(a int) {\n" * 60_000),
    ("rust", "fn f(a: u8) -> B {\n" * 60_000), ("rust", "/* " * 300_000), ("javascript", "/** a */\n" * 100_000 + "function f() {}"),
]


@pytest.mark.parametrize("at", range(len(LONG)))
def test_time_grows_with_the_length(at):
    language, text = LONG[at]
    began = time.perf_counter()
    found = D.functions(text, language)
    assert sum(len(f.signature) for f in found) <= 40 * len(text)
    assert time.perf_counter() - began < 10


def test_declarations_without_bodies():
    assert documented(f"/** {DOC} */\nf(1)\nif (x) {{ }}\n/** {DOC} */\nfunction g(a: b): c\n/** {DOC} */\nfunction g(a: d): e {{ }}\n", "typescript") == [("g", 7)]
    assert documented(f"// F {DOC}\nfunc F(a int) error\n\n// G {DOC}\nfunc G(a int) interface{{ X() }} {{ }}\n", "go") == [("G", 5)]
    java = f"enum E {{ /** {DOC} */ A(1) {{ }}, B(2); /** {DOC} */ E(int x) {{ }}\n/** {DOC} */\n@X(a = 1)\npublic @Y <T extends Z<T>> java.util.List<T[]> f(T a) throws Q {{ return new java.util.List<T>() {{ }}; }} }}"
    assert [n for n, _ in documented(java, "java")] == ["E", "f"]
