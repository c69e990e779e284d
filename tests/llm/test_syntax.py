from __future__ import annotations

import pytest

from repolith.llm import syntax as S

GOOD = {
    "java": ['class A { char c = \'{\'; String s = "}\\"("; /* ( */ // [\n int f(int[] a) { return a[0] + b++; } }', 'class T { String s = """\n  "quoted" {\n  """; }', "import a.b;\n", "", "@Foo(x = 1)\nclass A {\n  if_ x;\n}\n"],
    "c": ['#include "a.h"\n#if X\nint f() {\n#else\nint f(int a) {\n#endif\n  return \'"\';\n}\n', "#define M(x) \\\n  do { x\nint a = 1;\n", "int f(void) {\n  for (;;) { break; }\n  return 0;\n}\n", "static int\nmain(void) {\n#if 0\n  int b = (;\n#endif\n  return 0;\n}\n", "// ends \\\n still comment (\nint x;\n"],
    "cpp": ['auto s = R"x(un"balanced (])x";\nint n = 1\'000\'000;\n', "template <typename T>\nclass A : public B<T> {\npublic:\n  A() : x(1) {}\n};\n", "namespace a::b {\nint x = y ? 1 : 2;\n}\n", "bool operator+(A a);\n"],
    "csharp": ['class A { string p = @"c:\\"; string q = $"{x["a"]} {{"; string r = """raw " { """; }\n', "#region it's\nnamespace A.B;\nvar x = y?.z ?? 1;\n#endregion\n", "using System.Text;\nclass A { int F() => 1; }\n"],
    "go": ['package a\n\nimport (\n\t"x"\n)\n\nvar r = \'(\'\nvar raw = `un"bal {`\n\nfunc f(a, b int) int {\n\treturn a\n}\n', "package a\n"],
    "rust": ["fn f<'a>(s: &'a str) -> char { '{' }\n", 'const S: &str = r#"a " ( "#;\n/* outer /* inner ( */ ) */\nuse a::{b, c};\n', "macro_rules! m { ($x:expr) => { $x }; }\n", "let x = b'\\'';\n"],
    "javascript": ["const r = /[{(\\[]+/g;\nconst t = `a ${b ? `in ${c}` : '{'} } (`;\nconst q = a / b / c;\n", "export default function* g() { yield 1 }\n", "/*\n>>>>>>> quoted\n=======\n<<<<<<< quoted\n*/\nconst o = {a, ...b}\n", "if (x) y()\nelse z()\n", "const a = <p>Don't worry</p>;\n", "const a = <p>ask if you can</p>;\n", "if (a) /'/.test(b);\n", "return (\n  <><A b=\"it's\" {...p}/>{a > 1 ? <b>it's {n}</b> : null}</>\n)\n"],
    "typescript": ["interface A { f(x?: number): void }\nconst x: Map<string, number[]> = new Map();\nclass B<T> { private y = <T>z; }\n", "export const A = () => (\n  <div on={() => { f('}') }}>\n    {/* it's */}\n    <p>Don't ask if you can't</p>\n  </div>\n);\n", "const f = <T>(x: T) => x;\nconst s = 'a</b>';\n", "type U = 'a' | 'b'\nexport const f = (a: number): number => a\n"],
    "python": ["", "def f(a, *, b=(1,)):\n    '''doc ( '''\n    return f\"{a!r:>{b}}\" # (\n", "match x:\n    case {'a': [1, *_]}:\n        pass\n", "x = '''\n<<<<<<< HEAD\n'''\n"],
}
BAD = {
    "java": [('class A { String s = "x; }', "unterminated_literal"), ("class A { int f( { } }", "unbalanced_delimiter"), ("class A {", "premature_end"), ("class A {\n<<<<<<< HEAD\n}\n", "merge_conflict"), ("namespace A {\n}\n", "foreign_language"), ("class A { int x = ; }", "misplaced_token"), ("def f(x):\n    return x\n", "foreign_language"), ("<!DOCTYPE html>\n<p>x</p>\n", "foreign_language"), ("class A {\n int f() {\n  g(1)\n  return 2;\n }\n}", "unended_statement")],
    "c": [("int f() {\n  return 1;\n", "premature_end"), ("int a[3;\n", "premature_end"), ("#if X\nint a;\n#else\nint b = (;\n#endif\n", "premature_end"), ("int f() {\n  int x = g(3)\n  show(x);\n}\n", "unended_statement"), ("class A { int x; };\n", "foreign_language"), ("/* never closed", "unterminated_literal"), ("int f() { return g(1,); }\n", "misplaced_token")],
    "cpp": [("int f() { return 1; ", "premature_end"), ("fn main() {}\nlet mut x = 1;\n", "foreign_language"), ("# Title\n\nSome words about it.\n", "foreign_language")],
    "csharp": [("class A { string s = \"abc; }", "unterminated_literal"), ("import a.b.c;\nclass A {}\n", "foreign_language"), ("using System\n", "premature_end")],
    "go": [("package a\nfunc f() {\n\tx := (1\n}\n", "unbalanced_delimiter"), ("package a\nvar x = `raw", "unterminated_literal"), ("package a\n=======\n", "merge_conflict"), ("package a\nvar x =\n", "premature_end"), ("", "premature_end"), ("name: x\n", "foreign_language"), ('{\n  "a": [1, 2]\n}\n', "foreign_language")],
    "rust": [("fn f() { let s = \"abc; }", "unterminated_literal"), ("fn f() { g(1; }", "unbalanced_delimiter"), ("package a\nfunc f() {}\n", "foreign_language")],
    "javascript": [("const x = `a ${b}", "unterminated_literal"), ("function f() { return (1; }", "unbalanced_delimiter"), ("const a: number = 1;\n", "foreign_language"), ("x = [1, 2", "premature_end"), ("const x = (<p>no end);\n", "unterminated_literal"), ("const x = (<p>a</b>);\n", "unterminated_literal"), ('{"a": {"b": 1}}\n', "foreign_language")],
    "typescript": [("const a: number = (1;\n", "premature_end"), ("class A:\n    def f(self):\n        pass\n", "foreign_language")],
    "python": [("def f(:\n  pass\n", None), ("def f(a)\n    pass\n", None), ("x = 'abc\n", None), ("if x:\n    a\n      b\n", "indentation"), ("package a;\n", None), ("print 'x'\n", None)],
}


@pytest.mark.parametrize(("lexer", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lexer, text):
    assert S.syntax_error(text, lexer) is None
    assert S.syntax_error(text.replace("\n", "\r\n"), lexer) is None


@pytest.mark.parametrize(("lexer", "text", "error"), [(k, t, e) for k, v in BAD.items() for t, e in v])
def test_invalid(lexer, text, error):
    found = S.syntax_error(text, lexer)
    assert found is not None
    assert error is None or found == error


def test_very_long_and_deep():
    assert S.syntax_error("int x;\n" * 200_000, "c") is None
    assert S.syntax_error("x = [" + "1, " * 300_000 + "]\n", "python") is None
    S.syntax_error("(" * 5000 + ")" * 5000, "python")
    assert S.syntax_error("f(" + "[" * 50_000 + "]" * 50_000 + ")", "javascript") is None


def test_tables(spark):
    schema = "csc_id string, path string, text string, error string, lexer string, bad string"
    files = spark.createDataFrame([("r", "a.py", "x = (", "e", "l", "b"), ("r", "a.py", "x = (", "e", "l", "b"), ("r", "b.PY", "x", "e", "l", "b"), ("r", "c.c", None, "e", "l", "b"), ("r", "d.txt", "(", "e", "l", "b"), (None, "e.go", "package a\nfunc(", "e", "l", "b"), ("r", None, "(", "e", "l", "b"), ("r", "x.h", "class A {};", "e", "l", "b"), ("r", "x.c", "class A {};", "e", "l", "b")], schema)
    got = {(r["csc_id"], r["path"]): r["error"] for r in S.checked_files(files).collect()}
    assert got == {("r", "a.py"): "premature_end", ("r", "b.PY"): None, (None, "e.go"): "premature_end", ("r", "x.h"): None, ("r", "x.c"): "foreign_language"}
    nodes = spark.createDataFrame([("r", "file::a.py", "a.py", " Python "), ("r", "file::b.PY", "b.PY", None)], "csc_id string, node_id string, path string, language string")
    report = {(r["csc_id"], r["language"]): (r["files"], r["unparsed"], r["rate"]) for r in S.syntax_report(files, nodes).collect()}
    assert report["r", "python"] == (2, 1, 0.5) and report["r", "cpp"] == (2, 1, 0.5)
    assert S.checked_files(files.limit(0)).count() == 0
