"""Extractors: the symbols of small sources in every language; spans nest and are exact; odd input never fails."""

import random

import pytest

from arborlex.functions.languages import default_registry
from arborlex.plans.graph import check_nesting

REGISTRY = default_registry()
CASES = {
    "python": ("import x\nMAX = 3\n@dec\nclass A(B):\n    def m(self):\n        pass\n    f = lambda x: x\ndef g(a,\n  b):\n    return 1\n", ["MAX constant", "A type", "m method", "f function", "g function"]),
    "go": ("package p\ntype (\n A struct { x int }\n B int\n)\nfunc (r *A[T]) Area() int { return 1 }\nfunc main() {\n}\nconst X = 1\nvar y = 2\n", ["p module", "A type", "B type", "Area method A", "main function", "X constant", "y variable"]),
    "javascript": ("export function f(a) { return 1 }\nclass A { constructor(x) { } get v() { return 1 } m(a) { if (a) { b() } } }\nconst g = async (x) => { y() };\nlet h = function () {};", ["f function", "A type", "constructor method", "v method", "m method", "g function", "h function"]),
    "java": ("package a;\nclass C<T> { private int x = 1; void m(int a) throws E { if (a) { } } int p, q; static final int[] K = {1}; java.util.List<String> l; }\nenum E implements I { @Deprecated A, B(1) { void z() {} }, C; int n; E() {} String k() throws X { foo(); class L {} } abstract List<T> q(int a); }", ["a module", "C type", "x variable", "m method", "p variable", "K constant", "l variable", "E type", "A constant", "B constant", "C constant", "n variable", "E method", "k method", "q method"]),
    "csharp": ("namespace A {\n public class S { public int P { get; set; } private string f; const int K = 1; public void M(int x) { foo(); } int[] a, b; S() {} ~S() {} public static S operator +(S x, S y) => x; T? G<T>(T t) where T : class { } int this[int i] { get; } int Z => 3; }\n enum E : byte { X, [D] Y = 1 << 2, Z = F(1, 2), }\n}", ["A module", "S type", "P variable", "f variable", "K constant", "M method", "a variable", "S method", "S method", "operator + method", "G method", "this variable", "Z variable", "E type", "X constant", "Y constant", "Z constant"]),
    "rust": ("pub struct A { x: u32 }\nimpl A {\n  pub fn m(&self) -> u32 { let y = 1; y }\n}\nmod t { fn f() {} }\nenum E<T> { U, #[x] V(T, u8), W { a: u8 }, X = 3 }", ["A type", "A other", "m method", "y variable", "t module", "f function", "E type", "U constant", "V constant", "W constant", "X constant"]),
    "html": ("<html><body id='b'><script>if (a<b) x()</script><form><input id=q></form></body></html>", ["b other", "script other", "form other", "q other"]),
    "sql": ("CREATE TABLE dbo.[T x] (a int);\nCREATE OR REPLACE FUNCTION f(x int) RETURNS int AS BEGIN select 1; END;\ncreate index i on t(a);", ["dbo.T x type", "f function", "i other"]),
    "shell": ("export A=1\nf() {\n echo hi\n}\nfunction g { :; }\nreadonly B=2\n", ["A variable", "f function", "g function", "B constant"]),
    "r": ("f <- function(x) { x }\nA <- R6Class('A', public = list(m = function() 1))\n", ["f function", "A type", "m method"]),
    "fsharp": ("module M\ntype T =\n  member x.Foo = 1\nlet f x = x\nlet y = 2\n", ["M module", "T type", "Foo method", "f function", "y variable"]),
    "haskell": ("module Main where\ndata T = A | B\nclass C a where\n  m :: a -> a\nf :: Int\nf = 1\n", ["Main module", "T type", "C type", "m method", "f function"]),
    "elixir": ("defmodule A do\n  def f(x) do\n    x\n  end\n  defp g, do: 1\nend\n", ["A type", "f method", "g method"]),
    "gdscript": ("class_name P\nenum E { A }\nfunc f():\n  pass\nvar x = 1\nclass I:\n  var y\n", ["P type", "E type", "f method", "x variable", "I type", "y variable"]),
    "c": ("#define X 1\nstruct S { int a; };\ntypedef int T;\nint f(int a) { if (a) { return 1; } }\nint g = 2;\nchar *p, *q;\nint r[3];\nenum E { A, B = 1, LIST(X) C };\ntypedef enum { D } F;\nenum { G };", ["X other", "S type", "T type", "f function", "g variable", "p variable", "r variable", "E type", "A constant", "B constant", "C constant", "F type", "D constant", "G constant"]),
    "cpp": ("namespace N { class A { ~A() {} int m() const { return 1; } int f; int *p, q; enum class K : int { X, Y }; A(int x) : f(x) {} bool operator==(A o); virtual void z() = 0; }; }\ntemplate <class T> std::vector<T> A::w(T a) const { return a; }", ["N module", "A type", "~A method", "m method", "f variable", "p variable", "K type", "X constant", "Y constant", "A method", "operator== method", "z method", "w method A"]),
    "scala": ("package a\nobject O {\n def f(x: Int) = x\n val v = 1\n}\ncase class C(a: Int)\ntrait T { def m: Int }", ["a module", "O module", "f function", "v variable", "C type", "T type", "m method"]),
    "typescript": ("interface I { a: string }\nabstract class K { private x: number = 1; }\ntype T<A> = A | B;\nconst enum E { A, B = 1 << 2, 'c-d' = \"x\", ['e'] }\nnamespace N { export function q(): void {} }", ["I type", "a variable", "K type", "x variable", "T type", "E type", "A constant", "B constant", "c-d constant", "e constant", "N module", "q function"]),
    "cobol": ("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. HELLO.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 REC.\n          05 A PIC X.\n       PROCEDURE DIVISION.\n       MAIN-PARA.\n           DISPLAY 'x'.\n", ["HELLO module", "IDENTIFICATION other", "DATA other", "WORKING-STORAGE other", "REC variable", "PROCEDURE other", "MAIN-PARA function"]),
    "rpg": ("**FREE\ndcl-s x int(10);\ndcl-proc foo;\n return;\nend-proc;\n", ["x variable", "foo function"]),
    "asm": ("section .text\nmain:\n mov eax, 1\nX equ 5\nmsg db 'hi'\n%macro M 1\n nop\n%endmacro\n", [".text module", "main function", "X constant", "msg variable", "M other"]),
    "aspx": ("<%@ Page Language='C#' %>\n<asp:Button id=\"b\" runat=\"server\" />\n<%= Foo(1) %>", ["Page other", "b other", "Foo other"]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_symbols(language):
    src, want = CASES[language]
    found = REGISTRY.get(language).run(src)
    got = [" ".join(x for x in (s["name"], s["kind"], s["owner"]) if x) for s in found.symbols]
    assert got == want
    check_nesting(found.symbols, [t._asdict() for t in found.tokens])
    data = src.encode()
    assert all(data[t.start : t.end].decode() == t.text for t in found.tokens)


@pytest.mark.parametrize("language", sorted(CASES))
def test_odd_input_never_fails(language):
    rng, src = random.Random(3), CASES[language][0]
    for _ in range(25):
        i, j = sorted(rng.randrange(len(src) + 1) for _ in range(2))
        cut = src[:i] + rng.choice(["", "{", "}", "(", '"', "'", "<%", "*/", "\n"]) + src[j:]
        found = REGISTRY.get(language).run(cut)
        check_nesting(found.symbols, [t._asdict() for t in found.tokens])


def test_python_errors():
    for bad in ("def f(:\n", "if x:\npass\n", "def f():\n    a\n   b\n", "x = (1\n"):
        found = REGISTRY.get("python").run(bad)
        assert found.has_errors and not found.symbols and found.tokens


def test_rust_errors():
    for bad in ("fn fn fn let = ;", "fn f() { let = 1; }", "struct ;", "let x = 1;", "fn f( {", "foo bar", "fn f()", "enum enum { A }"):
        found = REGISTRY.get("rust").run(bad)
        assert found.has_errors and not found.symbols and found.tokens
    for good in ("#![a]\n//! x\nuse a::{b, c};\npub(crate) fn f<T: Fn(u8) -> u8>(g: fn(u8)) -> T { let x = S { a: 1 }; m!(fn let =); x }", "macro_rules! m { (fn) => { struct }; }\nm!{}\nstd::m!();", "const A: [u8; 2] = { [1, 2] };", "unsafe extern \"C\" { fn f(); }\nstruct A;\nstruct B(u8);\ntype C = u8;", ""):
        assert not REGISTRY.get("rust").run(good).has_errors


def test_registry_last_wins_and_fallback():
    from arborlex.functions.extract import Extraction, Extractor

    r = default_registry()
    r.register(Extractor("Python", lambda s: Extraction(), 9))
    assert r.version("python") == 9 and r.version("zig") == 0
    assert [t.text for t in r.get("zig").run("a b").tokens] == ["a", "b"]
