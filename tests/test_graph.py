"""Build, grains, owners, symbol search, catalog, tree and scopes on small declared graphs."""

import random

import pytest
from pyspark.sql import functions as F

from arborlex import schema as S
from arborlex.functions.lexer import tokenize
from arborlex.functions.patterns import Pattern, parse
from arborlex.operators import catalog as K
from arborlex.operators import tree as TR
from arborlex.operators.scope import NOTHING, PermissionDenied, Principal, Rules, Scope, compile_scope, decide, lint, parse_policies, scoped
from arborlex.operators.search import Query, SymbolQuery, search, search_symbols
from arborlex.plans import graph as G
from arborlex.plans.build import graph_from_declarations

RUST = "impl S {\n    fn a() { foo(); foo(); }\n    fn b() { foo(); }\n}\n"
ZIG = "pub fn main() void { foo(); }\n"
SRC = "foo();\nstruct T { foo: u32 }\nimpl S {\n    fn a() { foo(); foo(); }\n    fn b() { foo(); }\n}\nfn free() { foo(); }\n"


def tokens(src):
    return [{"text": t.text, "class": t.cls, **{k: getattr(t, k) for k in S.SPAN}} for t in tokenize(src)]


def sym(src, name, kind, needle, lang_kind=None, owner=None):
    start = src.index(needle)
    end = start + len(needle)
    line = lambda o: (1 + src[:o].count("\n"), 1 + len(src[:o].rsplit("\n", 1)[-1]))
    (a, b), (c, d) = line(start), line(end)
    return {"name": name, "kind": kind, "lang_kind": lang_kind, "owner": owner, "start": start, "end": end, "start_line": a, "start_col": b, "end_line": c, "end_col": d}


def declared(org, repo, path, language, src, symbols=()):
    return {"org": org, "repo": repo, "path": path, "language": language, "symbols": list(symbols), "tokens": tokens(src)}


@pytest.fixture(scope="module")
def seed(spark):
    return graph_from_declarations(spark, [
        declared("o1", "r1", "lib.rs", "rust", RUST, [sym(RUST, "S", "type", RUST.rstrip()), sym(RUST, "a", "method", "fn a() { foo(); foo(); }"), sym(RUST, "b", "method", "fn b() { foo(); }")]),
        declared("o2", "r2", "main.zig", "zig", ZIG),
    ])


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_grains(seed):
    hits = search(seed, Query("foo")).collect()
    assert len(hits) == 4 and hits[0]["symbol"] == "S::a" and RUST[hits[0]["start"] : hits[0]["end"]] == "foo"
    assert rows(search(seed, Query("foo", "symbol", symbol_kind="method")), "symbol", "count", "no_symbols") == [("S::a", 2, False), ("S::b", 1, False), (None, 1, True)]
    for grain in ("file", "repo", "org"):
        assert rows(search(seed, Query("foo", grain)), "count") == [(3,), (1,)]
    assert rows(search(seed, Query("foo", "file", token_class="identifier", language="RUST")), "count") == [(3,)]
    assert rows(search(seed, Query("Foo")), "count") == []
    assert rows(search(seed, Query("foo", limit=2, offset=1)), "symbol") == [("S::a",), ("S::b",)]


def test_method_and_class_grains(spark):
    impl = "impl S {\n    fn a() { foo(); foo(); }\n    fn b() { foo(); }\n}"
    g = graph_from_declarations(spark, [declared("o", "r", "lib.rs", "rust", SRC, [sym(SRC, "T", "type", "struct T { foo: u32 }", "struct"), sym(SRC, "S", "other", impl, "impl"), sym(SRC, "a", "method", "fn a() { foo(); foo(); }", "fn"), sym(SRC, "b", "method", "fn b() { foo(); }", "fn"), sym(SRC, "free", "function", "fn free() { foo(); }", "fn")])])
    assert rows(search(g, Query("foo", "method")), "symbol", "count", "no_matching_symbol") == [(None, 2, True), ("S::a", 2, False), ("S::b", 1, False), ("free", 1, False)]
    assert rows(search(g, Query("foo", "class")), "symbol", "count", "no_matching_symbol") == [(None, 2, True), ("T", 1, False), ("S", 3, False)]
    assert rows(search(g, Query("foo", "class", symbol_kind="struct")), "symbol", "count") == [(None, 5), ("T", 1)]
    assert rows(search(g, Query("foo", "method", symbol_kind="function")), "symbol", "count") == [(None, 5), ("free", 1)]


def test_owner_hints_follow_files_of_the_directory(spark):
    src = "foo x foo"
    one = lambda path, *symbols: {"org": "o", "repo": "r", "path": path, "language": "go", "symbols": list(symbols), "tokens": tokens(src)}
    m = sym(src, "m", "method", "foo x foo", None, "T")
    g = graph_from_declarations(spark, [one("p/a.go", m), one("p/c.go", sym(src, "T", "type", "x", "iface")), one("p/b.go", sym(src, "T", "type", "x", "struct")), one("q/d.go", m)])
    got = rows(search(g, Query("foo", "class")), "file", "symbol", "count", "no_matching_symbol")
    assert ("p/b.go", "T", 2, False) in got and ("q/d.go", None, 2, True) in got
    # the first sibling by path wins, and is then no match for another kind
    got = rows(search(g, Query("foo", "class", symbol_kind="iface")), "file", "symbol", "no_matching_symbol")
    assert ("p/a.go", None, True) in got


def test_impossible_queries_are_refused():
    for bad in (("foo", "method", "type"), ("foo", "class", "method"), ("foo", "file", "type")):
        with pytest.raises(ValueError):
            Query(bad[0], bad[1], symbol_kind=bad[2])
    with pytest.raises(ValueError):
        Query("x", "word")
    with pytest.raises(ValueError):
        SymbolQuery("a", file="")


@pytest.mark.parametrize(
    ("pattern", "name", "exact", "want"),
    [("Gadget", "Gadget", 0, 1), ("gadget", "Gadget", 0, 1), ("Gad*", "Gadget", 1, 1), ("gad*", "Gadget", 1, 0), ("*", "Gadget", 0, 1), ("Get", "Gadget", 0, 0), ("*dge*", "Gadget", 0, 1), ("*GET", "Gadget", 0, 1), ("*GET", "Gadget", 1, 0), ("grö*", "Größe", 0, 1), ("GRÖ*", "Größe", 0, 0), ("name\\*", "name*", 0, 1), ("\\*na*", "*name", 0, 1), ("*a\\*b*", "xa*by", 0, 1)],
)
def test_patterns(pattern, name, exact, want):
    p = parse(pattern)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert (p.matches(name) if exact else p.folded().matches(name.translate(fold))) == bool(want)


def test_bad_patterns():
    for bad in ("", "**", "a**", "*a*b*", "*g*", "*" + "x" * 257 + "*", "*é"[:1] + "g"):
        if bad != "*g":
            with pytest.raises(ValueError):
                parse(bad)
    assert parse("*é*") == Pattern("infix", "é") and parse("\\*\\*") == Pattern("exact", "**")


def test_symbol_search_and_name_position(spark, seed):
    assert rows(search_symbols(seed, SymbolQuery("*")), "qualified") == [("S",), ("S::a",), ("S::b",)]
    hit = search_symbols(seed, SymbolQuery("A")).collect()
    assert [(h["name"], h["name_byte"], h["name_line"], h["name_col"]) for h in hit] == [("a", RUST.index("a()"), 2, 8)]
    assert rows(search_symbols(seed, SymbolQuery("*", file="./x/../lib.rs", kind="TYPE")), "name") == [("S",)]
    src = "[Shape]\nclass Shape {}\n"
    g = graph_from_declarations(spark, [declared("o", "r", "a.cs", "csharp", src, [sym(src, "Shape", "type", src.rstrip()), sym(src, "Nope", "type", "class Shape {}")])])
    assert rows(search_symbols(g, SymbolQuery("*")), "name", "name_byte") == [("Shape", 1), ("Nope", 8)]


def test_describe_equals_scan(seed):
    assert K.describe(seed).collect() == K.describe_by_scan(seed).collect()
    nested = K.describe_nested(seed, "o1").first()
    assert nested["files"] == 1 and nested["languages"]["rust"]["symbol_kinds"] == {"type": 1, "method": 2}
    with pytest.raises(ValueError, match="rust"):
        K.check_filters(seed, language="ruts")


def test_tree(seed):
    all_nodes = G.nodes(seed).cache()
    assert G.invalid_edges(all_nodes).count() == 0 and TR.cycles(all_nodes).count() == 0
    file = "file/o1/r1/lib.rs"
    assert rows(TR.roots(all_nodes), "name") == [("o1",), ("o2",)]
    assert rows(TR.children(all_nodes, file), "name") == [("S",)]
    below = rows(TR.descendants(all_nodes, file), "kind", "name")
    assert below[:6] == [("symbol", "S"), ("token", "impl"), ("token", "S"), ("token", "{"), ("symbol", "a"), ("token", "fn")] and len(below) == 3 + len(tokenize(RUST))
    assert rows(TR.ancestors(seed, "token", "o1", "r1", "lib.rs", 8), "kind", "name")[-4:] == [("symbol", "S"), ("file", "lib.rs"), ("repo", "r1"), ("org", "o1")]
    got, more = TR.page_with_more(TR.children(all_nodes, "symbol/0@o1/r1/lib.rs"), 2)
    assert len(got) == 2 and more
    inside = rows(TR.descendants(all_nodes, "symbol/1@o1/r1/lib.rs"), "name")
    assert inside[0] == ("fn",) and ("foo",) in inside and ("b",) not in inside
    all_nodes.unpersist()


def test_containment_equals_sweep(spark):
    rng = random.Random(5)
    files = []
    for n in range(25):
        marks = sorted(rng.randrange(60) for _ in range(14))
        symbols = []

        def nest(lo, hi, depth):
            if hi - lo < 2 or depth > 3:
                return
            for _ in range(rng.randrange(3)):
                a, b = sorted(rng.sample(range(lo, hi + 1), 2))
                symbols.append({"name": "s", "kind": "type", "start": a, "end": b, **dict.fromkeys(S.SPAN[2:], 1)})
                nest(a, b, depth + 1)
                lo = b
                if hi - lo < 2:
                    return

        nest(0, 60, 0)
        ends = sorted({s["end"] for s in symbols} | {s["start"] for s in symbols} | {99})
        toks = [{"text": "x", "class": "identifier", "start": m, "end": m + min(1, min(e for e in ends if e > m) - m), **dict.fromkeys(S.SPAN[2:], 1)} for m in marks]
        files.append({"org": "o", "repo": "r", "path": f"{n}", "language": "x", "symbols": symbols, "tokens": toks})
    g = graph_from_declarations(spark, files)
    joined = G.containment(g.symbols, g.tokens.select(*G.FILE_KEY, "ordinal", "start"), G.FILE_KEY, "ordinal")
    assert K.differences(joined, g.tokens.select(*G.FILE_KEY, "ordinal", "parent_sidx")).count() == 0


def test_bad_spans():
    bad = [{"start": 0, "end": 5}, {"start": 3, "end": 8}]
    with pytest.raises(G.SpanError):
        G.check_nesting(bad, [])
    with pytest.raises(G.SpanError):
        G.check_nesting([{"start": 0, "end": 5}], [{"start": 4, "end": 6}])
    with pytest.raises(G.SpanError):
        G.check_nesting([{"start": 5, "end": 4}], [])
    G.check_nesting([{"start": 3, "end": 3}, {"start": 0, "end": 5}, {"start": 0, "end": 5}], [{"start": 5, "end": 9}])


def test_scopes(seed):
    only = Scope((Rules(orgs=frozenset({"o1"})),))
    assert rows(search(scoped(seed, only), Query("foo", "org")), "org") == [("o1",)]
    assert search(scoped(seed, NOTHING), Query("foo")).count() == 0
    with pytest.raises(PermissionDenied):
        only.check_named(seed, "search", org="o2")
    only.check_named(seed, "search", org="missing")
    both = only.intersect(Scope((Rules(any=True, deny_repos=frozenset({("o1", "r1")})),)))
    assert scoped(seed, both).files.count() == 0


def test_policies():
    text = """// comment
    @id("a") permit(principal in Group::"readers", action in [Action::"read", Action::"search"], resource in Org::"acme");
    permit(principal == Token::"ci", action in [Action::"index"], resource == Repo::"acme/web");
    forbid(principal, action in [Action::"index", Action::"delete"], resource in Repo::"acme/legal");
    permit(principal == Token::"legal", action, resource in Org::"acme");"""
    p = parse_policies(text)
    bob, ci, legal = Principal("bob", frozenset({"readers"})), Principal("ci"), Principal("legal")
    want = [(bob, "read", "Repo", "acme/web", 1), (bob, "search", "Org", "acme", 1), (bob, "read", "Repo", "x/web", 0), (ci, "index", "Repo", "acme/web", 1), (ci, "read", "Repo", "acme/web", 0), (legal, "index", "Repo", "acme/legal", 0), (legal, "read", "Repo", "acme/legal", 1), (legal, "delete", "Org", "acme", 1), (legal, "index", "Cluster", "this", 0)]
    for who, action, kind, name, ok in want:
        assert decide(p, who, action, kind, name) == bool(ok), (who, action, name)
    assert compile_scope(p, bob, "read").rules[0].orgs == {"acme"} and lint(p) == []
    with pytest.raises(ValueError):
        parse_policies('permit(principal, action, resource) when { context.x };')


def test_byte_cap():
    from arborlex.plans.tools import capped

    rows = [{"i": i, "s": "x" * 10} for i in range(5)]
    assert len(capped(rows, 60)) == 2 and len(capped(rows, 1)) == 1 and len(capped(rows, 1000)) == 5 and capped([], 1) == []


def test_keys_with_slashes_and_pushed_look_ups(spark, tmp_path):
    from arborlex.sources.store import Store

    s = Store(spark, str(tmp_path / "store"))
    rows = [("a/b", "c", "d.txt", bytearray(b"x y")), ("a", "b/c", "d.txt", bytearray(b"z")), ("a", "b", "c/d.txt", bytearray(b"w"))]
    s.upsert(spark.createDataFrame(rows, "org string, repo string, path string, content binary"))
    all_nodes = G.nodes(s.graph())
    assert sorted(r["org"] for r in TR.node(all_nodes, "repo/a/b/c").collect()) == ["a", "a/b"]  # a key names both
    assert [r["name"] for r in TR.children(all_nodes, "repo/a/b").collect()] == ["c/d.txt"]
    assert [r["name"] for r in TR.descendants(all_nodes, "org/a/b").collect()] == ["c", "d.txt", "x", "y"]
    plan = TR.children(all_nodes, "file/a/b/c/d.txt")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(path" in plan and "PartitionFilters: [org" in plan


def test_containment_makes_no_product(spark):
    symbols = spark.createDataFrame([("o", "r", "p", i, i, 2000 - i) for i in range(300)], "org string, repo string, path string, sidx int, start long, end long")
    items = spark.range(1000).selectExpr("'o' org", "'r' repo", "'p' path", "int(id) ordinal", "id * 2 start")
    got = {r["ordinal"]: r["parent_sidx"] for r in G.containment(symbols, items, G.FILE_KEY, "ordinal").collect()}
    want = {i: max((s for s in range(300) if s <= 2 * i < 2000 - s), default=None) for i in range(1000)}
    assert got == want
    assert "Join" not in G.containment(symbols, items, G.FILE_KEY, "ordinal")._jdf.queryExecution().executedPlan().toString()
