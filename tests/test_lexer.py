"""The lexer: exact spans, classes, dialects; the default dialect equals its column expression."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlex.functions import columns as C
from arborlex.functions.lexer import DEFAULT, DIALECTS, tokenize

ALPHABET = "ab_1.9 \t\n\r'\"`\\/*-+#$<>=(){}[];:,!%@é√ß٣\ufeff²"


def check_tiling(src, dialect):
    data, at, line, col = src.encode("utf-8", "surrogatepass"), 0, 1, 1
    for t in tokenize(src, dialect):
        gap = data[at : t.start].decode("utf-8", "surrogatepass")
        assert all(c.isspace() or c == "\ufeff" for c in gap), (src, gap)
        assert data[t.start : t.end].decode("utf-8", "surrogatepass") == t.text and t.end > t.start
        for c in gap:
            line, col = (line + 1, 1) if c == "\n" else (line, col + (c != "\ufeff"))
        assert (t.start_line, t.start_col) == (line, col)
        for c in t.text:
            line, col = (line + 1, 1) if c == "\n" else (line, col + (c != "\ufeff"))
        assert (t.end_line, t.end_col) == (line, col)
        at = t.end
    assert all(c.isspace() or c == "\ufeff" for c in data[at:].decode("utf-8", "surrogatepass"))


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.sampled_from([DEFAULT, *DIALECTS.values()]))
def test_tokens_tile_the_text(src, dialect):
    check_tiling(src, dialect)


@pytest.mark.parametrize(
    ("dialect", "src", "want"),
    [
        ("shell", "cat <<EOF\nbody $a\nEOF\nx", [("cat", "identifier"), ("<<EOF", "operator"), ("body $a\nEOF", "literal"), ("x", "identifier")]),
        ("shell", 'echo "$(basename "$f")"', [("echo", "identifier"), ('"$(basename "$f")"', "literal")]),
        ("javascript", "x = /a[/]b/g; a / b", [("x", "identifier"), ("=", "operator"), ("/a[/]b/g", "literal"), (";", "punctuation"), ("a", "identifier"), ("/", "operator"), ("b", "identifier")]),
        ("sql", "'it''s' [my col] -- c", [("'it''s'", "literal"), ("[my col]", "identifier"), ("-- c", "comment")]),
        ("haskell", "{- a {- b -} -} f' --> x", [("{- a {- b -} -}", "comment"), ("f'", "identifier"), ("-", "operator"), ("-", "operator"), (">", "operator"), ("x", "identifier")]),
        ("rust", 'r#"a"b"# /* /* */ */ b\'x\'', [('r#"a"b"#', "literal"), ("/* /* */ */", "comment"), ("b'x'", "literal")]),
        ("python", "rb'''x''' # c", [("rb'''x'''", "literal"), ("# c", "comment")]),
        ("cobol", "       MOVE-IT 'a''b'.", [("MOVE-IT", "identifier"), ("'a''b'", "literal"), (".", "punctuation")]),
    ],
)
def test_dialects(dialect, src, want):
    assert [(t.text, t.cls) for t in tokenize(src, DIALECTS[dialect])] == want


def test_default_dialect_equals_the_column_expression(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = df.select("i", F.posexplode(C.pieces(F.col("s"))).alias("n", "p")).select("i", "n", "p", C.piece_class(F.col("p")).alias("c")).orderBy("i", "n").collect()
    got = {i: [] for i in range(len(texts))}
    for r in rows:
        if r["c"] is not None:
            got[r["i"]].append((r["p"], r["c"]))
    for i, s in enumerate(texts):
        assert got[i] == [(t.text, t.cls) for t in tokenize(s)], repr(s)
