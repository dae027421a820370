"""The tables of the graph.  Span fields are 64-bit: they hold unsigned 32-bit numbers."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = ("org", "repo", "file", "symbol", "token")
SYMBOL_KINDS = ("module", "type", "function", "method", "variable", "constant", "other")
TOKEN_CLASSES = ("identifier", "keyword", "literal", "operator", "punctuation", "comment", "other")
GRAINS = ("token", "symbol", "method", "class", "file", "repo", "org")
SYMBOLIC = ("symbol", "method", "class")
#: Which child kinds a node may hold.
CONTAINS = {"org": ("repo",), "repo": ("file",), "file": ("symbol", "token"), "symbol": ("symbol", "token"), "token": ()}

_SPAN = ("start", "end", "start_line", "start_col", "end_line", "end_col")


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(*fields: str | T.StructField) -> T.StructType:
    return T.StructType([f if isinstance(f, T.StructField) else T.StructField(f.split()[0], _TYPES[f.split()[1]]) for f in fields])


SPAN_FIELDS = tuple(f"{n} bigint" for n in _SPAN)
KEY = ("org string", "repo string", "path string")
#: What an extractor returns for one file.
TOKEN_DECL = _struct("text string", "class string", *SPAN_FIELDS)
SYMBOL_DECL = _struct("name string", "kind string", "lang_kind string", "owner string", *SPAN_FIELDS)
FILES = _struct(*KEY, "language string", "has_errors boolean", "origin string", "fingerprint string", "encoding string", "lossy boolean", "n_bytes bigint", "seq bigint")
#: chain: the symbol and its ancestors, innermost first.
CHAIN = "array<struct<sidx:int,name:string,kind:string,lang_kind:string,owner:string>>"
SYMBOLS = _struct(*KEY, "sidx int", "name string", "name_fold string", "kind string", "lang_kind string", "owner string", "qualified string", "parent_sidx int", "depth int", T.StructField("chain", T.ArrayType(_struct("sidx int", "name string", "kind string", "lang_kind string", "owner string"))), *SPAN_FIELDS, "first_tok int", "last_tok int", "dir string", "language string")
TOKENS = _struct(*KEY, "ordinal int", "text string", "class string", "parent_sidx int", *SPAN_FIELDS, "language string")
POSTINGS = _struct("text string", *KEY, "language string", "encoding string", "lossy boolean", "count bigint")
#: Counters by file; the catalog is their sum.
COUNTERS = _struct(*KEY, "language string", "what string", "label string", "count bigint")
CATALOG = _struct("org string", "repo string", "language string", "what string", "label string", "count bigint")
HIT = _struct("org string", "repo string", "file string", "language string", "symbol string", "symbol_kind string", "lang_kind string", "token_class string", *SPAN_FIELDS, "name_byte bigint", "name_line bigint", "name_col bigint", "count bigint", "no_symbols boolean", "no_matching_symbol boolean", "encoding string", "lossy boolean")
SYMBOL_HIT = _struct("org string", "repo string", "file string", "language string", "name string", "qualified string", "kind string", "lang_kind string", "owner string", *SPAN_FIELDS, "name_byte bigint", "name_line bigint", "name_col bigint", "encoding string", "lossy boolean")
SPAN = _SPAN
#: Packed tokens less this much for each token before them rise from one file to the next, so that a jump between files widens one
#: miniblock of deltas and not its whole block. More than the mean of a token's bytes and the space after it; part of the stored form.
STRIDE = 8
SCHEMA_VERSION = 1


def check_word(value: str | None, allowed: tuple, what: str) -> str | None:
    """The value if it is one of the allowed words (or None); else an error that lists them."""
    if value is not None and value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; one of: {', '.join(allowed)}")
    return value
