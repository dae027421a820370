"""Scalar functions as column expressions; all run inside whole-stage code generation where Spark allows it."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import OPERATORS

#: File extension to language.
EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "kts": "kotlin",
    "yml": "yaml", "sh": "shell", "bash": "shell", "zsh": "shell",
}
#: Interpreter to language.
INTERPRETERS = {"python": "python", "node": "javascript", "nodejs": "javascript", "bash": "shell", "sh": "shell", "zsh": "shell", "dash": "shell", "ksh": "shell", "mksh": "shell", "Rscript": "r", "ruby": "ruby", "perl": "perl"}
#: Extensions that extractors claim; they come before EXTENSIONS.
CLAIMED = {
    "csx": "csharp", "mts": "typescript", "cts": "typescript", "pyw": "python", "pyi": "python", "html": "html", "htm": "html", "xhtml": "html", "aspx": "aspx", "ascx": "aspx", "master": "aspx",
    "sql": "sql", "ksh": "shell", "r": "r", "rmd": "r", "qmd": "r", "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "hs": "haskell", "lhs": "haskell", "ex": "elixir", "exs": "elixir",
    "gd": "gdscript", "cxx": "cpp", "hh": "cpp", "hxx": "cpp", "ipp": "cpp", "scala": "scala", "sc": "scala", "cbl": "cobol", "cob": "cobol", "cpy": "cobol",
    "rpgle": "rpg", "sqlrpgle": "rpg", "rpgleinc": "rpg", "rpg": "rpg", "asm": "asm", "s": "asm",
}
#: The default dialect: pieces that tile the text, white space included.
_A = r"[\p{IsAlphabetic}\p{N}_]"
PIECE = (
    r"(?sU)//[^\n]*+|/\*.*?(?:\*/|\z)|[\p{IsAlphabetic}_]" + _A + r"*+|[0-9](?:[\p{IsAlphabetic}\p{N}_.]*" + _A + r")?"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|`[^`\\]*+(?:\\.[^`\\]*+)*+(?:`|\\?\z)'
    r"|'(?=\\.{0,9}'|[^'\\\n]')[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)|[\s\x{FEFF}]++|."
)
WORD = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{N}_]*"


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def piece_class(p: Column) -> Column:
    """The class of a piece of the default dialect; null for white space."""
    first = F.substring(p, 1, 1)
    return (
        F.when(p.rlike(r"\A(?U:[\s\x{FEFF}])"), F.lit(None))
        .when(p.rlike(r"\A/[/*]"), "comment")
        .when(first.rlike(r"[\p{IsAlphabetic}_]"), "identifier")
        .when(first.isin('"', "`") | first.rlike("[0-9]") | ((first == "'") & (F.length(p) > 1)), "literal")
        .when(first.isin(*OPERATORS), "operator")
        .otherwise("punctuation")
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    """The lower-cased part after the last dot of the name; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def detect_language(path: Column, claimed: dict[str, str] | None = None) -> Column:
    ext = extension(path)
    return F.coalesce(_lookup((CLAIMED if claimed is None else claimed) | {"": "unknown"}, ext), _lookup(EXTENSIONS, ext), ext)


def detect_language_from_content(path: Column, text: Column, claimed: dict[str, str] | None = None) -> Column:
    """By path; then by the names of make and Docker files; then by the interpreter line."""
    by_path, name = detect_language(path, claimed), F.lower(file_name(path))
    line = F.substring_index(F.regexp_replace(text, r"\A\x{FEFF}+", ""), "\n", 1)
    words_ = F.split(F.trim(F.regexp_replace(line, r"^#!", "")), r"\s+")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    first = base(F.element_at(words_, 1))
    rest = F.filter(F.slice(words_, 2, 10_000), lambda w: ~w.startswith("-"))
    program = F.regexp_replace(F.when(first == "env", F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(""))).otherwise(first), r"[0-9.]+$", "")
    by_line = F.when(line.startswith("#!"), F.coalesce(_lookup(INTERPRETERS, program), F.nullif(F.lower(program), F.lit(""))))
    return F.when(name.isin("makefile", "gnumakefile"), "make").when(name == "dockerfile", "dockerfile").when(by_path != "unknown", by_path).otherwise(F.coalesce(by_line, by_path))


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes; empty and ``.`` components go; ``..`` takes its parent with it.

    A leading ``..`` stays on a relative path and goes at the root of an absolute one.
    """
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = plain.startswith("/")
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))

    def step(kept: Column, part: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        can_pop = top.isNotNull() & (top != "..")
        up = F.when(can_pop, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(absolute, kept).otherwise(F.concat(kept, F.array(F.lit(".."))))
        return F.when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def fingerprint(content: Column, language: Column, version: Column, encoding: Column | None = None, lossy: Column | None = None) -> Column:
    """``sha256:<hex>|language|extractor version|1`` and ``|enc=NAME[+lossy]@1`` unless a clean UTF-8 decode."""
    base = F.concat_ws("|", F.concat(F.lit("sha256:"), F.sha2(content, 256)), F.lower(language), version.cast("string"), F.lit("1"))
    if encoding is None:
        return base
    lossy = F.lit(False) if lossy is None else lossy
    return F.when((encoding == "UTF-8") & ~lossy, base).otherwise(F.concat(base, F.lit("|enc="), encoding, F.when(lossy, "+lossy").otherwise(""), F.lit("@1")))


def fingerprint_version(fp: Column) -> Column:
    """The extractor version in a fingerprint."""
    return F.nullif(F.regexp_extract(fp, r"^sha256:[0-9a-f]+\|[^|]*\|([0-9]+)\|", 1), F.lit("")).cast("int")


def kind_label(kind: Column, lang_kind: Column) -> Column:
    return F.when(lang_kind.isNull() | (lang_kind == kind), kind).otherwise(F.concat_ws("/", kind, lang_kind))


def kind_matches(kind: Column, lang_kind: Column, wanted: str) -> Column:
    want = wanted.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(ascii_fold(kind) == want, F.lit(False)) | F.coalesce(ascii_fold(lang_kind) == want, F.lit(False))


def grain_accepts(grain: str, kind: Column, lang_kind: Column) -> Column:
    if grain == "symbol":
        return F.lit(True)
    if grain == "method":
        return kind.isin("method", "function")
    return (kind == "type") | F.coalesce(lang_kind == "impl", F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
