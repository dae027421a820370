"""The languages: declaration tables for the shared scanner, and extractors of their own where a table won't do.

What the tables leave out, on purpose: local declarations inside function
bodies of brace languages unless the language lists them, all but the first
declarator of a statement (it names the symbol), and code that preprocessors
hide.  Odd input never fails; only python and rust report syntax errors.
"""

from __future__ import annotations

from dataclasses import replace

import regex

from .extract import Decl, Extraction, Extractor, Language, Registry, Scanner, _nested_only, balanced, close_table, extractor, fallback, relabel, span, symbol
from .lexer import DIALECTS, Token, tokenize

_w = lambda s: frozenset(s.split())
#: Reserved words of each language, which become keyword tokens.
KEYWORDS = {
    "rust": _w("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"),
    "csharp": _w("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"),
    "javascript": _w("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static await async"),
    "java": _w("_ abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while"),
    "python": _w("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"),
    "go": _w("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
    "shell": _w("case do done elif else esac fi for function if in select then time until while"),
    "sql": _w("add all alter and any as asc begin between by case cast check column commit constraint create cross declare default delete desc distinct drop else end except exec execute exists foreign from full function grant group having if in index inner insert intersect into is join key left like limit not null on or order outer package primary procedure references return returns revoke right rollback schema select sequence set table then to trigger type union unique update values view when where while with"),
    "r": _w("if else repeat while function for next break TRUE FALSE NULL Inf NaN NA in"),
    "fsharp": _w("abstract and as assert base begin class default delegate do done downcast downto elif else end exception extern false finally fixed for fun function global if in inherit inline interface internal lazy let match member module mutable namespace new null of open or override private public rec return static struct then to true try type upcast use val void when while with yield"),
    "haskell": _w("case class data default deriving do else foreign if import in infix infixl infixr instance let module newtype of then type where _"),
    "elixir": _w("after and catch do else end false fn in nil not or rescue true when"),
    "gdscript": _w("if elif else for while match break continue pass return class class_name extends is in as self signal func static const enum var breakpoint preload await yield assert void and or not true false null super"),
    "c": _w("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"),
    "cpp": _w("alignas alignof and asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile while"),
    "scala": _w("abstract case catch class def do else enum extends false final finally for given if implicit import lazy match new null object override package private protected return sealed super then this throw trait true try type val var while with yield"),
    "cobol": _w("accept add call close compute data delete display divide division else end end-if end-perform environment evaluate exit file go goback identification if input-output into linkage local-storage move multiply of open perform pic picture procedure program-id read rewrite section stop string subtract to unstring until using value varying when working-storage write"),
    "rpg": _w("dcl-c dcl-ds dcl-f dcl-pi dcl-pr dcl-proc dcl-s end-ds end-pi end-pr end-proc begsr endsr if elseif else endif dow dou enddo for endfor select when other endsl return monitor on-error endmon exsr eval callp"),
    "asm": _w("byte dword qword word ptr offset section segment global extern proc endp macro endm"),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]
_TYPES = ("type",)
_OUTER = (None, "module")
_ACCESS = _w("public private protected internal static final abstract sealed virtual override async export default declare readonly unsafe extern partial inline native synchronized transient volatile strictfp new pub const implicit lazy open case")
_FLOW = _w("if for while switch catch return else do try using lock foreach fixed synchronized match when with function constructor sizeof typeof await throw new case")


def _types(words: str, tail: str = "", **how) -> tuple[Decl, ...]:
    return tuple(Decl(f"{w} NAME{tail}", "type", w, **how) for w in words.split())


LANGUAGES = (
    Language("csharp", (
        Decl("namespace NAME * {|;", "module", "namespace"), *_types("class struct interface record enum"), Decl("delegate * (...)", "type", "delegate", "statement"),
        Decl("event * NAME ;|{", "variable", "event", "statement", _TYPES), Decl("const TYPE NAME", "constant", "const", "statement", _TYPES),
        Decl("TYPE <...> [...]? ?? this [...] {", "variable", "indexer", "group", _TYPES), Decl("TYPE <...> [...]? ?? NAME {", "variable", "property", "group", _TYPES), Decl("TYPE <...> [...]? ?? NAME = >", "variable", "property", "statement", _TYPES), Decl("TYPE <...> [...]? ?? NAME ;|=|,", "variable", "field", "statement", _TYPES),
    ), KEYWORDS["csharp"], ("cs", "csx"), DIALECTS["csharp"], modifiers=_ACCESS, call_is_function=True, not_names=_FLOW, typed=True, tilde="finalizer", member="enum_member"),
    Language("javascript", (
        Decl("function *? NAME (...)", "function", "function"), Decl("class NAME", "type", "class"),
        Decl("const|let|var NAME = async? function", "function", "fn_expr", "statement"), Decl("const|let|var NAME = async? (...) = >", "function", "arrow_fn", "statement"), Decl("const|let|var NAME = async? TYPE = >", "function", "arrow_fn", "statement"),
        Decl("get NAME (...) {", "method", "get", "group", _TYPES), Decl("set NAME (...) {", "method", "set", "group", _TYPES), Decl("constructor (...)", "method", "constructor", "brace", _TYPES),
    ), KEYWORDS["javascript"], ("js", "mjs", "cjs", "jsx"), DIALECTS["javascript"], modifiers=_w("export default async static"), call_is_function=True, not_names=_FLOW),
    Language("java", (
        Decl("package NAME", "module", "package", "file"), Decl("@ interface NAME", "type", "annotation"), *_types("class interface enum record"),
        Decl("static final TYPE <...> [...]? NAME =|;|,", "constant", "constant", "statement", _TYPES), Decl("TYPE <...> [...]? NAME ;|=|,|[", "variable", "field", "statement", _TYPES),
    ), KEYWORDS["java"], ("java",), DIALECTS["java"], modifiers=_ACCESS, call_is_function=True, not_names=_FLOW, typed=True, member="enum_constant", members_stop=";"),
    Language("shell", (
        Decl("function NAME", "function", "function"), Decl("NAME ( ) {", "function", "function"), Decl("export NAME", "variable", "export", "line"), Decl("readonly NAME", "constant", "readonly", "line"),
        Decl("declare|typeset - x NAME", "variable", "declare", "line"), Decl("declare|typeset - r NAME", "constant", "declare", "line"),
    ), KEYWORDS["shell"], ("sh", "bash", "zsh", "ksh"), DIALECTS["shell"], starts="line"),
    Language("r", (
        Decl("NAME < - function", "function", "function", "line"), Decl("NAME < < - function", "function", "function", "line"), Decl("NAME = function", "function", "function", "line"), Decl("NAME < - \\ (...)", "function", "function", "line"),
    ), KEYWORDS["r"], ("r", "rmd", "qmd"), DIALECTS["r"], starts="anywhere"),
    Language("fsharp", (
        Decl("namespace NAME", "module", "namespace", "file"), Decl("module NAME =", "module", "module", "indent"), Decl("module NAME", "module", "module", "file"), Decl("type NAME", "type", "type", "indent"), Decl("exception NAME", "type", "exception", "indent"),
        Decl("static? member val NAME", "variable", "member val", "indent"), Decl("static member NAME", "method", "static member", "indent"), Decl("member TYPE . NAME", "method", "member", "indent"), Decl("member NAME", "method", "member", "indent"), Decl("override TYPE . NAME", "method", "override", "indent"), Decl("default TYPE . NAME", "method", "default", "indent"), Decl("abstract NAME", "method", "abstract", "indent"),
        Decl("val mutable? NAME", "variable", "val", "indent"), Decl("let rec? inline? NAME =|:", "variable", "let", "indent"), Decl("let mutable NAME", "variable", "let", "indent"), Decl("let rec? inline? NAME", "function", "let", "indent", method=True),
    ), KEYWORDS["fsharp"] - _w("val new"), ("fs", "fsi", "fsx"), DIALECTS["fsharp"], starts="line", modifiers=_w("private public internal")),
    Language("elixir", (
        Decl("defmodule NAME", "type", "defmodule", "block"), Decl("defprotocol NAME", "type", "defprotocol", "block"), Decl("defimpl NAME", "type", "defimpl", "block"), Decl("defstruct", "type", "defstruct", "line"), Decl("defexception", "type", "defexception", "line"),
        *(Decl(f"{w} NAME", "function", w, "block", method=True) for w in ("def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate")),
    ), KEYWORDS["elixir"], ("ex", "exs"), DIALECTS["elixir"], starts="line", block=(_w("do fn"), _w("end"))),
    Language("gdscript", (
        Decl("class_name NAME", "type", "class_name", "file"), Decl("class NAME", "type", "class", "indent"), Decl("enum NAME {", "type", "enum", "line"), Decl("static func NAME", "method", "static func", "indent"), Decl("func NAME", "method", "func", "indent"),
        Decl("signal NAME", "other", "signal", "line"), Decl("const NAME", "constant", "const", "line"), Decl("static? var NAME", "variable", "var", "line"),
    ), KEYWORDS["gdscript"], ("gd",), DIALECTS["gdscript"], starts="line"),
    Language("c", (
        Decl("# define NAME", "other", "macro", "line"), *(Decl(f"typedef * {w} NAME {{", "type", w, "statement") for w in ("struct", "union", "enum")), *(Decl(f"{w} NAME {{", "type", w, "statement") for w in ("struct", "union", "enum")),
        Decl("typedef struct|union|enum {...} NAME ;", "type", "typedef", "statement"), Decl("typedef TYPE PTR? PTR? NAME ;", "type", "typedef", "statement", _OUTER), Decl("const|constexpr TYPE PTR? PTR? NAME =|[", "constant", "const", "statement", _OUTER), Decl("TYPE PTR? PTR? NAME =|;|,|[", "variable", "variable", "statement", _OUTER),
    ), KEYWORDS["c"], ("c", "h"), DIALECTS["c"], modifiers=_w("static inline extern unsigned signed const"), call_is_function=True, not_names=_FLOW, typed=True, tilde="destructor", member="enumerator"),
    Language("scala", (
        Decl("package NAME * {", "module", "package"), Decl("package NAME", "module", "package", "file"), Decl("case object NAME", "module", "case object"), Decl("object NAME", "module", "object"), Decl("case class NAME", "type", "case class"), *_types("class trait enum"),
        Decl("type NAME", "type", "type", "line"), Decl("given NAME", "type", "given", "line"), Decl("def NAME", "function", "def", "line", method=True), Decl("val NAME", "variable", "val", "line"), Decl("var NAME", "variable", "var", "line"), Decl("case NAME", "constant", "case", "token", _TYPES),
    ), KEYWORDS["scala"], ("scala", "sc"), DIALECTS["scala"], starts="line", modifiers=_ACCESS | _w("implicit lazy override sealed")),
    Language("rpg", (
        Decl("dcl-proc NAME", "function", "procedure", "block"), Decl("begsr NAME", "function", "subroutine", "block"), Decl("dcl-pr NAME", "other", "prototype", "block"), Decl("dcl-pi NAME", "other", "interface", "block"), Decl("dcl-ds NAME", "type", "ds", "block"),
        Decl("dcl-s NAME", "variable", "standalone", "statement"), Decl("dcl-c NAME", "constant", "constant", "statement"),
    ), KEYWORDS["rpg"], ("rpgle", "sqlrpgle", "rpgleinc", "rpg"), DIALECTS["rpg"], ignore_case=True, block=(_w("dcl-proc begsr dcl-pr dcl-pi dcl-ds"), _w("end-proc endsr end-pr end-pi end-ds"))),
)
_BY_NAME = {x.name: x for x in LANGUAGES}
_TS = replace(
    _BY_NAME["javascript"], name="typescript", extensions=("ts", "tsx", "mts", "cts"), modifiers=_w("export default async static declare public private protected readonly override const"),
    decls=(Decl("abstract class NAME", "type", "abstract_class"), *_BY_NAME["javascript"].decls, Decl("interface NAME", "type", "interface"), Decl("type NAME <...> =", "type", "type", "statement"), Decl("enum NAME {", "type", "enum"), Decl("namespace NAME * {", "module", "namespace"), Decl("module NAME|TEXT {", "module", "module"), Decl("NAME (...) :|;", "method", "method", "statement", _TYPES), Decl("NAME ?? : TYPE", "variable", "field", "item", _TYPES)),
    member="enum_member", member_ends=(",", ";"),
)
_CPP = replace(
    _BY_NAME["c"], name="cpp", extensions=("cpp", "cc", "cxx", "hpp", "hh", "hxx", "ipp"), keywords=KEYWORDS["cpp"],
    decls=(Decl("namespace NAME", "module", "namespace"), Decl("class NAME", "type", "class"), Decl("enum class|struct NAME", "type", "enum"), Decl("using NAME =", "type", "using", "statement"), Decl("TYPE <...> PTR? PTR? NAME ;|=|{|,|[", "variable", "field", "statement", _TYPES), *_BY_NAME["c"].decls),
)


# -- python --------------------------------------------------------------------------------------


def _logical_lines(code: list[Token]) -> list[tuple[int, int]] | None:
    """(first, last) token of each logical line; None if brackets don't balance."""
    if not balanced(code):
        return None
    out, depth, first = [], 0, 0
    for i, t in enumerate(code):
        if i > first and depth == 0 and t.start_line > code[i - 1].end_line and code[i - 1].text != "\\":
            out.append((first, i - 1))
            first = i
        if t.cls not in ("literal",):
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
    return [*out, (first, len(code) - 1)] if code else []


def _indent_ok(code: list[Token], lines: list[tuple[int, int]]) -> bool:
    levels, header = [1], False
    for a, b in lines:
        col = code[a].start_col
        if header:
            if col <= levels[-1]:
                return False
            levels.append(col)
        else:
            while levels and levels[-1] > col:
                levels.pop()
            if not levels or levels[-1] != col:
                return False
        header = code[b].text == ":"
    return not header


def python(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["python"])
    labelled = relabel(tokens, KEYWORDS["python"])
    code = [t for t in tokens if t.cls != "comment"]
    lines = _logical_lines(code)
    if lines is None or not _indent_ok(code, lines):
        return Extraction([], labelled, True)
    out, open_ = [], []  # open_: (column, is a class)
    decorated = None
    for n, (a, b) in enumerate(lines):
        col = code[a].start_col
        while open_ and open_[-1][0] >= col:
            open_.pop()
        if code[a].text == "@":
            decorated = a if decorated is None else decorated
            continue
        at = a + (code[a].text == "async" and a < b)
        word = code[at].text
        if word in ("def", "class") and at < b:
            last = b
            for c, d in lines[n + 1 :]:
                if code[c].start_col <= col:
                    break
                last = d
            method = word == "def" and bool(open_) and open_[-1][1]
            kind = "type" if word == "class" else "method" if method else "function"
            lang = "class" if word == "class" else "method" if method else "function"
            out.append(symbol(code[at + 1].text, kind, lang, code[a if decorated is None else decorated], code[last]))
            open_.append((col, word == "class"))
        elif at + 1 < b and code[a].cls == "identifier":
            eq = next((k for k in range(a + 1, b) if code[k].text == "="), None)
            if eq == a + 1 and code[eq + 1].text == "lambda":
                out.append(symbol(code[a].text, "function", "lambda", code[a], code[b]))
            elif eq is not None and (eq == a + 1 or code[a + 1].text == ":") and code[eq + 1].text != "=" and col == 1 and regex.fullmatch(r"[A-Z_][A-Z0-9_]*", code[a].text) and regex.search("[A-Z]", code[a].text):
                out.append(symbol(code[a].text, "constant", "constant", code[a], code[b]))
        decorated = None
    return Extraction(out, labelled)


# -- markup ---------------------------------------------------------------------------------------

#: Elements without content, and elements whose content is raw text.
VOID = _w("area base br col embed hr img input link meta source track wbr param keygen")
RAW_TEXT = _w("script style textarea title")
ALWAYS = _w("script style form template")


def _tags(tokens: list[Token]):
    """(first, last, name, attributes, closes, self-closed) of each complete tag."""
    i = 0
    while i < len(tokens):
        if tokens[i].text != "<" or tokens[i].cls == "literal" or i + 1 >= len(tokens) or tokens[i + 1].start != tokens[i].end:
            i += 1
            continue
        closes = tokens[i + 1].text == "/"
        at = i + 1 + closes
        if at >= len(tokens) or tokens[at].cls != "identifier" or tokens[at].start != tokens[at - 1].end:
            i += 1
            continue
        j, attributes = at + 1, {}
        while j < len(tokens) and tokens[j].text not in ("<", ">"):
            if tokens[j].cls == "identifier" and j + 2 < len(tokens) and tokens[j + 1].text == "=" and tokens[j + 2].cls in ("literal", "identifier"):
                attributes.setdefault(tokens[j].text.lower(), tokens[j + 2].text.strip("\"'"))
            j += 1
        if j < len(tokens) and tokens[j].text == ">":
            yield i, j, tokens[at].text, attributes, closes, tokens[j - 1].text == "/"
            i = j
        i += 1


def elements(tokens: list[Token], classify) -> list[dict]:
    """A symbol for each start tag that ``classify`` names, reaching to its close tag."""
    out, stack = [], []  # stack: (lower name, index of its symbol or None)
    raw = None
    for first, last, name, attributes, closes, self_closed in _tags(tokens):
        low = name.lower()
        if raw and not (closes and low == raw):
            continue
        raw = None
        if closes:
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == low), None)
            if where is not None:
                at = stack[where][1]
                del stack[where:]
                if at is not None:
                    out[at] |= span(tokens[out[at]["_first"]], tokens[last])
            continue
        found = classify(name, attributes)
        if found:
            out.append(symbol(found[0], "other", found[1], tokens[first], tokens[last]) | {"_first": first})
        if not self_closed and low not in VOID:
            stack.append((low, len(out) - 1 if found else None))
            later = (t for t in range(last + 1, len(tokens) - 2) if tokens[t].text == "<" and tokens[t + 1].text == "/" and tokens[t + 2].text.lower() == low)
            if low in RAW_TEXT and next(later, None) is not None:
                raw = low
    for s in out:
        del s["_first"]
    return out


def _element(name: str, attributes: dict):
    low, own = name.lower(), attributes.get("id")
    if low in ALWAYS:
        return own or name, low
    return (own, "element") if own else None


def html(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["html"])
    return Extraction(elements(tokens, _element), tokens)


#: Server blocks of ASP.NET pages.
_BLOCKS = {"<%@": "directive", "<%": "code_block", "<%=": "expression", "<%:": "expression", "<%#": "binding", "<%$": "expression_builder"}


def aspx(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["aspx"])
    blocks, plain, i = [], [], 0
    while i < len(tokens):
        kind = _BLOCKS.get(tokens[i].text)
        end = next((j for j in range(i + 1, len(tokens)) if tokens[j].text == "%>"), None) if kind else None
        if end is None:
            plain.append(tokens[i])
            i += 1
            continue
        name = next((t.text for t in tokens[i + 1 : end] if t.cls == "identifier"), kind)
        blocks.append(symbol(name, "other", kind, tokens[i], tokens[end]))
        i = end + 1

    def control(name: str, attributes: dict):
        if ":" in name or attributes.get("runat", "").lower() == "server" and name.lower() not in ALWAYS:
            return attributes.get("id") or name, "control"
        return _element(name, attributes)

    found = sorted([*blocks, *elements(plain, control)], key=lambda s: (s["start"], -s["end"]))
    place = {t.start: n for n, t in enumerate(tokens)}
    ends = {t.end: n for n, t in enumerate(tokens)}
    server = []
    for m in regex.finditer(r"<script[^>]*runat\s*=\s*[\"']server[\"'][^>]*>(.*?)</script>", src, regex.S | regex.I):
        lead = len(src[: m.start(1)].encode())
        stop = lead + len(m[1].encode())
        own = [t for t in tokens if lead <= t.start < stop]
        line, col = (own[0].start_line, own[0].start_col) if own else (1, 1)
        shift = "\n" * (line - 1) + " " * (col - 1) + m[1].lstrip()
        part = Scanner(_BY_NAME["csharp"])(shift)
        gap = (own[0].start if own else lead) - len(("\n" * (line - 1) + " " * (col - 1)).encode())
        server += [s | {"start": s["start"] + gap, "end": s["end"] + gap} for s in part.symbols]
    both = [(place.get(s["start"], s["start"]), ends.get(s["end"], s["end"]), s) for s in [*found, *[s for s in server if s["start"] in place and s["end"] in ends]]]
    return Extraction(_nested_only(both), relabel(tokens, frozenset()))


# -- go -------------------------------------------------------------------------------------------


def go(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["go"])
    code = [t for t in tokens if t.cls != "comment"]
    close, out, n, i = close_table(code), [], len(code), 0

    def statement_end(j: int) -> int:
        """The last token before the line break that ends a statement."""
        while j < n:
            j = close.get(j, j)
            if j + 1 >= n or code[j + 1].text in (";", ")") or code[j + 1].start_line > code[j].end_line and (code[j].cls in ("identifier", "literal") or code[j].text in (")", "]", "}", "+", "-")):
                return j
            j += 1
        return n - 1

    def spec(word: str, first: int, at: int) -> int:
        last = statement_end(at)
        kind, lang = {"const": ("constant", "const"), "var": ("variable", "var")}.get(word, ("type", "type"))
        if word == "type":
            k = at + 1
            if k in close and code[k].text == "[" and k + 1 < close[k]:
                k = close[k] + 1
            if k < n and code[k].text in ("struct", "interface"):
                lang = code[k].text
        out.append(symbol(code[at].text, kind, lang, code[first], code[last]))
        return last

    while i < n:
        word = code[i].text if code[i].cls == "identifier" else ""
        if word == "package" and i + 1 < n:
            out.append(symbol(code[i + 1].text, "module", "package", code[i], code[-1]))
            i += 1
        elif word == "func" and i + 1 < n:
            at, owner = i + 1, None
            if at in close and code[at].text == "(":
                inner, k = [], at + 1
                while k < close[at]:
                    if code[k].text == "[" and k in close:
                        k = close[k]
                    elif code[k].cls == "identifier":
                        inner.append(code[k].text)
                    k += 1
                owner, at = (inner[-1] if inner else None), close[at] + 1
            if at < n and code[at].cls == "identifier":
                last = statement_end(at)
                out.append(symbol(code[at].text, "method" if owner else "function", "method" if owner else "func", code[i], code[last], owner))
                i = last
        elif word in ("type", "const", "var") and i + 1 < n:
            if code[i + 1].text == "(" and i + 1 in close:
                j, stop = i + 2, close[i + 1]
                while j < stop:
                    if code[j].cls == "identifier":
                        j = spec(word, j, j)
                    j += 1
                i = stop
            elif code[i + 1].cls == "identifier":
                i = spec(word, i, i + 1)
        elif i in close:
            i = close[i]
        i += 1
    return Extraction(out, relabel(tokens, KEYWORDS["go"]))


# -- rust -----------------------------------------------------------------------------------------

_RUST = Language("rust", (
    *_types("struct enum union trait"), Decl("type NAME", "type", "type_alias", "statement"), Decl("impl <...> * for NAME", "other", "impl"), Decl("impl <...> NAME", "other", "impl"), Decl("mod NAME", "module", "mod"),
    Decl("fn NAME", "function", "fn", method=True), Decl("const NAME :", "constant", "const", "statement"), Decl("static mut? NAME :", "variable", "static", "statement"), Decl("let mut? NAME", "variable", "let", "statement"),
), KEYWORDS["rust"], ("rs",), DIALECTS["rust"], modifiers=_w("pub unsafe async const extern"), member="variant")


#: Words that start an item, and words that a name follows.
_ITEM = _w("async const enum extern fn impl mod pub static struct trait type union unsafe use macro_rules macro auto default")
_NAMED = _w("struct enum trait mod union")
_AFTER_FN = regex.compile(r"[\p{Alphabetic}_][\p{Alphabetic}\p{N}_]*+|\(")


def _macro_bodies(code: list[Token], close: dict[int, int]) -> set[int]:
    """Tokens inside the arguments of macros, where anything goes."""
    out: set[int] = set()
    for i, t in enumerate(code):
        if t.text == "!" and i and code[i - 1].cls == "identifier" and i not in out:
            at = i + 1 + (i + 1 < len(code) and code[i + 1].cls == "identifier")
            if at in close:
                out.update(range(at, close[at] + 1))
    return out


def _rust_ok(code: list[Token]) -> bool:
    """Whether brackets balance, declaring words are followed by what they declare, and only items stand at the top."""
    if not balanced(code):
        return False
    close, keywords, n = close_table(code), KEYWORDS["rust"] - _w("self Self super crate"), len(code)
    free = _macro_bodies(code, close)
    text = lambda i: code[i].text if i < n else ""
    for i, t in enumerate(code):
        if i in free or t.cls != "identifier":
            continue
        after = text(i + 1)
        if t.text == "fn" and (after in keywords or not _AFTER_FN.fullmatch(after)):
            return False
        if t.text in _NAMED and t.text != "union" and (after in keywords or not (i + 1 < n and code[i + 1].cls == "identifier")):
            return False
        if t.text == "let" and (not after or after in "=;:)]},."):
            return False
    i = 0
    while i < n:
        if code[i].text == "#":
            i += 1 + (text(i + 1) == "!")
            if i not in close:
                return False
            i = close[i] + 1
            continue
        word = code[i].text
        macro = code[i].cls == "identifier" and (text(i + 1) == "!" or text(i + 1) == ":" and text(i + 2) == ":")
        if word not in _ITEM and not macro or code[i].cls == "literal":
            return False
        braces = False
        while i < n and code[i].text != ";":
            braces = code[i].text == "{" and code[i].cls != "literal"
            i = close.get(i, i) + 1
            if braces and text(i) not in (";", "=", ".", "?", "+", "-", "*", "/", "as") and word not in ("use", "const", "static", "type"):
                break
        if i < n and code[i].text == ";":
            i += 1
        elif not braces:
            return False
    return True


def rust(src: str) -> Extraction:
    """A scanner, not a parser: it reports the syntax errors that :func:`_rust_ok` sees."""
    tokens = tokenize(src, DIALECTS["rust"])
    if not _rust_ok([t for t in tokens if t.cls != "comment"]):
        return Extraction([], relabel(tokens, KEYWORDS["rust"]), True)
    return Scanner(_RUST)(src)


# -- sql ------------------------------------------------------------------------------------------

#: What CREATE makes, and words between CREATE and that.
_MADE = {"table": ("type", "table"), "view": ("type", "view"), "type": ("type", "type"), "procedure": ("function", "procedure"), "proc": ("function", "procedure"), "function": ("function", "function"), "trigger": ("other", "trigger"), "index": ("other", "index"), "sequence": ("other", "sequence"), "schema": ("module", "schema"), "package": ("module", "package")}
_BETWEEN = _w("or replace alter temp temporary global local unlogged unique clustered nonclustered materialized definer = editionable noneditionable force no concurrently external constraint if not exists recursive")


def sql(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["sql"])
    code = [t for t in tokens if t.cls != "comment"]
    close, out, n = close_table(code), [], len(code)
    low = [t.text.lower() for t in code]
    starts = []
    for i in range(n):
        if low[i] != "create" or code[i].cls != "identifier":
            continue
        j = i + 1
        while j < n and low[j] in _BETWEEN:
            j += 1
        if j < n and low[j] in _MADE:
            starts.append((i, j))
    for k, (i, j) in enumerate(starts):
        kind, lang = _MADE[low[j]]
        at = j + 1
        if lang in ("type", "package") and at < n and low[at] == "body":
            lang, at = f"{lang} body", at + 1
        while at < n and low[at] in _BETWEEN:
            at += 1
        if at >= n or code[at].cls not in ("identifier",):
            continue
        parts, p = [Scanner._clean(code[at].text)], at
        while p + 2 < n and code[p + 1].text == "." and code[p + 2].cls == "identifier":
            parts.append(Scanner._clean(code[p + 2].text))
            p += 2
        limit = starts[k + 1][0] if k + 1 < len(starts) else n
        depth, end, q = 0, limit - 1, p + 1
        while q < limit:
            word = low[q]
            if word in ("begin", "case"):
                depth += 1
            elif word == "end" and depth:
                depth -= 1
            elif depth == 0 and (word == ";" or word == "go" and code[q].start_line > code[q - 1].end_line):
                end = q if word == ";" else q - 1
                break
            q = close.get(q, q) + 1
        out.append((i, max(end, p), symbol(".".join(parts), kind, lang, code[i], code[max(end, p)])))
    return Extraction(_nested_only(out), relabel(tokens, KEYWORDS["sql"], True))


# -- line-shaped languages ----------------------------------------------------------------------


def _by_line(tokens: list[Token]) -> list[tuple[int, int]]:
    out, first = [], 0
    for i in range(1, len(tokens) + 1):
        if i == len(tokens) or tokens[i].start_line > tokens[i - 1].end_line:
            out.append((first, i - 1))
            first = i
    return out if tokens else []


def haskell(src: str) -> Extraction:
    """Top-level layout: a declaration starts in column 1 and reaches to the next one; equations of a name are grouped."""
    bird = regex.search(r"(?m)^> ", src) is not None
    plain = regex.sub(r"(?m)^(?!> ).*$", lambda m: " " * len(m[0]), src).replace("\n> ", "\n  ") if bird else src
    tokens = tokenize(plain, DIALECTS["haskell"])
    code = [t for t in tokens if t.cls != "comment"]
    low = min((t.start_col for t in code), default=1)
    heads = [a for a, _ in _by_line(code) if code[a].start_col == low]
    out, module = [], None
    for k, a in enumerate(heads):
        last = (heads[k + 1] if k + 1 < len(heads) else len(code)) - 1
        word = code[a].text
        nxt = code[a + 1].text if a < last else ""
        if word == "module":
            module = symbol(nxt, "module", "module", code[a], code[-1])
        elif word in ("data", "newtype", "type", "class", "instance"):
            lang, at = (f"{word} {nxt}", a + 2) if nxt in ("family", "instance") else (word, a + 1)
            names = [t for t in code[at : last + 1] if t.cls == "identifier" and t.text[:1].isupper()]
            arrow = next((n for n in range(at, last) if code[n].text == "=" and code[n + 1].text == ">"), None)
            if arrow is not None:
                names = [t for t in code[arrow : last + 1] if t.cls == "identifier" and t.text[:1].isupper()] or names
            if names:
                out.append(symbol(names[0].text, "type", lang, code[a], code[last]))
                if word in ("class", "instance"):
                    seen = set()
                    for c, d in _by_line(code[a : last + 1])[1:]:
                        t = code[a + c]
                        if t.cls == "identifier" and t.text not in seen and t.text not in KEYWORDS["haskell"] and d > c and code[a + c + 1].text in (":", "=") or t.cls == "identifier" and t.text not in seen and t.text not in KEYWORDS["haskell"] and any(x.text == "=" for x in code[a + c : a + d + 1]):
                            seen.add(t.text)
                            out.append(symbol(t.text, "method", "method", t, code[a + d]))
        elif code[a].cls == "identifier" and word not in KEYWORDS["haskell"]:
            if out and out[-1]["name"] == word and out[-1]["kind"] == "function":
                out[-1] |= {k2: v for k2, v in span(code[a], code[last]).items() if k2.startswith("end")}
            else:
                out.append(symbol(word, "function", "function", code[a], code[last]))
    return Extraction(([module] if module else []) + out, relabel(tokens, KEYWORDS["haskell"]))


def cobol(src: str) -> Extraction:
    """Programs, divisions, sections, paragraphs and level 01/77 items, by sentences."""
    fixed = any(regex.match(r"[0-9 ]{6}[ *\-/]", x) for x in src.split("\n") if x.strip())
    dialect = DIALECTS["cobol"] if fixed else replace(DIALECTS["cobol"], rules=tuple(r for r in DIALECTS["cobol"].rules if r != "*>"), columns=None)
    tokens = tokenize(src, dialect)
    code = [t for t in tokens if t.cls != "comment"]
    low = [t.text.lower() for t in code]
    n, marks, procedure = len(code), [], False
    for i in range(n):
        begins = i == 0 or code[i - 1].text == "." or code[i].start_line > code[i - 1].end_line
        after = low[i + 1] if i + 1 < n else ""
        if low[i] == "program-id" and i + 2 < n:
            marks.append((i, 0, symbol(code[i + 2].text, "module", "program", code[i], code[i])))
        elif begins and after == "division":
            procedure = low[i] == "procedure"
            marks.append((i, 1, symbol(code[i].text, "other", "division", code[i], code[i])))
        elif begins and after == "section":
            marks.append((i, 2, symbol(code[i].text, "other", "section", code[i], code[i])))
        elif begins and low[i] in ("01", "77", "1") and i + 1 < n and code[i + 1].cls == "identifier":
            marks.append((i, 3, symbol(code[i + 1].text, "variable", f"level-{int(low[i]):02d}", code[i], code[i])))
        elif begins and procedure and after == "." and code[i].cls == "identifier" and low[i] not in KEYWORDS["cobol"] and not low[i].startswith("end-"):
            marks.append((i, 3, symbol(code[i].text, "function", "paragraph", code[i], code[i])))
    out = []
    for k, (i, level, s) in enumerate(marks):
        stop = next((j for j, other, _ in marks[k + 1 :] if other <= level), n) - 1
        if level == 0:
            start = next((j for j, other, t in reversed(marks[:k]) if other == 1 and t["name"].lower() == "identification"), i)
            out.append((start, stop, s | span(code[start], code[stop])))
        else:
            out.append((i, stop, s | span(code[i], code[stop])))
    return Extraction(_nested_only(out), relabel(tokens, KEYWORDS["cobol"], True))


_DATA = regex.compile(r"(?i)^(?:db|dw|dd|dq|dt|resb|resw|resd|resq|\.byte|\.word|\.long|\.quad|\.int|\.short|\.ascii|\.asciz|\.string|\.zero|\.space|byte|word|dword|qword|real4|real8)$")
#: Shapes of assembly lines, in order: pattern, kind, lang_kind; group 1 is the name.
_ASM = tuple((regex.compile(p, regex.I), k, lk) for p, k, lk in (
    (r"^\s*(?:%define|%assign)\s+([\w.$@?]+)", "constant", "define"), (r"^\s*(?:\.macro|%macro)\s+([\w.$@?]+)", "other", "macro"), (r"^\s*([\w.$@?]+)\s+macro\b", "other", "macro"),
    (r"^\s*([\w.$@?]+)\s+proc\b", "function", "proc"), (r"^\s*(?:section|segment|\.section)\s+([\w.$@?]+)", "module", "section"), (r"^\s*(\.(?:text|data|bss|rodata|code|const))\b", "module", "section"),
    (r"^\s*([\w.$@?]+)\s+segment\b", "module", "segment"), (r"^\s*struc\s+([\w.$@?]+)", "type", "struct"), (r"^\s*([\w.$@?]+)\s+(?:struct|struc|union)\b", "type", "struct"),
    (r"^\s*\.(?:set|equ|equiv)\s+([\w.$@?]+)\s*,", "constant", "equ"), (r"^\s*([\w.$@?]+)\s+equ\b", "constant", "equ"), (r"^\s*([\w.$@?]+)\s*=\s*\S", "constant", "equ"), (r"^\s*([\w.$@?]+)\s+label\b", "function", "label"),
))
#: Words that close what a line of the given kind opens.
_ASM_ENDS = {"macro": _w("endm .endm %endmacro endmacro"), "proc": _w("endp"), "segment": _w("ends"), "struct": _w("endstruc ends endstruct")}


def asm(src: str) -> Extraction:
    tokens = tokenize(src, DIALECTS["asm"])
    code = [t for t in tokens if t.cls != "comment"]
    text, found = src.split("\n"), []
    lines = _by_line(code)
    for k, (a, b) in enumerate(lines):
        line = text[code[a].start_line - 1]
        hit = next(((m[1], kind, lk) for p, kind, lk in _ASM if (m := p.match(line))), None)
        if hit is None:
            m = regex.match(r"^\s*([\w.$@?]+)\s*(:?)\s*(\S*)", line)
            if m and (m[2] or _DATA.match(m[3])):
                rest = m[3] or (text[code[lines[k + 1][0]].start_line - 1].strip().split(" ")[0] if k + 1 < len(lines) else "")
                hit = (m[1], "variable", "data") if _DATA.match(rest) else (m[1], "function", "label")
        if hit:
            found.append((k, a, b, *hit))
    out = []
    for x, (k, a, b, name, kind, lk) in enumerate(found):
        last = b
        if lk in _ASM_ENDS:
            for c, d in lines[k + 1 :]:
                words = text[code[c].start_line - 1].lower().split()
                if any(w in _ASM_ENDS[lk] for w in words[:2]):
                    last = d
                    break
        elif lk in ("section", "label"):
            same = _w("section segment") if lk == "section" else _w("section segment label proc macro struct data")
            stop = next((f[1] for f in found[x + 1 :] if f[5] in same), len(code))
            last = stop - 1
        out.append((a, last, symbol(name, kind, lk, code[a], code[last])))
    return Extraction(_nested_only(out), relabel(tokens, KEYWORDS["asm"], True))


def _r(src: str) -> Extraction:
    """R, with class and generic calls; in R Markdown and Quarto only the R chunks count."""
    if regex.search(r"(?m)^```+\s*\{r", src):
        keep = [m.span(1) for m in regex.finditer(r"(?ms)^```+\s*\{r[^}\n]*\}[^\n]*\n(.*?)^```", src)]
        src = "".join(c if c == "\n" or any(a <= i < b for a, b in keep) else " " for i, c in enumerate(src)) if src.isascii() else src
    out = Scanner(_BY_NAME["r"])(src)
    code = [t for t in out.tokens if t.cls != "comment"]
    close, more = close_table(code), []
    #: Calls that define a class or a generic by name.
    calls = {"setClass": ("type", "setClass"), "setRefClass": ("type", "setRefClass"), "R6Class": ("type", "R6Class"), "setGeneric": ("method", "generic"), "setMethod": ("method", "method")}
    for i, t in enumerate(code):
        if t.text in calls and i + 2 < len(code) and code[i + 1].text == "(" and i + 1 in close and code[i + 2].cls == "literal":
            kind, lk = calls[t.text]
            first = i - 3 if i >= 3 and [c.text for c in code[i - 2 : i]] == ["<", "-"] else i
            more.append(symbol(code[i + 2].text.strip("\"'"), kind, lk, code[first], code[close[i + 1]]))
    types = [s for s in more if s["kind"] == "type"]
    own = [s | {"kind": "method"} if any(c["start"] < s["start"] < c["end"] for c in types) else s for s in out.symbols]
    starts, ends = {t.start: i for i, t in enumerate(code)}, {t.end: i for i, t in enumerate(code)}
    return Extraction(_nested_only([(starts[s["start"]], ends[s["end"]], s) for s in [*own, *more]]), out.tokens)


def lines(src: str) -> Extraction:
    """The plug-in example: one symbol per line that isn't blank, named by its first word."""
    tokens = tokenize(src)
    out, at = [], 0
    for a, b in _by_line(tokens):
        out.append(symbol(tokens[a].text, "other", "line", tokens[a], tokens[b]))
        at = b
    del at
    return Extraction(_nested_only([(s["start"], s["end"], s) for s in out]), tokens)


def default_registry() -> Registry:
    """All built-in extractors."""
    own = [
        Extractor("python", python, 1, ("py", "pyw", "pyi")), Extractor("html", html, 1, ("html", "htm", "xhtml")), Extractor("aspx", aspx, 1, ("aspx", "ascx", "master")), Extractor("go", go, 1, ("go",)),
        Extractor("rust", rust, 1, ("rs",)), Extractor("sql", sql, 1, ("sql",)), Extractor("haskell", haskell, 1, ("hs", "lhs")), Extractor("cobol", cobol, 1, ("cbl", "cob", "cpy")), Extractor("asm", asm, 1, ("asm", "s")), Extractor("r", _r, 1, ("r", "rmd", "qmd")),
    ]
    table = [extractor(x) for x in (*LANGUAGES, _TS, _CPP) if x.name != "r"]
    return Registry([*table, *own])


__all__ = ["default_registry", "fallback", "lines"]
