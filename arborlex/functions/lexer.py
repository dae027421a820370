"""A lexer of named rules: tokens with exact byte, line and column spans, for 22 dialects.

A dialect is an ordered list of rules, by name, from one catalogue
(:data:`RULES`); a rule is a pattern, the class of what it matches, and
sometimes a guard over the lexer's state (the token before, the markup mode,
open shell parentheses).  The first rule that matches at a position makes the
token; white space makes none.  Lexing never fails: what no rule knows is one
punctuation character.

Use :func:`columns.pieces` for the default dialect inside Spark expressions;
this module is what the Arrow functions run for the other dialects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import pairwise
from typing import NamedTuple

import regex

#: The operator characters.
OPERATORS = "+-*/%=<>!&|^~?@"
#: Characters that can join a run of dashes into a symbol in Haskell.
HASKELL_SYMBOLS = "!#$%&*+./<=>?@\\^|-~:"
#: A slash after one of these tokens, or after a literal or another word, divides in JavaScript.
NO_REGEX_AFTER = frozenset(") < > ] }".split())
#: After one of these words it starts a regular expression.
REGEX_AFTER_WORD = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())
GAP = r"[\p{White_Space}\uFEFF]"
WORD = r"[\p{Alphabetic}\p{N}_]"


class Token(NamedTuple):
    text: str
    cls: str
    start: int
    end: int
    start_line: int
    start_col: int
    end_line: int
    end_col: int


@dataclass(frozen=True)
class Dialect:
    """Names of rules, in the order in which they are tried, and the layout of lines if columns matter (cobol, rpg)."""

    rules: tuple[str, ...]
    columns: str | None = None

    def has(self, rule: str) -> bool:
        return rule in self.rules


@dataclass
class State:
    """What guards look at."""

    src: str
    pos: int = 0
    line_clean: bool = True  # no token on this line yet
    last: tuple[str, str] | None = None  # text and class of the token before
    tag: bool = False  # inside a markup tag
    code: bool = False  # inside an ASP.NET server tag
    pending: str | None = None  # quote of an attribute value that a server tag interrupts
    heredocs: list = field(default_factory=list)
    parens: list = field(default_factory=list)
    off: set = field(default_factory=set)  # rules given up for this file, as their end never came

    def before(self) -> str:
        return self.src[self.pos - 1] if self.pos else "\n"


class Rule(NamedTuple):
    cls: str
    find: Callable[[State, int], int]  # end of the match, or -1
    plain: str | None = None  # the pattern, if that is all there is to the rule
    starts: Callable[[str], bool] | None = None  # whether a match can start with a character; None: with any


@cache
def _re(pattern: str, flags: int = regex.S) -> regex.Pattern:
    return regex.compile(pattern, flags | regex.V1)


def _rule(cls: str, pattern: str, guard: Callable[[State], bool] | None = None) -> Rule:
    compiled = _re(pattern)

    def find(s: State, limit: int) -> int:
        if guard and not guard(s):
            return -1
        m = compiled.match(s.src, s.pos, limit)
        return m.end() if m else -1

    simple = guard is None and not regex.search(r"\\[1-9]|\(\?[0-9]|\((?!\?)", pattern)

    def starts(c: str) -> bool:
        return compiled.match(c, partial=True) is not None

    return Rule(cls, find, pattern if simple else None, starts)


def _until(s: State, limit: int, close: str, skip: int) -> int:
    at = s.src.find(close, s.pos + skip, limit)
    return limit if at < 0 else at + len(close)


def _nested(open_: str, close: str, unless: str | None = None) -> Callable[[State, int], int]:
    step = _re(f"{regex.escape(open_)}|{regex.escape(close)}")

    def find(s: State, limit: int) -> int:
        if not s.src.startswith(open_, s.pos, limit) or (unless and s.src.startswith(unless, s.pos, limit)):
            return -1
        depth = 0
        for m in step.finditer(s.src, s.pos, limit):
            depth += 1 if m[0] == open_ else -1
            if not depth:
                return m.end()
        return limit

    return find


def _quoted(q: str) -> str:
    """A string with backslash escapes; unterminated runs to the end."""
    return rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?\Z)"


def _doubled(q: str) -> str:
    return rf"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+(?:{q}|\Z)"


_ONE_LINE_DOUBLED = r"'(?:[^'\n\r]|\r(?!\n)|'')*+'?"
_ONE_LINE_SINGLE = r"'(?:[^'\\\n]|\\[^\n])*+(?:'|\\?(?=\n|\Z))"


def _raw_end(open_at: regex.Pattern, close: Callable[[regex.Match], str], key: str, give_up: bool) -> Callable[[State, int], int]:
    def find(s: State, limit: int) -> int:
        if key in s.off:
            return -1
        m = open_at.match(s.src, s.pos, limit)
        if not m:
            return -1
        at = s.src.find(close(m), m.end(), limit)
        if at >= 0:
            return at + len(close(m))
        if give_up:
            s.off.add(key)
            return -1
        return limit

    return find


_SUBST = _re(r"""\\.|["']|\$\(|[()]|\$\{|[{}]""")


def _shell_string(s: State, limit: int) -> int:
    """A double-quoted string through its real end, however command substitutions nest quotes."""
    if not s.src.startswith('"', s.pos) or "shell-nest" in s.off or "$(" not in s.src[s.pos : limit]:
        return -1
    stack, saw = ['"'], False
    for m in _SUBST.finditer(s.src, s.pos + 1, limit):
        x, top = m[0], stack[-1]
        if x[0] == "\\":
            continue
        if top == "'":
            if x == "'":
                stack.pop()
        elif x == "$(":
            saw = True
            stack.append(")")
        elif x == '"':
            if top == '"':
                stack.pop()
                if not stack:
                    return m.end() if saw else -1
            else:
                stack.append('"')
        elif top == ")":
            if x == "(":
                stack.append(")")
            elif x == ")":
                stack.pop()
            elif x == "'":
                stack.append("'")
    s.off.add("shell-nest")
    return -1


_HEREDOC = _re(r"""<<(-?)(?:'([^'\n]+)'|"([^"\n]+)"|\\?([\p{Alphabetic}_][^\s;&|<>()'"`]*))(?<!<<<)""")


def _heredoc(s: State, limit: int) -> int:
    if not s.src.startswith("<<", s.pos) or s.src.startswith("<<<", s.pos) or s.before() == "<" or (s.parens and s.parens[-1]):
        return -1
    m = _HEREDOC.match(s.src, s.pos, limit)
    if not m:
        return -1
    s.heredocs.append((m[2] or m[3] or m[4], bool(m[1])))
    return m.end()


_REGEX_LITERAL = _re(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*+")


def _regex_literal(s: State, limit: int) -> int:
    if s.last is not None:
        text, cls = s.last
        if cls == "literal" or (text not in REGEX_AFTER_WORD if cls == "identifier" else text in NO_REGEX_AFTER):
            return -1
    m = _REGEX_LITERAL.match(s.src, s.pos, limit)
    return m.end() if m else -1


def _attribute(s: State, limit: int, quote: str, skip: int, aspx: bool) -> int:
    stop = _re(f"{quote}|<%" if aspx else quote).search(s.src, s.pos + skip, limit)
    if stop is None:
        s.pending = None
        return limit
    s.pending = quote if stop[0] == "<%" else None
    return stop.start() if s.pending else stop.end()


def _server_tag(s: State, limit: int) -> int:
    """The marks of a server block, but for those of a server comment."""
    m = _re(r"<%(?!--)[@=#:$]?|%>").match(s.src, s.pos, limit)
    if m:
        s.code = m[0][0] == "<"
    return m.end() if m else -1


def _begun(opening: str, close: str, skip: int, guard: Callable[[State], bool] = lambda s: True) -> Callable[[State, int], int]:
    """From an opening through its close, or the end."""
    return lambda s, limit: _until(s, limit, close, skip) if guard(s) and s.src.startswith(opening, s.pos, limit) else -1


def _in_code(s: State) -> bool:
    return s.code


def _in_markup(s: State) -> bool:
    return not s.code


def _value(server: bool) -> Callable[[State, int], int]:
    """A quoted attribute value; server: a server tag may interrupt it."""
    return lambda s, limit: _attribute(s, limit, s.src[s.pos], 1, server) if not s.code and s.tag and s.src[s.pos] in "\"'" else -1


_TAIL = r"[\p{Alphabetic}\p{N}_]*+"
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_PREFIXED = rf"(?i:[rbuft]|r[bft]|[bft]r)(?:{_quoted(chr(34))}|{_ONE_LINE_SINGLE})"


def _triple(prefix: str, escapes: bool) -> str:
    body = r"(?:[^\\]|\\.)*?" if escapes else r".*?"
    return rf"{prefix}(\"\"\"|'''){body}(?:\1|\\?\Z)"


def _catalogue() -> dict[str, Rule]:
    """Every rule by its name."""
    return {
        # comments
        "//": _rule("comment", r"//[^\n]*+"),
        "/*": _rule("comment", r"/\*.*?(?:\*/|\Z)"),
        "/*nested": Rule("comment", _nested("/*", "*/"), starts="/".__eq__),
        "#": _rule("comment", r"#[^\n]*+"),
        "#line": _rule("comment", r"#[^\n]*+", lambda s: s.line_clean),
        "#word": _rule("comment", r"#[^\n]*+", lambda s: bool(regex.match(rf"{GAP}|[;&|()]", s.before()))),
        "#alone": _rule("comment", r"#(?=\s|\Z)[^\n]*+", lambda s: s.line_clean),
        "*>": _rule("comment", r"\*>[^\n]*+"),
        "--": _rule("comment", r"--[^\n]*+"),
        "--symbol": _rule("comment", rf"--++(?![{regex.escape(HASKELL_SYMBOLS)}])[^\n]*+", lambda s: s.before() not in HASKELL_SYMBOLS),
        ";": _rule("comment", r";[^\n]*+"),
        "{-": Rule("comment", _nested("{-", "-}"), starts="{".__eq__),
        "(*": Rule("comment", _nested("(*", "*)", "(*)"), starts="(".__eq__),
        # markup
        "<!--": Rule("comment", _begun("<!--", "-->", 2, _in_markup), starts="<".__eq__),
        "<%--": Rule("comment", _begun("<%--", "--%>", 4), starts="<".__eq__),
        "<%": Rule("punctuation", _server_tag, starts="<%".__contains__),
        "value-rest": Rule("literal", lambda s, limit: _attribute(s, limit, s.pending, 0, True) if s.pending and not s.code else -1),
        "//server": _rule("comment", r"//(?:(?!%>)[^\n])*+", _in_code),
        "/*server": _rule("comment", r"/\*.*?(?:\*/|\Z)", _in_code),
        "@server": _rule("literal", r"(?:@\$?|\$@)" + _doubled('"'), _in_code),
        "$server": _rule("literal", r"\$" + _quoted('"'), _in_code),
        "tag-word": _rule("identifier", rf"[\p{{Alphabetic}}_](?:{WORD}|[-:](?={WORD}))*+", lambda s: s.tag and not s.code),
        "value": Rule("literal", _value(False), starts="\"'".__contains__),
        "value-server": Rule("literal", _value(True), starts="\"'".__contains__),
        "loose-quote": _rule("punctuation", r"[\"'`]", _in_markup),
        # shell
        "$name": _rule("identifier", rf"\$(?:[\p{{Alphabetic}}_]{WORD}*+|[0-9@*#?$!-]|(\{{(?:[^{{}}\n]|(?1))*+\}}))"),
        "<<": Rule("operator", _heredoc, starts="<".__eq__),
        "$'": _rule("literal", r"\$" + _quoted("'")),
        "'shell": _rule("literal", r"'(?:[^']*+'|[^\n]*?(?=\r?\n|\Z))"),
        '"shell': Rule("literal", _shell_string, starts='"'.__eq__),
        # strings
        '"""': _rule("literal", _triple("", True)),
        '"""raw': _rule("literal", _triple("", False)),
        '"""prefix': _rule("literal", _triple("(?i:[rbuft]|[rbft]{2})?", True)),
        "prefix": _rule("literal", _PREFIXED),
        "`raw": _rule("literal", r"`[^`]*+(?:`|\Z)"),
        "'sql": _rule("literal", _doubled("'")),
        '"sql': _rule("identifier", _doubled('"')),
        "[sql": _rule("identifier", r"\[[\p{Alphabetic}_@# ][^\[\]\n\r]*+\]"),
        "r#": Rule("literal", _raw_end(_re(r'(?:b|c)?r(#*)"'), lambda m: '"' + m[1], "rust", False)),
        'b"': _rule("literal", "[bc]" + _quoted('"')),
        "b'": _rule("literal", r"b'(?:\\.[^'\n]*+|[^'\\\n])'"),
        "@": _rule("literal", r"(?:@\$?|\$@)" + _doubled('"')),
        '$"': _rule("literal", r"\$" + _quoted('"')),
        "r(": Rule("literal", _raw_end(_re(r"""[rR](["'])(-*)([(\[{])"""), lambda m: _CLOSING[m[3]] + m[2] + m[1], "r-raw", True)),
        "'doubled": _rule("literal", _ONE_LINE_DOUBLED),
        "'line": _rule("literal", _ONE_LINE_SINGLE),
        '"': _rule("literal", _quoted('"')),
        "`": _rule("literal", _quoted("`")),
        "char": _rule("literal", r"(?='(?:\\.{0,9}'|[^'\\\n]'))" + _quoted("'")),
        "/regex/": Rule("literal", _regex_literal, starts="/".__eq__),
        # words, numbers, the rest
        "word": _rule("identifier", rf"[\p{{Alphabetic}}_]{_TAIL}"),
        "word'": _rule("identifier", r"[\p{Alphabetic}_][\p{Alphabetic}\p{N}_']*+"),
        "word-": _rule("identifier", rf"[\p{{Alphabetic}}_](?:[\p{{Alphabetic}}\p{{N}}_]|-(?={WORD}))*+"),
        "number": _rule("literal", rf"[0-9](?:[\p{{Alphabetic}}\p{{N}}_.]*{WORD})?"),
        "operator": _rule("operator", f"[{regex.escape(OPERATORS)}]"),
        "other": _rule("punctuation", "."),
    }


RULES = _catalogue()


def _dialect(rules: str, columns: str | None = None) -> Dialect:
    return Dialect(tuple(rules.split()), columns)


DEFAULT = _dialect('// /* word number " ` char operator other')
_SCRIPT = _dialect("// /* word number 'line \" ` char /regex/ operator other")
_PYTHON = _dialect("# \"\"\"prefix prefix word number 'line \" ` char operator other")
DIALECTS: dict[str, Dialect] = {
    "asm": _dialect("#line ; // /* word number 'doubled \" ` char operator other"),
    "aspx": _dialect("<%-- <% value-rest <!-- //server /*server @server $server tag-word word number value-server loose-quote \" ` char operator other"),
    "c": DEFAULT,
    "cobol": _dialect("*> word- number 'doubled \" ` char operator other", "cobol"),
    "cpp": DEFAULT,
    "csharp": _dialect('// /* @ $" word number " ` char operator other'),
    "elixir": _dialect("# \"\"\" word number 'line \" ` char operator other"),
    "fsharp": _dialect('(* // """raw word\' number " ` char operator other'),
    "gdscript": _PYTHON,
    "go": _dialect('// /* `raw word number " ` char operator other'),
    "haskell": _dialect('--symbol {- word\' number " ` char operator other'),
    "html": _dialect("<!-- tag-word word number value loose-quote operator other"),
    "java": _dialect('// /* """ word number " ` char operator other'),
    "javascript": _SCRIPT,
    "python": _PYTHON,
    "r": _dialect("# `raw r( word number 'line \" ` char operator other"),
    "rpg": _dialect("// word- number 'doubled \" ` char operator other", "rpg"),
    "rust": _dialect("// /*nested r# b\" b' word number \" ` char operator other"),
    "scala": _dialect('// /* """raw word number " ` char operator other'),
    "shell": _dialect("#word $name << $' 'shell word number \"shell \" ` char operator other"),
    "sql": _dialect("#alone -- /* 'sql \"sql [sql word number \" ` char operator other"),
    "typescript": _SCRIPT,
}


@lru_cache(maxsize=64)
def _rules(d: Dialect) -> tuple[Rule, ...]:
    return tuple(RULES[name] for name in d.rules)


@lru_cache(maxsize=64)
def _first_chars(d: Dialect) -> dict[str, list[Rule]]:
    """What Lexer.rules_at remembers, shared by all texts of a dialect."""
    return {}


@lru_cache(maxsize=64)
def _combined(d: Dialect) -> regex.Pattern | None:
    """All rules of a dialect as one pattern, if none of them looks at the state."""
    rules = _rules(d)
    if d.columns or any(r.plain is None for r in rules):
        return None
    return _re("|".join([f"(?P<gap>{GAP}++)", *(f"(?P<{r.cls}{n}>{r.plain})" for n, r in enumerate(rules))]))


def _scan(src: str, combined: regex.Pattern) -> list[Token]:
    """The tokens of a dialect without state, in one pass of its combined pattern."""
    out, byte, line, col = [], 0, 1, 1
    ascii_ = src.isascii()
    for m in combined.finditer(src):
        text, kind = m[0], m.lastgroup
        size = len(text) if ascii_ or text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if "\n" in text:
            end_line, tail = line + text.count("\n"), text[text.rindex("\n") + 1 :]
            end_col = 1 + len(tail) - tail.count("\ufeff")
        else:
            end_line, end_col = line, col + len(text) - (0 if ascii_ else text.count("\ufeff"))
        if kind != "gap":
            out.append(Token(text, kind.rstrip("0123456789"), byte, byte + size, line, col, end_line, end_col))
        byte, line, col = byte + size, end_line, end_col
    return out


class Lexer:
    def __init__(self, src: str, dialect: Dialect):
        self.s, self.d = State(src), dialect
        self.rules, self.by_first = _rules(dialect), _first_chars(dialect)
        self.out: list[Token] = []
        self.byte, self.line, self.col = 0, 1, 1
        self.gap = _re(GAP + "++")
        self.markup, self.shell = dialect.has("<!--"), dialect.has("<<")

    def rules_at(self, first: str) -> list[Rule]:
        """The rules that can match at a character; rules without state are tried on it once and remembered."""
        found = self.by_first.get(first)
        if found is None:
            found = self.by_first[first] = [r for r in self.rules if r.starts is None or r.starts(first)]
        return found

    def skip(self, to: int) -> None:
        piece = self.s.src[self.s.pos : to]
        self.byte += len(piece.encode("utf-8", "surrogatepass"))
        n = piece.count("\n")
        if n:
            self.line += n
            self.col = 1
            self.s.line_clean = True
            piece = piece[piece.rindex("\n") + 1 :]
        self.col += len(piece) - piece.count("\ufeff")
        self.s.pos = to

    def emit(self, to: int, cls: str) -> None:
        text, at = self.s.src[self.s.pos : to], (self.byte, self.line, self.col)
        self.skip(to)
        self.out.append(Token(text, cls, at[0], self.byte, at[1], at[2], self.line, self.col))
        self.s.line_clean, self.s.last = False, (text, cls)

    def trimmed(self, start: int, end: int, cls: str) -> None:
        """What is between two positions, without white space at its ends, as one token if anything is left."""
        m = _re(rf"{GAP}*+(.*?){GAP}*\Z").match(self.s.src, start, end)
        if m and m[1]:
            self.skip(m.start(1))
            self.emit(m.end(1), cls)
        self.skip(end)

    def run(self, limit: int) -> None:
        s = self.s
        while s.pos < limit:
            m = self.gap.match(s.src, s.pos, limit)
            if m:
                to = m.end()
                if s.heredocs and "\n" in m[0]:
                    to = m.start() + m[0].index("\n") + 1
                self.skip(to)
                if s.heredocs and s.src[to - 1] == "\n":
                    self.heredoc_bodies(limit)
                continue
            markup_char = s.src[s.pos] if self.markup and not s.code else ""
            for rule in self.rules_at(s.src[s.pos]):
                end = rule.find(s, limit)
                if end > s.pos:
                    break
            if markup_char and end == s.pos + 1:
                if markup_char == "<":
                    s.tag = bool(_re(r"<[\p{Alphabetic}/!?]").match(s.src, s.pos, limit))
                elif markup_char == ">":
                    s.tag = False
            if self.shell and end == s.pos + 1:
                if s.src[s.pos] == "(":
                    s.parens.append(s.src.startswith("((", s.pos) or (bool(s.parens) and s.parens[-1]))
                elif s.src[s.pos] == ")" and s.parens:
                    s.parens.pop()
            self.emit(end, rule.cls)

    def heredoc_bodies(self, limit: int) -> None:
        s = self.s
        todo, s.heredocs = s.heredocs, []
        for word, strip in todo:
            tabs = r"\t*+" if strip else ""
            m = _re(rf"^{tabs}{regex.escape(word)}(?=\r?$)", regex.S | regex.M).search(s.src, s.pos, limit)
            end = m.end() if m else limit
            self.trim_left(end)
            m = _re(r"[^\S\n]*\n").match(s.src, s.pos, limit)
            if not m:
                return
            self.skip(m.end())

    def trim_left(self, end: int) -> None:
        m = self.gap.match(self.s.src, self.s.pos, end)
        if m:
            self.skip(m.end())
        if self.s.pos < end:
            self.emit(end, "literal")

    def fixed(self, limit: int) -> None:
        """Source in fixed columns, line by line: sequence area, indicator, code, identification area."""
        s, cobol = self.s, self.d.columns == "cobol"
        lead, last = (6, 72) if cobol else (5, 80)
        while s.pos < limit:
            start = s.pos
            stop = s.src.find("\n", start)
            stop = len(s.src) if stop < 0 else stop
            code_end = stop - s.src.endswith("\r", start, stop)
            columns = [i for i in range(start, code_end) if s.src[i] != "\ufeff"]
            at = lambda n: columns[n - 1] if n <= len(columns) else code_end  # noqa: B023, E731
            self.trimmed(start, at(lead + 1), "comment")
            begin = at(lead + 1)
            if not cobol:
                begin = at(lead + 2)
                self.run(begin)
            mark = s.src[begin : at(8)]
            if mark == "*" or cobol and mark == "/":
                self.trimmed(begin, code_end, "comment")
            else:
                if cobol:
                    self.run(at(8))
                self.run(at(last + 1))
                self.trimmed(at(last + 1), code_end, "comment")
            self.skip(min(stop + 1, len(s.src)))


_FREE = _re(r"\uFEFF?\*\*free[^\S\n]*(?=\n|\Z)", regex.S | regex.I)
_DATA_FREE = _re(r"^\*\*(?:CTDATA|FTRANS|ALTSEQ)", regex.M | regex.I)
_DATA_FIXED = _re(r"^\*\*(?:CTDATA|FTRANS|ALTSEQ|(?=[ \t\r\n]|\Z))", regex.M | regex.I)


def tokenize(src: str, dialect: Dialect = DEFAULT) -> list[Token]:
    """All tokens of a text, in order."""
    combined = _combined(dialect)
    if combined is not None:
        return _scan(src, combined)
    lexer = Lexer(src, dialect)
    free = bool(_FREE.match(src))
    marks = [m.start() for m in (_DATA_FREE if free else _DATA_FIXED).finditer(src)] if dialect.columns == "rpg" else []
    end = marks[0] if marks else len(src)
    if dialect.columns and not (dialect.columns == "rpg" and free):
        lexer.fixed(end)
    else:
        lexer.run(end)
    for a, b in pairwise([*marks, len(src)] if marks else []):
        lexer.trimmed(a, b, "literal")
    return lexer.out
