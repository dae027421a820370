"""Symbol extraction: the plug-in registry and a table-driven declaration scanner.

An extractor turns a text into symbols, tokens and a flag for syntax errors.
Most languages share one scanner, :class:`Scanner`: a language gives a table
of declaration rules (:mod:`languages`), each a small pattern over the stream
of tokens, and says how far a declaration reaches: a brace block, an
indented block, a keyword block, a statement, a line or the file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import regex

from .lexer import DEFAULT, DIALECTS, Dialect, Token, tokenize

Symbol = dict  # name, kind, lang_kind, owner and the six span fields


@dataclass
class Extraction:
    symbols: list[Symbol] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    has_errors: bool = False
    note: str | None = None


def span(first: Token, last: Token) -> dict:
    return {"start": first.start, "end": last.end, "start_line": first.start_line, "start_col": first.start_col, "end_line": last.end_line, "end_col": last.end_col}


def symbol(name: str, kind: str, lang_kind: str | None, first: Token, last: Token, owner: str | None = None) -> Symbol:
    return {"name": name, "kind": kind, "lang_kind": lang_kind, "owner": owner, **span(first, last)}


@dataclass(frozen=True)
class Extractor:
    language: str
    run: Callable[[str], Extraction]
    version: int = 1
    extensions: tuple[str, ...] = ()


class Registry:
    """Extractors by language; the last registration of a language wins."""

    def __init__(self, extractors: Iterable[Extractor] = ()):
        self.by_language: dict[str, Extractor] = {}
        for e in extractors:
            self.register(e)

    def register(self, e: Extractor) -> None:
        self.by_language[e.language.lower()] = e

    def get(self, language: str) -> Extractor:
        return self.by_language.get(language.lower()) or fallback(language.lower())

    def version(self, language: str) -> int:
        e = self.by_language.get(language.lower())
        return e.version if e else 0

    def claimed(self) -> dict[str, str]:
        return {x: e.language for e in self.by_language.values() for x in e.extensions}


def fallback(language: str) -> Extractor:
    """Tokens of the language's dialect (or the default one), no symbols."""
    return Extractor(language, lambda src: Extraction(tokens=tokenize(src, DEFAULT)), 0)


#: Words that never are a declaration's type.
NOT_TYPES = frozenset("return throw new else case goto import package using delete typeof await yield in is as if while for switch do try catch extends implements".split())
#: What may follow a function's parameters.
AFTER_PARAMETERS = frozenset("{ ; = : & - [ const default final noexcept override throw throws try volatile where requires".split())
UNNAMED = {"indexer": "this"}
GROUPS = {"(...)": "(", "[...]": "[", "{...}": "{"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def close_table(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket that is closed in order, the index of its partner; linear time."""
    out, stack = {}, []
    for i, t in enumerate(tokens):
        if t.cls in ("literal", "comment"):
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            while stack and OPEN[tokens[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    return out


def balanced(tokens: list[Token]) -> bool:
    stack: list[str] = []
    for t in tokens:
        if t.cls in ("literal", "comment"):
            continue
        if t.text in OPEN:
            stack.append(OPEN[t.text])
        elif t.text in CLOSE and (not stack or stack.pop() != t.text):
            return False
    return not stack


def relabel(tokens: list[Token], keywords: frozenset, ignore_case: bool = False) -> list[Token]:
    fold = str.lower if ignore_case else str
    return [t._replace(cls="keyword") if t.cls == "identifier" and fold(t.text) in keywords else t for t in tokens]




@dataclass(frozen=True)
class Decl:
    """A declaration: ``head`` is a pattern of words; NAME is the declared name, NAME? an optional one.

    Words are compared with token texts; TYPE is any identifier that can name a type; ``*`` skips to the next part within the statement;
    ``(...)``, ``[...]`` and ``{...}`` are bracket groups, ``<...>`` an optional angle group, PTR a pointer or reference mark.
    reach: brace, statement, item (a statement that a comma may end), indent, block, line, file, group (brackets after the name), token.
    inside: the kinds of the innermost enclosing declaration that the rule needs, if any.
    """

    head: str
    kind: str
    lang_kind: str | None
    reach: str = "brace"
    inside: tuple[str, ...] | None = None
    method: bool = False  # kind function becomes method directly inside a type


@dataclass(frozen=True)
class Language:
    name: str
    decls: tuple[Decl, ...]
    keywords: frozenset = frozenset()
    extensions: tuple[str, ...] = ()
    dialect: Dialect = DEFAULT
    ignore_case: bool = False
    starts: str = "statement"  # where a rule may match: statement, line, anywhere
    block: tuple[frozenset, frozenset] = (frozenset(), frozenset())  # words that open and close keyword blocks
    modifiers: frozenset = frozenset()
    call_is_function: bool = False  # NAME (...) { is a function or method
    not_names: frozenset = frozenset()  # words that look like such a call but control flow
    version: int = 1
    typed: bool = False  # functions have their type before the name, and their bodies aren't scanned
    tilde: str | None = None  # what a function is called whose name follows ~
    member: str | None = None  # what an enum's members are called; they are declared by the words before ``,``
    member_ends: tuple[str, ...] = (",",)
    members_stop: str | None = None  # what ends the members before the body ends
    prepare: Callable[[str], str] | None = None  # blanks out what isn't code, keeping positions


class Scanner:
    def __init__(self, language: Language):
        self.lang = language
        self.rules = [(d, self._compile(d.head)) for d in language.decls]

    def _compile(self, head: str) -> list[tuple[str, bool]]:
        return [(w.rstrip("?") if len(w) > 1 else w, len(w) > 1 and w.endswith("?")) for w in head.split()]

    def __call__(self, src: str) -> Extraction:
        lang = self.lang
        tokens = tokenize(lang.prepare(src) if lang.prepare else src, lang.dialect)
        code = [t for t in tokens if t.cls != "comment"]
        self.code, self.close = code, close_table(code)
        self.fold = str.lower if lang.ignore_case else str
        self.opened_by = {b: a for a, b in self.close.items()}
        out: list[tuple[int, int, Symbol]] = []
        self.open_ = open_ = []  # last token, kind and name of what is open
        i = 0
        while i < len(code):
            while open_ and open_[-1][0] < i:
                open_.pop()
            made = self._function(i) if lang.typed else None
            if made:
                out.append(made[:3])
                i = made[1] + 1
                continue
            found = self._at(i, open_[-1][1] if open_ else None) if self._may_start(i) else None
            if found:
                d, name_at, body, last, kind = found
                first = self._first(i)
                name = code[name_at].text if name_at is not None else UNNAMED.get(d.lang_kind) or d.lang_kind or d.kind
                out.append((first, last, symbol(self._clean(name), kind, d.lang_kind, code[first], code[last])))
                members, resume = self._enum(i, last) if lang.member else ([], i)
                out += members
                if last > i and (d.reach not in ("statement", "item", "line", "token", "group") or body is not None and kind == "type"):
                    open_.append((last, kind if d.lang_kind != "impl" else "type", self._clean(name)))
                    at = body if body is not None else name_at if name_at is not None else i
                    i = max(i, at if at < len(code) and code[at].text == "{" else at - 1)
                elif lang.typed and d.reach == "statement" and kind in ("variable", "constant"):
                    i = last  # initialisers declare nothing
                elif name_at is not None:
                    i = max(i, name_at)
                i = max(i, resume)
            elif lang.member and code[i].text == "enum" and code[i].cls == "identifier":
                members, resume = self._enum(i, len(code) - 1)
                out += members
                i = max(i, resume)
            i += 1
        return Extraction(_nested_only(out), relabel(tokens, lang.keywords, lang.ignore_case))

    def _enum(self, i: int, last: int) -> tuple[list[tuple[int, int, Symbol]], int]:
        """The members of the enum whose head starts at token i, if one does, and the last token that belongs to them."""
        code, lang, j = self.code, self.lang, i
        while j <= last and code[j].text not in ("{", ";", "}", "=", "("):
            j += 1
        heads = [code[k].text for k in range(i, min(j, last))]
        if "enum" not in heads or "=" in heads or j > last or code[j].text != "{" or j not in self.close:
            return [], i
        end, at, out = self.close[j], j + 1, []
        while at < end:
            first, name = at, None
            while at < end and code[at].text not in lang.member_ends and code[at].text != lang.members_stop:
                t = code[at]
                if t.cls != "literal" and (t.text in OPEN or t.text in CLOSE):
                    if at not in self.close or self.close[at] > end:
                        return out, end
                    inner = at + 1 if t.text == "[" and self.close[at] == at + 2 and code[at + 1].cls == "literal" else None
                    if lang.member == "enumerator" and t.text == "(" and name == at - 1:  # a macro's invocation, not a member
                        first, name = self.close[at] + 1, None
                    elif lang.member == "enum_member" and name is None:
                        name = inner
                    at = self.close[at] + 1
                elif t.text == "@" and name is None:
                    at += 2
                    while at + 1 < end and code[at].text == ".":
                        at += 2
                    if at < end and code[at].text == "(" and at in self.close:
                        at = self.close[at] + 1
                else:
                    if name is None and (self._is(at, "NAME") or lang.member == "enum_member" and t.cls == "literal" and t.text[0] in "\"'"):
                        name = at
                    at += 1
            if name is not None:
                out.append((first, at - 1, symbol(self._clean(code[name].text), "constant", lang.member, code[first], code[at - 1])))
            if at < end and code[at].text == lang.members_stop:
                return out, at
            at += 1
        return out, end

    @staticmethod
    def _clean(name: str) -> str:
        quoted = regex.fullmatch(r'"(.*)"|`(.*)`|\[(.*)\]|\'(.*)\'', name, regex.S)
        return next(g for g in quoted.groups() if g is not None) if quoted else name

    def _may_start(self, i: int) -> bool:
        how = self.lang.starts
        if how == "anywhere" or i == 0:
            return True
        t, p = self.code[i], self.code[i - 1]
        new_line = t.start_line > p.end_line
        if how == "line":
            return new_line or p.text == ";" or p.text == "{"
        return new_line or p.text in (";", "{", "}", ")", ":", "]", ">", ",", "(") or self.fold(p.text) in self.lang.modifiers or self.fold(p.text) in self.lang.keywords

    def _first(self, i: int) -> int:
        """The first token of a declaration: back over modifiers and annotations on the same statement."""
        j = i
        while j > 0:
            p = self.code[j - 1]
            if self.fold(p.text) in self.lang.modifiers:
                j -= 1
            elif p.text == "]" and j - 1 in self.opened_by and self.opened_by[j - 1] > 0 and self.code[self.opened_by[j - 1] - 1].text == "#":
                j = self.opened_by[j - 1] - 1
            elif p.cls == "identifier" and j > 1 and self.code[j - 2].text == "@" and p.start == self.code[j - 2].end:
                j -= 2
            else:
                break
        return j

    def _at(self, i: int, inside: str | None):
        for d, words in self.rules:
            if d.inside is not None and inside not in d.inside:
                continue
            m = self._match(i, words)
            if m is None:
                continue
            name_at, after = m
            body, last = self._reach(d, i, after)
            if last is None:
                continue
            kind = "method" if d.method and d.kind == "function" and inside == "type" else d.kind
            return d, name_at, body, last, kind
        return self._call(i, inside) if self.lang.call_is_function and not self.lang.typed else None

    def _match(self, i: int, words: list[tuple[str, bool]]):
        code, name_at, k = self.code, None, 0
        while k < len(words):
            w, optional = words[k]
            k += 1
            if w == "*":
                want = words[k][0]
                while i < len(code) and not self._is(i, want) and code[i].text not in (";", "{", "}") and not (self.lang.starts == "line" and code[i].start_line > code[i - 1].end_line):
                    i = self.close.get(i, i) + 1
                continue
            if w == "<...>":
                if i < len(code) and code[i].text == "<":
                    depth = 0
                    while i < len(code):
                        depth += {"<": 1, ">": -1}.get(code[i].text, 0)
                        i += 1
                        if depth <= 0:
                            break
                continue
            if i < len(code) and self._is(i, w):
                if w == "NAME":
                    name_at = i
                i = self.close[i] + 1 if w in GROUPS else i + 1
                while w == "TYPE" and self.lang.call_is_function and i + 1 < len(code) and code[i].text == "." and code[i + 1].cls == "identifier":
                    i += 2
            elif not optional:
                return None
        # a rule that ends in a brace or semicolon only looks at it
        return name_at, i - 1 if i and code[i - 1].text in ("{", ";") else i

    def _is(self, i: int, w: str) -> bool:
        t = self.code[i]
        if w == "NAME":
            return t.cls in ("identifier", "keyword") and self.fold(t.text) not in self.lang.keywords
        if w == "TYPE":
            return t.cls == "identifier" and self.fold(t.text) not in NOT_TYPES
        if w == "TEXT":
            return t.cls == "literal"
        if w == "PTR":
            return t.text in ("*", "&")
        if w in GROUPS:
            return t.text == GROUPS[w] and i in self.close and t.cls != "literal"
        if len(w) > 1 and "|" in w:
            return any(self._is(i, x) for x in w.split("|"))
        return self.fold(t.text) == w

    def _call(self, i: int, inside: str | None):
        """NAME (...) followed, within the signature, by a brace block."""
        code = self.code
        t = code[i]
        if t.cls != "identifier" or self.fold(t.text) in self.lang.not_names or self.fold(t.text) in self.lang.keywords or i + 1 not in self.close or code[i + 1].text != "(":
            return None
        if i and (code[i - 1].text in (".", "=", "(", ",", "&", "|", "!", "?", "+", "-", "return", "new") or self.fold(code[i - 1].text) in self.lang.not_names):
            return None
        j = self.close[i + 1] + 1
        while j < len(code) and code[j].text not in ("{", ";", "=", ")", "}", ","):
            j = self.close.get(j, j) + 1
        if j >= len(code) or code[j].text != "{" or j not in self.close:
            return None
        kind = "method" if inside == "type" else "function"
        return Decl("NAME", kind, kind), i, j, self.close[j], kind

    def _head(self, i: int) -> int:
        """The first token of a function's head: back from its name over its type, modifiers and annotations."""
        code, j = self.code, i
        while j > 0:
            p = code[j - 1]
            line = j - 1
            while line and code[line - 1].start_line == p.start_line:
                line -= 1
            if p.cls == "literal" or code[line].text == "#" and p.start_line < code[j].start_line:
                break
            if p.text == "]" or p.text == ")" and self.opened_by.get(j - 1, 0) > 1 and code[self.opened_by[j - 1] - 2].text == "@":
                if j - 1 not in self.opened_by:
                    break
                j = self.opened_by[j - 1]
            elif p.text == ">":
                depth, k = 0, j - 1
                while k >= 0 and code[k].text not in ("{", "}", ";"):
                    depth += {">": 1, "<": -1}.get(code[k].text, 0)
                    if not depth:
                        break
                    k -= 1
                if k < 0 or depth:
                    break
                j = k
            elif p.cls == "identifier" and self.fold(p.text) not in NOT_TYPES or p.text in ("*", "&", "?", ".", "@", "~"):
                j -= 1
            elif p.text == ":" and j > 1 and code[j - 2].text == ":":
                j -= 2
            else:
                break
        return j

    def _function(self, i: int):
        """A function whose name, or the word operator, is token i: (first, last, symbol)."""
        code, lang = self.code, self.lang
        t, n = code[i], len(code)
        if t.cls != "identifier" or not i and n < 3:
            return None
        at = i + 1
        if t.text == "operator":
            at += at + 1 < n and code[at].text == "(" and code[at + 1].text == ")" and 2
            while at < n and code[at].text not in ("(", "{", ";", "}"):
                at += 1
        elif self.fold(t.text) in lang.keywords or self.fold(t.text) in lang.not_names:
            return None
        elif at < n and code[at].text == "<":
            while at < n and code[at].text not in ("(", ")", "{", "}", ";", "="):
                at += 1
            if code[min(at, n - 1) - 1].text != ">":
                return None
        if at >= n or code[at].text != "(" or at not in self.close:
            return None
        before = code[i - 1].text if i else "}"
        scoped = before == ":" and i > 1 and code[i - 2].text == ":"
        nullable = before == "?" and lang.tilde == "finalizer"
        if before == ":" and not scoped and (i < 2 or self.fold(code[i - 2].text) not in ("public", "private", "protected")):
            return None
        if not scoped and not nullable and before not in ("*", "&", ">", "]", "~", "{", "}", ";", ":", ")") and not (code[i - 1].cls == "identifier" and self.fold(before) not in NOT_TYPES):
            return None
        inside = self.open_[-1] if self.open_ else (n, None, "")
        if inside[1] not in (None, "module", "type"):
            return None
        j = self.close[at] + 1
        if j >= n or code[j].text not in AFTER_PARAMETERS or nullable and code[j].text == ":":
            return None
        while j < n and code[j].text not in ("{", ";", "=", ")", "}", "default"):
            j = self.close.get(j, j) + 1
        if j >= n or code[j].text in (")", "}"):
            return None
        body = code[j].text == "{"
        owner = inside[2] if inside[1] == "type" else code[i - 3].text if scoped and i > 2 else None
        if not body and inside[1] != "type":
            return None
        last = self.close.get(j) if body else next((k for k in self._jumps(j) if code[k].text == ";"), None)
        if last is None:
            return None
        first, tilde = self._head(i), before == "~"
        name = t.text
        if t.text == "operator":
            name += "".join((" " if code[k].start != code[k - 1].end or k == i + 1 and lang.tilde == "finalizer" else "") + code[k].text for k in range(i + 1, at))
        kinds = "operator" if t.text == "operator" else lang.tilde if tilde else "constructor" if owner == name else "method" if owner is not None else "function"
        if kinds == "destructor":
            name = "~" + name
        kind = "function" if owner is None else "method"
        return first, last, symbol(name, kind, kinds, code[first], code[last], code[i - 3].text if scoped and i > 2 else None)

    def _jumps(self, j: int):
        """Tokens from j on, groups skipped, up to the end of the enclosing group."""
        while j < len(self.code) and self.code[j].text not in CLOSE:
            yield j
            j = self.close.get(j, j) + 1

    def _reach(self, d: Decl, i: int, after: int):
        code, n = self.code, len(self.code)
        if d.reach == "file":
            return after, n - 1
        if d.reach == "token":
            return None, after - 1
        if d.reach in ("brace", "statement", "item"):
            j = after
            while j < n:
                t = code[j].text
                if t == "{":
                    end = self.close.get(j, n - 1)
                    if d.reach in ("statement", "item") and end + 1 < n and code[end + 1].text == ";":
                        end += 1
                    return j, end
                if t == ";":
                    return None, j
                if t == "}" or (t == "," and d.reach == "item") or (self.lang.starts == "line" and j > after and code[j].start_line > code[j - 1].end_line):
                    return None, max(i, j - 1)
                j = self.close.get(j, j) + 1
            return None, n - 1
        if d.reach == "group":
            return None, self.close.get(after, after) if after < n else n - 1
        if d.reach == "line":
            j = after
            while j < n and code[j].start_line == code[j - 1].end_line:
                j = self.close.get(j, j) + 1
            return None, min(j, n) - 1
        if d.reach == "indent":
            return self._indented(i, after)
        return self._keyword_block(i, after)

    def _indented(self, i: int, after: int):
        """Through the last line that starts deeper than the header's first token."""
        code, col = self.code, self.code[self._first(i)].start_col
        j = i + 1
        while j < len(code):
            if code[j].start_line > code[j - 1].end_line and code[j].start_col <= col:
                break
            j = self.close.get(j, j) + 1
        return after, min(j, len(code)) - 1

    def _keyword_block(self, i: int, after: int):
        opens, closes = self.lang.block
        depth, j = 0, i
        while j < len(self.code):
            word = self.fold(self.code[j].text)
            if word in opens and not (j + 1 < len(self.code) and self.code[j + 1].text == ":"):
                depth += 1
            elif word in closes:
                depth -= 1
                if depth <= 0:
                    return after, j
            elif depth == 0 and j > after and self.code[j].start_line > self.code[j - 1].end_line:
                return None, j - 1
            j += 1
        return after, len(self.code) - 1


def _nested_only(found: list[tuple[int, int, Symbol]]) -> list[Symbol]:
    """Drops declarations that cross an earlier one, so that spans nest."""
    out, stack = [], []
    for first, last, s in sorted(found, key=lambda x: (x[0], -x[1])):
        while stack and stack[-1] < first:
            stack.pop()
        if stack and last > stack[-1]:
            continue
        stack.append(last)
        out.append(s)
    return out


def extractor(language: Language) -> Extractor:
    return Extractor(language.name, lambda src: Scanner(language)(src), language.version, language.extensions)


def dialect_of(language: str) -> Dialect:
    return DIALECTS.get(language, DEFAULT)
