"""Symbol-name patterns: ``name``, ``prefix*``, ``*``, ``*needle*``, ``*needle``; ``\\*`` is a literal star at either end."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column

LEAST, MOST = 2, 256  # bytes of a needle


@dataclass(frozen=True)
class Pattern:
    how: str  # exact, prefix, infix, suffix
    text: str

    def matches(self, name: str) -> bool:
        test = {"exact": name.__eq__, "prefix": name.startswith, "infix": name.__contains__, "suffix": name.endswith}
        return bool(test[self.how](self.text))

    def on(self, name: Column) -> Column:
        """As a filter that reaches the Parquet scan."""
        if self.how == "exact":
            return name == self.text
        return {"prefix": name.startswith, "infix": name.contains, "suffix": name.endswith}[self.how](self.text)

    def folded(self) -> Pattern:
        return Pattern(self.how, re.sub("[A-Z]", lambda m: m[0].lower(), self.text))


_FORM = re.compile(r"(?P<lead>\\\*|\*)?(?P<body>.*?)(?P<trail>\\\*|\*)?", re.S)


def parse(pattern: str) -> Pattern:
    if not pattern:
        raise ValueError("empty symbol pattern (use * to list all symbols)")
    if pattern == "*":
        return Pattern("prefix", "")
    if pattern.endswith("**"):
        raise ValueError("a pattern that ends in ** is ambiguous")
    lead, body, trail = _FORM.fullmatch(pattern).group("lead", "body", "trail")
    star = {"\\*": "*"}
    if lead != "*":
        return Pattern("prefix" if trail == "*" else "exact", star.get(lead, "") + body + star.get(trail, ""))
    if re.search(r"(?<!\\)\*", body):
        raise ValueError("an unescaped * inside a needle; write \\* for a literal one")
    needle = body.replace("\\*", "*") + star.get(trail, "")
    how = "infix" if trail == "*" else "suffix"
    if not LEAST <= len(needle.encode()) <= MOST:
        raise ValueError(f"{'an' if how == 'infix' else 'a'} {how} needle has {LEAST} to {MOST} bytes")
    return Pattern(how, needle)
