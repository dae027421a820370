"""The tool surface: the read and write operations as functions with checked arguments, limits and pages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import catalog as K
from ..operators.scope import Scope, scoped
from ..operators.search import Query, SymbolQuery, search, search_symbols
from ..sources.store import Store
from .graph import Graph

LIMIT, MOST, TOKENS = 50, 500, 20_000


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    has_more: bool
    next_offset: int | None


class BadArgument(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


PAGE_BYTES = 1 << 20


def capped(rows: list[dict], most_bytes: int) -> list[dict]:
    """The leading rows of a page whose JSON stays within most_bytes together; at least one row."""
    total = 0
    for n, r in enumerate(rows):
        total += len(json.dumps(r, ensure_ascii=False, default=str).encode())
        if n and total > most_bytes:
            return rows[:n]
    return rows


class Tools:
    def __init__(self, store: Store | None = None, graph: Graph | None = None, scope: Scope | None = None):
        self.store, self.scope = store, scope or Scope()
        self._graph = graph

    @property
    def graph(self) -> Graph:
        return scoped(self._graph if self._graph is not None else self.store.graph(), self.scope)

    def _named(self, action: str, org: str | None, repo: str | None) -> None:
        self.scope.check_named(self._graph if self._graph is not None else self.store.graph(), action, org, repo)

    @staticmethod
    def _limits(limit: int | None, offset: int, default: int = LIMIT, most: int = MOST) -> tuple[int, int]:
        limit = default if limit is None else limit
        if not 1 <= limit <= most:
            raise BadArgument("invalid_limit", f"limit is 1 to {most}")
        if offset < 0:
            raise BadArgument("invalid_offset", "offset is 0 or more")
        return limit, offset

    def _known(self, language: str | None, kind: str | None) -> None:
        """A language or kind that nothing has is a mistake, and the answer says what there is."""
        if language or kind:
            try:
                K.check_filters(self.graph, language=language, kind=kind)
            except ValueError as e:
                raise BadArgument("unknown_filter", str(e)) from e

    @staticmethod
    def _page(df: DataFrame, limit: int, offset: int) -> Page:
        rows = [r.asDict(recursive=True) for r in df.collect()]
        own = capped(rows[:limit], PAGE_BYTES)
        more = len(rows) > len(own)
        return Page(own, more, offset + len(own) if more else None)

    def describe(self, org: str | None = None, repo: str | None = None) -> list[dict]:
        self._named("describe", org, repo)
        return [r.asDict(recursive=True) for r in K.describe_nested(self.graph, org, repo).collect()]

    def list_repos(self, org: str | None = None, limit: int | None = None, offset: int = 0) -> Page:
        self._named("list_repos", org, None)
        limit, offset = self._limits(limit, offset)
        return self._page(K.list_repos(self.graph, org).offset(offset).limit(limit + 1), limit, offset)

    def search(self, text: str, grain: str = "symbol", limit: int | None = None, offset: int = 0, **filters) -> Page:
        if not text:
            raise BadArgument("empty_text", "the text is empty")
        self._named("search", filters.get("org"), filters.get("repo"))
        limit, offset = self._limits(limit, offset)
        self._known(filters.get("language"), filters.get("symbol_kind"))
        try:
            q = Query(text, grain, limit=limit + 1, offset=offset, **filters)
        except ValueError as e:
            raise BadArgument("invalid_query", str(e)) from e
        return self._page(search(self.graph, q), limit, offset)

    def find_symbols(self, pattern: str, limit: int | None = None, offset: int = 0, **filters) -> Page:
        self._named("find_symbols", filters.get("org"), filters.get("repo"))
        limit, offset = self._limits(limit, offset)
        self._known(filters.get("language"), filters.get("kind"))
        try:
            q = SymbolQuery(pattern, limit=limit + 1, offset=offset, **filters)
        except ValueError as e:
            raise BadArgument("invalid_pattern", str(e)) from e
        return self._page(search_symbols(self.graph, q), limit, offset)

    def file_outline(self, org: str, repo: str, path: str, limit: int | None = None, offset: int = 0) -> Page:
        self._named("file_outline", org, repo)
        limit, offset = self._limits(limit, offset)
        return self._page(K.file_outline(self.graph, org, repo, path).drop("chain").offset(offset).limit(limit + 1), limit, offset)

    def file_tokens(self, org: str, repo: str, path: str, start_line: int | None = None, end_line: int | None = None, limit: int | None = None, offset: int = 0) -> Page:
        self._named("file_tokens", org, repo)
        if start_line is not None and end_line is not None and start_line > end_line:
            raise BadArgument("invalid_range", "the first line is after the last")
        limit, offset = self._limits(limit, offset, TOKENS, TOKENS)
        return self._page(K.file_tokens(self.graph, org, repo, path, start_line, end_line).offset(offset).limit(limit + 1), limit, offset)

    def list_files(self, org: str, repo: str, prefix: str = "", limit: int | None = None, offset: int = 0) -> Page:
        self._named("list_files", org, repo)
        limit, offset = self._limits(limit, offset)
        return self._page(K.list_files(self.graph, org, repo, prefix).offset(offset).limit(limit + 1), limit, offset)

    def index_path(self, folder: str, org: str, repo: str, reindex: bool = False) -> list[dict]:
        from ..sources import walk

        files, skipped = walk.directory(self.store.spark, folder, org, repo)
        return [r.asDict() for r in walk.tally(self.store.upsert(files, reindex), skipped).collect()]

    def prune(self, folder: str, org: str, repo: str, dry_run: bool = False) -> list[str]:
        from ..sources import walk

        files, _ = walk.directory(self.store.spark, folder, org, repo)
        return [r["path"] for r in self.store.prune(org, repo, files.select("path"), dry_run).collect()]
