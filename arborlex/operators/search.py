"""Exact token search rolled up to a grain, and symbol search by name pattern.

The builder makes the choices that Catalyst can't: counts-only roll-ups read
postings instead of tokens; matches are counted by enclosing symbol before
anything is joined; a symbol's ancestors come from its stored chain, so no
range join is needed at query time; name positions are looked up after the
limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.patterns import parse
from ..plans.graph import FILE_KEY, Graph

KEYS = ("org", "repo", "file", "start", "idx")


@dataclass(frozen=True)
class Query:
    text: str
    grain: str = "token"
    language: str | None = None
    org: str | None = None
    repo: str | None = None
    token_class: str | None = None
    symbol_kind: str | None = None
    limit: int | None = None
    offset: int = 0

    def __post_init__(self):
        S.check_word(self.grain, S.GRAINS, "grain")
        S.check_word(self.token_class, S.TOKEN_CLASSES, "token class")
        if self.symbol_kind is not None and self.grain not in S.SYMBOLIC:
            raise ValueError("a symbol kind needs a symbolic grain (symbol, method or class)")
        never = {"method": set(S.SYMBOL_KINDS) - {"method", "function"}, "class": {"method", "function", "module", "variable", "constant"}}
        if self.symbol_kind and self.symbol_kind.lower() in never.get(self.grain, ()):
            raise ValueError(f"grain {self.grain} never holds a symbol of kind {self.symbol_kind}")


def _filtered(df: DataFrame, q, language: bool = True) -> DataFrame:
    for name in ("org", "repo"):
        if getattr(q, name) is not None:
            df = df.where(F.col(name) == getattr(q, name))
    if language and q.language is not None:
        df = df.where(F.col("language") == q.language.lower())
    return df


def _page(df: DataFrame, order: list, limit: int | None, offset: int) -> DataFrame:
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def _hit(df: DataFrame) -> DataFrame:
    missing = {f.name: F.lit(None).cast(f.dataType) for f in S.HIT if f.name not in df.columns}
    for name in ("no_symbols", "no_matching_symbol"):
        missing[name] = F.lit(False) if name in missing else F.col(name)
    if "lossy" in missing:
        missing["lossy"] = F.lit(False)
    return df.withColumns(missing).select(*S.HIT.names)


def search(g: Graph, q: Query) -> DataFrame:
    """Hits in the order (org, repo, file, start, index), after offset and limit."""
    if q.grain in ("file", "repo", "org"):
        return _roll_up(g, q)
    matches = _filtered(g.tokens, q).where(F.col("text") == q.text)
    if q.token_class is not None:
        matches = matches.where(F.col("class") == q.token_class)
    return _token_hits(g, q, matches) if q.grain == "token" else _symbol_hits(g, q, matches)


def _roll_up(g: Graph, q: Query) -> DataFrame:
    if q.token_class is None and g.postings is not None:
        rows, count = _filtered(g.postings, q).where(F.col("text") == q.text), F.sum("count")
    else:
        rows = _filtered(g.tokens, q).where(F.col("text") == q.text)
        if q.token_class is not None:
            rows = rows.where(F.col("class") == q.token_class)
        count = F.count(F.lit(1))
    by = {"org": ["org"], "repo": ["org", "repo"], "file": FILE_KEY}[q.grain]
    out = rows.groupBy(*by).agg(count.cast("bigint").alias("count"))
    out = _page(out, by, q.limit, q.offset)
    if q.grain == "file":
        out = out.join(_file_columns(g), FILE_KEY).withColumnRenamed("path", "file")
        return _hit(out).orderBy("org", "repo", "file")
    return _hit(out).orderBy("org", F.col("repo").asc_nulls_first())


def _file_columns(g: Graph) -> DataFrame:
    return g.files.select(*FILE_KEY, "language", "encoding", "lossy")


def _token_hits(g: Graph, q: Query, matches: DataFrame) -> DataFrame:
    page = _page(matches, [*FILE_KEY, "start", "ordinal"], q.limit, q.offset)
    symbols = g.symbols.select(*FILE_KEY, F.col("sidx").alias("parent_sidx"), F.col("qualified").alias("symbol"), F.col("kind").alias("symbol_kind"), "lang_kind")
    out = page.drop("language").join(symbols, [*FILE_KEY, "parent_sidx"], "left").join(_file_columns(g), FILE_KEY)
    out = out.withColumns({"token_class": F.col("class"), "count": F.lit(1).cast("bigint"), "file": F.col("path")})
    return _hit_sorted(out, "ordinal")


def _hit_sorted(out: DataFrame, index: str) -> DataFrame:
    return _hit(out.orderBy("org", "repo", "file", F.coalesce("start", F.lit(0)), F.coalesce(index, F.lit(0))))


def _accept(q: Query, x: Column, kind_filter: bool = True) -> Column:
    ok = C.grain_accepts(q.grain, x["kind"], x["lang_kind"])
    return ok & C.kind_matches(x["kind"], x["lang_kind"], q.symbol_kind) if kind_filter and q.symbol_kind is not None else ok


def _symbol_hits(g: Graph, q: Query, matches: DataFrame) -> DataFrame:
    # all matches with the same enclosing symbol share their fate
    groups = matches.groupBy(*FILE_KEY, "parent_sidx").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    chains = g.symbols.select(*FILE_KEY, F.col("sidx").alias("parent_sidx"), "chain", "language")
    rows = groups.join(chains, [*FILE_KEY, "parent_sidx"], "left").withColumn("chain", F.coalesce("chain", F.array().cast(S.CHAIN)))
    rows = rows.withColumn("picked", F.try_element_at(F.filter("chain", lambda x: _accept(q, x)), F.lit(1))["sidx"]).withColumn("row_path", F.col("path"))
    if q.grain == "class":
        rows = _follow_owners(g, q, rows)
    has = g.symbols.select(*FILE_KEY).distinct().withColumn("has_symbols", F.lit(True))
    rows = rows.join(has, FILE_KEY, "left")
    rows = rows.withColumn("no_symbols", F.col("picked").isNull() & F.col("has_symbols").isNull()).withColumn("no_matching_symbol", F.col("picked").isNull() & F.col("has_symbols").isNotNull())
    rows = rows.groupBy("org", "repo", F.col("row_path").alias("path"), "picked", "no_symbols", "no_matching_symbol").agg(F.sum("count").alias("count"))
    found = g.symbols.select(*FILE_KEY, F.col("sidx").alias("picked"), "name", F.col("qualified").alias("symbol"), F.col("kind").alias("symbol_kind"), "lang_kind", *S.SPAN)
    rows = rows.join(found, [*FILE_KEY, "picked"], "left")
    page = _page(rows, [*FILE_KEY, F.coalesce("start", F.lit(0)), F.coalesce("picked", F.lit(0))], q.limit, q.offset)
    page = with_name_position(g, page).join(_file_columns(g), FILE_KEY).withColumn("file", F.col("path"))
    return _hit_sorted(page, "picked")


def _follow_owners(g: Graph, q: Query, rows: DataFrame) -> DataFrame:
    """Class grain without a type around: the innermost owner hint that resolves.

    In the same file the kind filter comes first, then the first by index; a
    type of that name that only the filter rejects ends this hint.  Else among
    the other files of the directory in the same language the first by (path,
    index) is chosen, and then must pass the filter.
    """
    types = g.symbols.where(C.grain_accepts("class", F.col("kind"), F.col("lang_kind"))).select(*FILE_KEY, F.col("name").alias("owner"), "sidx", "dir", "language", "kind", "lang_kind")
    types = types.withColumn("ok", C.kind_matches(F.col("kind"), F.col("lang_kind"), q.symbol_kind) if q.symbol_kind is not None else F.lit(True))
    here = types.groupBy(*FILE_KEY, "owner").agg(F.min(F.when(F.col("ok"), F.col("sidx"))).alias("own"), F.lit(True).alias("any"))
    # each distinct owner of a directory is resolved once, for any file of it: to the first file, or if that's one's own the second
    first = Win.partitionBy("org", "repo", "dir", "language", "owner").orderBy("sib", "sidx")
    per_file = types.groupBy("org", "repo", "dir", "language", "owner", F.col("path").alias("sib")).agg(F.min_by(F.struct("sidx", "ok"), "sidx").alias("t"))
    near = per_file.select("org", "repo", "dir", "language", "owner", "sib", F.col("t.sidx").alias("sidx"), F.col("t.ok").alias("sib_ok"))
    near = near.withColumn("nth", F.row_number().over(first)).where("nth <= 2")
    # one pass over the rows: a line for each hint (one without, where there is none), brought together again by row
    lost = F.col("picked").isNull() & ~F.exists("chain", lambda x: _accept(q, x, kind_filter=False))
    hints = F.filter(F.transform("chain", lambda x, i: F.struct(i.alias("at"), x["owner"].alias("owner"))), lambda h: h["owner"].isNotNull())
    own_key = [*FILE_KEY, "parent_sidx", "count", "picked"]
    each = rows.select(*own_key, "language", C.directory(F.col("path")).alias("dir"), F.explode_outer(F.when(lost, hints)).alias("hint")).select("*", "hint.at", "hint.owner").drop("hint")
    each = each.join(here, [*FILE_KEY, "owner"], "left").join(near, ["org", "repo", "dir", "language", "owner"], "left")
    sibling = F.min(F.when(F.col("sib") != F.col("path"), F.struct("nth", F.col("sib").alias("to"), "sidx", "sib_ok")))
    each = each.groupBy(*own_key, "at").agg(F.first("own").alias("own"), F.first("any").alias("any"), sibling.alias("s"))
    use_sibling = F.col("own").isNull() & F.col("any").isNull() & F.coalesce(F.col("s.sib_ok"), F.lit(False))
    target = F.when(F.col("own").isNotNull(), F.struct(F.col("path").alias("to"), F.col("own").alias("sidx"))).when(use_sibling, F.struct(F.col("s.to").alias("to"), F.col("s.sidx").alias("sidx")))
    out = each.withColumn("target", target).groupBy(*own_key).agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("at"))).alias("target"))
    return out.withColumn("picked", F.coalesce("picked", F.col("target.sidx"))).withColumn("row_path", F.coalesce(F.col("target.to"), "path")).drop("target")


def with_name_position(g: Graph, rows: DataFrame) -> DataFrame:
    """Adds name_byte, name_line, name_col: the first identifier inside the span that equals the name, else its start.

    rows has the file key, name and the span; it should be small already (after the limit).
    """
    index = "picked" if "picked" in rows.columns else "sidx"
    t = g.tokens.where(F.col("class") == "identifier").select(*FILE_KEY, F.col("text").alias("name"), F.col("start").alias("t_start"), F.struct(F.col("start").alias("b"), F.col("start_line").alias("l"), F.col("start_col").alias("c")).alias("pos"))
    wanted = rows.where(F.col("name").isNotNull()).select(*FILE_KEY, "name", index, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    inside = wanted.join(t, [*FILE_KEY, "name"]).where((F.col("t_start") >= F.col("s_start")) & (F.col("t_start") < F.col("s_end")))
    first = inside.groupBy(*FILE_KEY, index).agg(F.min_by("pos", "t_start").alias("pos"))
    out = rows.join(first, [*FILE_KEY, index], "left")
    return out.withColumns({"name_byte": F.coalesce("pos.b", "start"), "name_line": F.coalesce("pos.l", "start_line"), "name_col": F.coalesce("pos.c", "start_col")}).drop("pos")


@dataclass(frozen=True)
class SymbolQuery:
    pattern: str
    kind: str | None = None
    language: str | None = None
    org: str | None = None
    repo: str | None = None
    file: str | None = None
    limit: int | None = None
    offset: int = 0
    exact_case: bool = False

    def __post_init__(self):
        for name in ("kind", "language", "org", "repo", "file"):
            if getattr(self, name) == "":
                raise ValueError(f"the {name} filter is empty")
        parse(self.pattern)


def search_symbols(g: Graph, q: SymbolQuery) -> DataFrame:
    """Definitions in the order (org, repo, file, start, qualified, index), after offset and limit."""
    p = parse(q.pattern)
    rows = _filtered(g.symbols, q)
    if not (p.how == "prefix" and not p.text):
        rows = rows.where(p.on(F.col("name")) if q.exact_case else p.folded().on(F.col("name_fold")))
    if q.file is not None:
        rows = rows.where(F.col("path") == C.normalize_path(F.lit(q.file)))
    if q.kind is not None:
        rows = rows.where(C.kind_matches(F.col("kind"), F.col("lang_kind"), q.kind))
    order = [*FILE_KEY, "start", "qualified", "sidx"]
    page = with_name_position(g, _page(rows, order, q.limit, q.offset))
    page = page.join(g.files.select(*FILE_KEY, "encoding", "lossy"), FILE_KEY).orderBy(*order)
    return page.withColumn("file", F.col("path")).select(*S.SYMBOL_HIT.names)
