"""Tree operators over the node table of :func:`plans.graph.nodes`.

Keys name the containers, so ancestors, descendants and their order need no
recursion: a file's nodes share its key columns, and inside a file spans nest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.graph import FILE_KEY, Graph


def pre_order() -> tuple:
    """Pre-order inside and across files."""
    return (F.col("org"), F.col("repo").asc_nulls_first(), F.col("path").asc_nulls_first(), F.coalesce("start", F.lit(-1)), F.when(F.col("kind") == "token", 1).otherwise(0), F.desc("end"), F.col("seq"), F.col("key"))


@dataclass(frozen=True)
class Place:
    """What a key says of its node: conditions on base columns, which reach the scans, with the key itself as the last word.

    Names may hold slashes, so where the organisation ends is left open: any prefix of the rest may be its name.
    """

    kind: str
    index: int | None
    parts: tuple[str, ...]

    @classmethod
    def of(cls, key: str) -> Place:
        kind, _, rest = key.partition("/")
        index = None
        if kind in ("symbol", "token"):
            number, _, rest = rest.partition("@")
            index = int(number) if number.isdigit() else -1
        return cls(kind, index, tuple(rest.split("/")))

    def container(self) -> Column:
        """The condition that a row's organisation and file are the key's."""
        n = len(self.parts)
        if self.kind == "org":
            return F.col("org") == "/".join(self.parts)
        orgs = ["/".join(self.parts[:i]) for i in range(1, n)]
        where = F.col("org").isin(orgs or [""])
        if self.kind == "repo":
            return where & F.col("repo").isin(["/".join(self.parts[i:]) for i in range(1, n)] or [""])
        return where & F.col("path").isin(["/".join(self.parts[i:]) for i in range(2, n)] or [""])


def node(nodes: DataFrame, key: str) -> DataFrame:
    p = Place.of(key)
    return nodes.where((F.col("kind") == p.kind) & p.container() & (F.col("key") == key))


def parent(nodes: DataFrame, key: str) -> DataFrame:
    """The node above; its key is fetched first, so that finding it is a look-up too."""
    up = node(nodes, key).select("parent").first()
    return node(nodes, up[0]) if up and up[0] else nodes.limit(0)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "org").orderBy("seq", "name")


def page(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def page_with_more(df: DataFrame, limit: int, offset: int = 0) -> tuple[list, bool]:
    """The rows of a page, and whether there are more; reads one row beyond the page."""
    rows = page(df, offset, limit + 1).collect()
    return rows[:limit], len(rows) > limit


def children(nodes: DataFrame, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Direct children: repositories and files by first appearance, what a file holds in source order."""
    p = Place.of(key)
    below = nodes.where(F.col("kind").isin(*S.CONTAINS.get(p.kind, ()) or [""]) & p.container() & (F.col("parent") == key))
    return page(below.orderBy("seq", F.desc("end"), "name", "key"), offset, limit)


def descendants(nodes: DataFrame, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Everything below a node in depth-first source order; the node itself is fetched first, what is below it by conditions on columns."""
    top = node(nodes, key).first()
    if top is None or top["kind"] == "token":
        return nodes.limit(0)
    below = F.col("org") == top["org"]
    if top["kind"] == "org":
        below = below & (F.col("kind") != "org")
    else:
        below = below & (F.col("repo") == top["repo"])
        if top["kind"] == "repo":
            below = below & F.col("kind").isin("file", "symbol", "token")
        else:
            below = below & (F.col("path") == top["path"]) & F.col("kind").isin("symbol", "token")
    if top["kind"] == "symbol":
        start, end = F.col("start"), F.col("end")
        deeper = (F.col("kind") == "token") | (start > top["start"]) | (end < top["end"]) | (F.col("key") > key)
        below = below & (start >= top["start"]) & (start < top["end"]) & deeper & (F.col("key") != key)
    return page(nodes.where(below).orderBy(*pre_order()), offset, limit)


def tokens_of(g: Graph, org: str, repo: str, path: str, sidx: int) -> DataFrame:
    """A symbol's tokens by the range of ordinals that it keeps: a range read of one file, no walk over the tree."""
    one = lambda df: df.where((F.col("org") == org) & (F.col("repo") == repo) & (F.col("path") == path))
    at = one(g.symbols).where(F.col("sidx") == sidx).select("first_tok", "last_tok").first()
    if at is None or at[0] is None:
        return g.tokens.limit(0)
    return one(g.tokens).where(F.col("ordinal").between(at[0], at[1])).orderBy("ordinal")


def ancestors(g: Graph, kind: str, org: str, repo: str | None = None, path: str | None = None, index: int | None = None) -> DataFrame:
    """(depth, kind, name) above a node, nearest first, up to the organisation; from the stored chain."""
    at = {"org": org, "repo": repo, "path": path}
    above = []
    if kind in ("symbol", "token"):
        here = F.lit(True)
        for c in FILE_KEY:
            here = here & (F.col(c) == at[c])
        if kind == "token":
            own = g.tokens.where(here & (F.col("ordinal") == index)).select("parent_sidx")
            chain = g.symbols.where(here).join(own, F.col("sidx") == own.parent_sidx, "left_semi").select("chain")
        else:
            chain = g.symbols.where(here & (F.col("sidx") == index)).select(F.slice("chain", 2, 1_000_000).alias("chain"))
        above.append(chain.select(F.posexplode("chain").alias("depth", "s")).select("depth", F.lit("symbol").alias("kind"), F.col("s.name").alias("name")))
    names = {"repo": [org], "file": [repo, org]}.get(kind, [path, repo, org] if kind in ("symbol", "token") else [])
    kinds = ["file", "repo", "org"][3 - len(names) :]
    exists = g.files.where(F.col("org") == org)
    fixed = exists.limit(1).select(F.explode(F.array(*(F.struct(F.lit(1_000_000 + i).alias("depth"), F.lit(k).alias("kind"), F.lit(n).alias("name")) for i, (k, n) in enumerate(zip(kinds, names, strict=True))))).alias("s")).select("s.*") if names else None
    out = above[0] if above else None
    if fixed is not None:
        out = fixed if out is None else out.unionByName(fixed)
    return out.orderBy("depth") if out is not None else exists.limit(0).select(F.lit(0).alias("depth"), F.lit("").alias("kind"), F.lit("").alias("name"))


def cycles(nodes: DataFrame, most: int = 64) -> DataFrame:
    """Nodes whose parent chain doesn't end at an organisation within ``most`` steps (a damaged table)."""
    parents = nodes.select("key", "parent")
    now = parents.where("parent is not null").select(F.col("key").alias("node"), F.col("parent").alias("at"))
    for _ in range(max(1, most.bit_length())):
        # doubling: at becomes the parent of the parent's chain end
        up = now.select(F.col("node").alias("at"), F.col("at").alias("next"))
        now = now.join(up, "at", "left").select("node", F.coalesce("next", "at").alias("at"))
    ends = nodes.where("kind = 'org'").select(F.col("key").alias("at"))
    return now.join(ends, "at", "left_anti")
