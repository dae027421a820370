"""Row-level read scopes and a subset of a policy language that compiles to them.

A scope is a list of rule sets; a repository is visible where every set allows
it.  Filters are pushed below ranking and limits: :func:`scoped` restricts the
graph's tables, and every operator then works on the restricted graph.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.graph import Graph


class PermissionDenied(Exception):
    """Names the action only, never the resource."""


@dataclass(frozen=True)
class Rules:
    any: bool = False
    orgs: frozenset = frozenset()
    repos: frozenset = frozenset()
    org_only: frozenset = frozenset()
    deny_all: bool = False
    deny_orgs: frozenset = frozenset()
    deny_repos: frozenset = frozenset()
    deny_org_only: frozenset = frozenset()

    def visible(self) -> Column:
        """A condition on org and repo; sets of a few names become literals, so partitions are pruned."""
        pairs = lambda s: F.struct("org", "repo").isin([F.struct(F.lit(o).alias("org"), F.lit(r).alias("repo")) for o, r in sorted(s)]) if s else F.lit(False)
        names = lambda s: F.col("org").isin(*sorted(s)) if s else F.lit(False)
        return (F.lit(self.any) | names(self.orgs) | pairs(self.repos)) & ~(F.lit(self.deny_all) | names(self.deny_orgs) | pairs(self.deny_repos))

    def org_granted(self, org: str) -> bool:
        allowed = self.any or org in self.orgs or org in self.org_only
        return allowed and not (self.deny_all or org in self.deny_orgs or org in self.deny_org_only)


@dataclass(frozen=True)
class Scope:
    """No rule sets: everything is visible."""

    rules: tuple[Rules, ...] = ()

    def visible(self) -> Column:
        out = F.lit(True)
        for r in self.rules:
            out = out & r.visible()
        return out

    def intersect(self, other: Scope) -> Scope:
        return Scope(tuple(dict.fromkeys((*self.rules, *other.rules))))

    def check_named(self, g: Graph, action: str, org: str | None = None, repo: str | None = None) -> None:
        """Raises if what is named exists and none of it is visible; missing names just find nothing."""
        if not self.rules or (org is None and repo is None):
            return
        there = g.files.select("org", "repo").distinct()
        if org is not None:
            there = there.where(F.col("org") == org)
        if repo is not None:
            there = there.where(F.col("repo") == repo)
        if not there.take(1) or there.where(self.visible()).take(1):
            return
        if org is not None and repo is None and all(r.org_granted(org) for r in self.rules):
            return
        raise PermissionDenied(f"permission denied for {action}")


NOTHING = Scope((Rules(),))


def scoped(g: Graph, scope: Scope) -> Graph:
    return g.only(scope.visible()) if scope.rules else g


@dataclass(frozen=True)
class Policy:
    permit: bool
    principal: tuple[str, str, str] | None  # (operator, type, name); None: anyone
    actions: frozenset | None  # None: any
    resource: tuple[str, str, str] | None
    id: str | None = None


_POLICY = re.compile(r"""(?:@id\("(?P<id>[^"]*)"\)\s*)?(?P<effect>permit|forbid)\s*\((?P<body>[^;]*)\)\s*;""", re.S)
_ENTITY = re.compile(r'(principal|resource)\s*(==|in)\s*(\w+)::"([^"]*)"')
_ACTION = re.compile(r'Action::"([^"]*)"')
_CLAUSE = re.compile(r'\s*principal(?:\s*(?:==|in)\s*\w+::"[^"]*")?\s*,\s*action(?:\s*(?:==\s*Action::"[^"]*"|in\s*\[\s*(?:Action::"[^"]*"\s*,?\s*)*\]))?\s*,\s*resource(?:\s*(?:==|in)\s*\w+::"[^"]*")?\s*', re.S)


def parse_policies(text: str) -> list[Policy]:
    """permit/forbid (principal ..., action ..., resource ...); without conditions. Anything else is an error."""
    plain = re.sub(r"//[^\n]*", "", text)
    out, at = [], 0
    for m in _POLICY.finditer(plain):
        if plain[at : m.start()].strip() or not _CLAUSE.fullmatch(m["body"]):
            raise ValueError(f"policy not understood near: {plain[at : m.end()].strip()[:80]!r}")
        at = m.end()
        entities = {k: (op, kind, name) for k, op, kind, name in _ENTITY.findall(m["body"])}
        action = m["body"].split("resource")[0].split("action", 1)[1]
        names = _ACTION.findall(action)
        out.append(Policy(m["effect"] == "permit", entities.get("principal"), frozenset(names) if names or "[" in action else None, entities.get("resource"), m["id"]))
    if plain[at:].strip():
        raise ValueError(f"policy not understood near: {plain[at:].strip()[:80]!r}")
    return out


@dataclass(frozen=True)
class Principal:
    token: str
    groups: frozenset = field(default_factory=frozenset)
    role: str | None = None

    def matches(self, p: Policy) -> bool:
        if p.principal is None:
            return True
        op, kind, name = p.principal
        if kind == "Token":
            return name == self.token
        return op == "in" and (kind == "Group" and name in self.groups or kind == "Role" and name == self.role)


#: The cluster that every organisation belongs to.
CLUSTER = ("Cluster", "this")


def _ancestry(kind: str, name: str) -> set[tuple[str, str]]:
    up = {(kind, name)}
    if kind == "Repo":
        up.add(("Org", name.split("/", 1)[0]))
    if kind in ("Repo", "Org"):
        up.add(CLUSTER)
    return up


def decide(policies: list[Policy], who: Principal, action: str, kind: str, name: str) -> bool:
    """Whether the request is allowed: some permit and no forbid applies."""
    def applies(p: Policy) -> bool:
        if not who.matches(p) or (p.actions is not None and action not in p.actions):
            return False
        if p.resource is None:
            return True
        op, k, n = p.resource
        return (k, n) == (kind, name) if op == "==" else (k, n) in _ancestry(kind, name)

    own = [p for p in policies if applies(p)]
    return any(p.permit for p in own) and all(p.permit for p in own)


def compile_scope(policies: list[Policy], who: Principal, action: str) -> Scope:
    """The policies that concern a principal and an action as one rule set."""
    own = [p for p in policies if who.matches(p) and (p.actions is None or action in p.actions)]

    def names(permit: bool, op: str | None, kind: str) -> frozenset:
        return frozenset(p.resource[2] for p in own if p.permit == permit and p.resource and p.resource[1] == kind and (op is None or p.resource[0] == op))

    everything = lambda permit: any(p.permit == permit and (p.resource is None or (p.resource[0] == "in" and p.resource[1] == "Cluster")) for p in own)
    split = lambda s: frozenset(tuple(x.split("/", 1)) for x in s)
    rules = Rules(any=everything(True), orgs=names(True, "in", "Org"), org_only=names(True, "==", "Org"), repos=split(names(True, None, "Repo")), deny_all=everything(False), deny_orgs=names(False, "in", "Org"), deny_org_only=names(False, "==", "Org"), deny_repos=split(names(False, None, "Repo")))
    return Scope() if rules == Rules(any=True) else Scope((rules,))


def lint(policies: list[Policy]) -> list[str]:
    """Notes on policies that can't have an effect or repeat an id."""
    out, seen = [], set()
    for n, p in enumerate(policies):
        name = p.id or f"#{n}"
        if p.id in seen:
            out.append(f"{name}: the id is used twice")
        seen.add(p.id) if p.id else None
        if p.actions is not None and not p.actions:
            out.append(f"{name}: names no action")
        if p.resource and p.resource[1] == "Repo" and "/" not in p.resource[2]:
            out.append(f"{name}: a Repo is named org/repo")
        if p.resource and p.resource[1] not in ("Org", "Repo", "Cluster"):
            out.append(f"{name}: unknown resource type {p.resource[1]}")
    return out
