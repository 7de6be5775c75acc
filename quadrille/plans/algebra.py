"""The query algebra: what the parser builds and the compiler lowers."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from ..terms import Bnode, Term, Var


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term

    def variables(self) -> list[Var]:
        return [t for t in (self.s, self.p, self.o) if isinstance(t, Var)]


@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Graph:
    name: Term
    body: Any


@dataclass
class Filter:
    condition: Any
    body: Any


@dataclass
class Unit:
    """One solution that binds nothing."""


# Expressions: ("var", name), ("term", term), (operator, ...), ("call", name or Iri, args)
Expr = tuple


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    body: Any
    select: list[Var] | None = None  # None: all variables
    distinct: bool = False
    template: list[Triple] = field(default_factory=list)
    describe: list[Term] = field(default_factory=list)
    from_: list[str] = field(default_factory=list)
    from_named: list[str] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # expression, ascending
    limit: int | None = None
    offset: int = 0


def walk(node):
    """The node and all algebra nodes below it."""
    yield node
    if is_dataclass(node) and not isinstance(node, Triple):
        for f in fields(node):
            x = getattr(node, f.name)
            if is_dataclass(x) and not isinstance(x, Triple):
                yield from walk(x)


def in_scope(node) -> list[str]:
    """Variables that the pattern can bind, in order of appearance; blank nodes of the query text don't show."""
    found: dict[str, None] = {}
    for x in walk(node):
        if isinstance(x, BGP):
            for t in x.triples:
                found.update(dict.fromkeys(v for v in t.variables() if not v.startswith("_bn")))
        elif isinstance(x, Graph) and isinstance(x.name, Var):
            found[x.name] = None
    return list(found)


def features(q: Query) -> dict[str, Any]:
    """What a query uses, without running it."""
    nodes = list(walk(q.body))
    count = lambda kind: sum(isinstance(n, kind) for n in nodes)
    return {
        "form": q.form, "distinct": q.distinct, "limit": q.limit, "offset": q.offset, "order": len(q.order),
        "triples": sum(len(n.triples) for n in nodes if isinstance(n, BGP)),
        "optional": count(LeftJoin), "union": count(Union), "graph": count(Graph), "filter": count(Filter) + sum(isinstance(n, LeftJoin) and n.condition is not None for n in nodes),
        "variables": in_scope(q.body),
    }


def bnode_var(label: str) -> Var:
    """A blank node of a query text is a variable that can't be projected."""
    return Var("_bn_" + label)


__all__ = ["BGP", "Bnode", "Filter", "Graph", "Join", "LeftJoin", "Query", "Triple", "Union", "Unit", "bnode_var", "features", "in_scope", "walk"]
