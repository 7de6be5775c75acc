"""From query text to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import terms as T
from ..functions import values as V
from ..operators.stores import Dataset
from ..solutions import Solutions, anti_join, column_name, distinct, join, left_join, union
from ..terms import DYNAMIC, Bnode, Iri, Literal, Var
from .algebra import BGP, Filter, Graph, Join, LeftJoin, Query, Triple, Union, Unit, in_scope, walk
from .parser import parse


class Unsupported(ValueError):
    """A query that has no plan here."""


@dataclass
class Result:
    """A query's outcome: ``solutions`` of SELECT, ``triples`` of CONSTRUCT and DESCRIBE, ``answer`` of ASK."""

    form: str
    solutions: Solutions | None = None
    triples: DataFrame | None = None
    answer: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        """As term strings; for ASK one row with a boolean."""
        if self.solutions is not None:
            return self.solutions.terms()
        return self.triples if self.triples is not None else self.answer

    @property
    def values(self) -> DataFrame:
        return self.solutions.values() if self.solutions is not None else self.df

    def __bool__(self) -> bool:
        return bool(self.answer.first()[0]) if self.answer is not None else not self.df.isEmpty()


def evaluate(e, s: Solutions) -> V.Value:
    """An expression as a value over the solutions' columns."""
    op = e[0]
    if op == "var":
        return V.of(s.col(e[1]), s.descs[e[1]]) if e[1] in s.descs else V.of(F.lit(None).cast("string"), DYNAMIC)
    if op == "term":
        return V.constant(e[1])
    if op in ("&&", "||"):
        a, b = V.ebv(evaluate(e[1], s)), V.ebv(evaluate(e[2], s))
        return V.truth(a & b if op == "&&" else a | b)
    if op == "not":
        return V.truth(~V.ebv(evaluate(e[1], s)))
    if op in V.OPS:
        return V.truth(V.compare(op, evaluate(e[1], s), evaluate(e[2], s)))
    if op in "+-*/":
        return V.arithmetic(op, evaluate(e[1], s), evaluate(e[2], s))
    if op in ("neg", "pos"):
        return V.arithmetic("-" if op == "neg" else "+", V.constant(Literal("0", T.XSD + "integer")), evaluate(e[1], s))
    name, args = e[1], [evaluate(a, s) for a in e[2]]
    if isinstance(name, Iri):
        if name in V.EXTENSIONS:
            return V.EXTENSIONS[name](*args)
        if V.family(name) and len(args) == 1:
            return V.cast(args[0], str(name))
        raise Unsupported(f"no function {name}")
    return V.FUNCTIONS[name](*args)


def condition(e, s: Solutions) -> Column:
    return V.ebv(evaluate(e, s))


def _conjuncts(e) -> list:
    return [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "&&" else [e]


def _unbound(e) -> str | None:
    """The variable of a ``!bound(?v)``."""
    if e[0] == "not" and e[1][0] == "call" and e[1][1] == "BOUND" and e[1][2][0][0] == "var":
        return e[1][2][0][1]
    return None


class Engine:
    """Queries over one store. ``strict``: without FROM, the default graph is only what is in no named graph."""

    def __init__(self, store, prefixes: dict[str, str] | None = None, base: str = "", strict: bool = False):
        self.store, self.prefixes, self.base, self.strict = store, prefixes or {}, base, strict

    # -- patterns --

    def bgp(self, triples: list[Triple], data: Dataset) -> Solutions:
        """Stars on one subject are one scan where the store can; then the cheapest connected part is
        joined next, again and again."""
        stars: dict[object, list[Triple]] = {}
        for t in triples:
            stars.setdefault(t.s, []).append(t)
        units = [u for own in stars.values() for u in self.store.stars(own, data)]
        cost = [min(self.store.estimate(t) for t in u) for u, _ in units]
        names = [{v for t in u for v in t.variables()} for u, _ in units]
        left = set(range(len(units)))
        out, seen = None, set()
        while left:
            near = [k for k in left if not seen or names[k] & seen] or list(left)
            k = min(near, key=lambda k: (cost[k], k))
            left.remove(k)
            out = units[k][1] if out is None else join(out, units[k][1])
            seen |= names[k]
        return out or Solutions.unit(self.store.spark)

    def lower(self, node, data: Dataset) -> Solutions:
        if isinstance(node, Unit):
            return Solutions.unit(self.store.spark)
        if isinstance(node, BGP):
            return self.bgp(node.triples, data)
        if isinstance(node, Join):
            if isinstance(node.left, BGP) and isinstance(node.right, BGP):
                return self.bgp(node.left.triples + node.right.triples, data)
            return join(self.lower(node.left, data), self.lower(node.right, data))
        if isinstance(node, LeftJoin):
            test = None if node.condition is None else lambda s: condition(node.condition, s)
            return left_join(self.lower(node.left, data), self.lower(node.right, data), test)
        if isinstance(node, Union):
            return union(self.lower(node.left, data), self.lower(node.right, data))
        if isinstance(node, Graph):
            return self.lower(node.body, replace(data, graph=node.name))
        if isinstance(node, Filter):
            return self.filter(node, data)
        raise Unsupported(f"no plan for {node}")

    def filter(self, node: Filter, data: Dataset) -> Solutions:
        parts = _conjuncts(node.condition)
        body = node.body
        if isinstance(body, LeftJoin):
            for k, e in enumerate(parts):
                v = _unbound(e)
                if v and v not in in_scope(body.left) and v in in_scope(body.right):
                    right = self.lower(body.right, data)
                    if v in right.bound:
                        test = None if body.condition is None else lambda s: condition(body.condition, s)
                        out = anti_join(self.lower(body.left, data), right, test)
                        rest = parts[:k] + parts[k + 1 :]
                        return reduce(lambda s, e: s.where(condition(e, s)), rest, out)
        s = self.lower(body, data)
        return s.where(reduce(lambda a, b: a & b, [condition(e, s) for e in parts]))

    # -- queries --

    def query(self, text: str | Query, bindings: dict[str, object] | None = None) -> Result:
        """``bindings``: variables with a constant each, joined with the pattern's solutions."""
        q = parse(text, self.prefixes, self.base) if isinstance(text, str) else text
        data = Dataset(tuple(q.from_) if q.from_ or q.from_named else ("",) if self.strict else None, tuple(q.from_named) if q.from_ or q.from_named else None)
        body = _substituted(q.body, bindings or {})
        s = self.lower(body, data)
        for v, t in (bindings or {}).items():
            s = Solutions(s.df.withColumn(column_name(v), F.lit(T.encode(t))), s.descs | {v: DYNAMIC}, s.bound | {v})
        if q.form == "ASK":
            return Result("ASK", answer=s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer")))
        if q.form == "SELECT":
            names = [str(v) for v in q.select] if q.select is not None else [v for v in dict.fromkeys([*(bindings or {}), *in_scope(q.body)])]
            return Result("SELECT", solutions=self._modified(s, q, names))
        if q.order or q.limit is not None or q.offset:
            s = self._modified(s, replace(q, distinct=False), list(s.descs))
        return Result(q.form, triples=self._construct(s, q.template) if q.form == "CONSTRUCT" else self._describe(s, q, data))

    def _modified(self, s: Solutions, q: Query, names: list[str]) -> Solutions:
        """Order, projection, distinct and slice."""
        keys: list[Column] = []
        for e, up in q.order:
            keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in V.order_key(evaluate(e, s), e[0] == "var" and e[1] in s.bound)]
        used = {str(x[1]) for e, _ in q.order for x in _leaves(e) if x[0] == "var"}
        if not q.distinct:
            if keys:
                s = replace(s, df=s.df.orderBy(*keys))
            s = s.project(names)
        elif used <= set(names):
            s = distinct(s.project(names))
            keys = []
            for e, up in q.order:
                keys += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in V.order_key(evaluate(e, s), e[0] == "var" and e[1] in s.bound)]
            if keys:
                s = replace(s, df=s.df.orderBy(*keys))
        else:  # sorted by what isn't shown: the first of equal rows counts
            w = Window.partitionBy(*[s.col(v) for v in names if v in s.descs]).orderBy(*keys)
            df = s.df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
            s = replace(s, df=df.orderBy(*keys)).project(names)
        if q.offset:
            s = replace(s, df=s.df.offset(q.offset))
        return s if q.limit is None else replace(s, df=s.df.limit(q.limit))

    def _construct(self, s: Solutions, template: list[Triple]) -> DataFrame:
        """The template for each solution, as a set; blank nodes of the template are new for each solution."""
        row = F.sha1(F.concat_ws("\x01", *[F.coalesce(s.term(v), F.lit("")) for v in sorted(s.descs)])) if s.descs else F.lit("0")

        def part(t) -> Column:
            if isinstance(t, Var):
                if t.startswith("_bn_"):
                    return F.concat(F.lit(f"_:{t[4:]}_"), row)
                return s.term(t) if t in s.descs else F.lit(None).cast("string")
            return F.lit(T.encode(t))

        made = F.array(*[F.struct(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).alias("o")) for t in template])
        df = s.df.select(F.explode(made).alias("t")).select("t.s", "t.p", "t.o")
        return df.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~T.is_literal(F.col("s")) & T.is_iri(F.col("p"))).distinct()

    def _describe(self, s: Solutions, q: Query, data: Dataset) -> DataFrame:
        """All statements with a described term as subject or object."""
        names = [t for t in q.describe if isinstance(t, Var)] or ([] if q.describe else [v for v in s.descs if not v.startswith("_bn_")])
        spark = self.store.spark
        parts = [s.df.select(s.term(v).alias("node")) for v in names if v in s.descs]
        if fixed := [T.encode(t) for t in q.describe if not isinstance(t, Var)]:
            parts.append(spark.createDataFrame([(x,) for x in fixed], "node string"))
        if not parts:
            return spark.createDataFrame([], "s string, p string, o string")
        nodes = reduce(DataFrame.union, parts).where("node is not null").distinct()
        triples = self.store.triples(data)
        out = triples.join(nodes, triples.s == nodes.node, "left_semi")
        return out.union(triples.join(nodes, triples.o == nodes.node, "left_semi")).distinct()


def _leaves(e):
    yield e
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str) and not isinstance(x, Literal):
            yield from _leaves(x)
        elif isinstance(x, list):
            for y in x:
                yield from _leaves(y)


def _substituted(node, bindings: dict[str, object]):
    """The pattern with bound variables as constants, so that scans can filter by them."""
    if not bindings:
        return node

    def term(t):
        return bindings.get(t, t) if isinstance(t, Var) else t

    def expr(e):
        if e[0] == "var":
            return ("term", bindings[e[1]]) if e[1] in bindings else e
        if e[0] == "call":
            if e[1] == "BOUND" and e[2][0][1] in bindings:
                return ("term", Literal("true", T.XSD + "boolean"))
            return ("call", e[1], [expr(a) for a in e[2]])
        return e if e[0] == "term" else (e[0], *[expr(a) for a in e[1:]])

    def sub(n):
        if isinstance(n, BGP):
            return BGP([Triple(term(t.s), term(t.p), term(t.o)) for t in n.triples])
        if isinstance(n, Graph):
            return Graph(term(n.name), sub(n.body))
        if isinstance(n, Filter):
            return Filter(expr(n.condition), sub(n.body))
        if isinstance(n, LeftJoin):
            return LeftJoin(sub(n.left), sub(n.right), n.condition and expr(n.condition))
        if isinstance(n, (Join, Union)):
            return type(n)(sub(n.left), sub(n.right))
        return n

    return sub(node)


def match(store, selection: list[str], patterns: list, optionals: list | None = None, bindings: dict | None = None, constraints: list[Callable[[Solutions], Column]] | None = None, per_pattern: dict[int, Callable[[Solutions], Column]] | None = None) -> Solutions:
    """The programmatic form: ``patterns`` is a list of triples, or a list of such lists for their union;
    each list in ``optionals`` is one OPTIONAL. Constraints map solutions to a column; ``per_pattern`` ones
    belong to the pattern with that place."""
    engine = Engine(store)
    groups = patterns if patterns and isinstance(patterns[0], list) else [patterns]
    out = None
    for group in groups:
        if per_pattern:
            s = reduce(join, [x.where(per_pattern[k](x)) if k in per_pattern else x for k, x in enumerate(engine.bgp([t], Dataset()) for t in group)])
        else:
            s = engine.lower(_substituted(BGP(list(group)), bindings or {}), Dataset())
        out = s if out is None else union(out, s)
    for v, t in (bindings or {}).items():
        out = Solutions(out.df.withColumn(column_name(v), F.lit(T.encode(t))), out.descs | {v: DYNAMIC}, out.bound | {v})
    for group in optionals or []:
        out = left_join(out, engine.lower(BGP(list(group)), Dataset()))
    for c in constraints or []:
        out = out.where(c(out))
    return out.project(selection)


def dataset_description(store) -> DataFrame:
    """Each graph with its number of triples."""
    quads = store.quads() if callable(store.quads) else store.quads
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


__all__ = ["Bnode", "Engine", "Result", "Unsupported", "condition", "dataset_description", "evaluate", "match", "walk"]
