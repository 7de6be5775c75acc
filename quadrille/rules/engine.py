"""Rules evaluated bottom-up over tables of triples, stratum by stratum, by semi-naive rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T
from ..functions import values as V
from ..operators.closure import transitive_closure
from ..operators.stores import Dataset, QuadStore
from ..plans.algebra import Triple
from ..solutions import Solutions, anti_join, join
from ..storage import Rounds
from ..terms import Iri, Var, encode
from .ast import LOG, MATH, STRING, Atom, Builtin, Rule, distinct_rules

TRIPLE = ["s", "p", "o"]


class NotStratified(ValueError):
    """A rule depends on its own negation."""


class NoFixpoint(RuntimeError):
    """The rounds didn't end."""


def _number(op: str):
    return lambda a, b: V.OPS[op](a.families["num"], b.families["num"]) if "num" in a.families and "num" in b.families else F.lit(None).cast("boolean")


def _text(fn):
    return lambda a, b: fn(a.text, b.text)


#: IRI: fn(subject value, object value) -> condition
PREDICATES: dict[str, Callable[[V.Value, V.Value], Column]] = {
    LOG + "equalTo": lambda a, b: a.term == b.term,
    LOG + "notEqualTo": lambda a, b: a.term != b.term,
    MATH + "equalTo": _number("="),
    MATH + "notEqualTo": _number("!="),
    MATH + "greaterThan": _number(">"),
    MATH + "lessThan": _number("<"),
    MATH + "notLessThan": _number(">="),
    MATH + "notGreaterThan": _number("<="),
    STRING + "greaterThan": _text(lambda a, b: a > b),
    STRING + "lessThan": _text(lambda a, b: a < b),
    STRING + "notGreaterThan": _text(lambda a, b: a <= b),
    STRING + "notLessThan": _text(lambda a, b: a >= b),
    STRING + "contains": _text(F.contains),
    STRING + "containsIgnoringCase": _text(lambda a, b: F.contains(F.lower(a), F.lower(b))),
    STRING + "startsWith": _text(F.startswith),
    STRING + "endsWith": _text(F.endswith),
    STRING + "matches": _text(lambda a, b: F.regexp_like(a, b)),
    STRING + "notMatches": _text(lambda a, b: ~F.regexp_like(a, b)),
    STRING + "equalIgnoringCase": _text(lambda a, b: F.lower(a) == F.lower(b)),
    STRING + "notEqualIgnoringCase": _text(lambda a, b: F.lower(a) != F.lower(b)),
}


def dependencies(rules: list[Rule]) -> list[tuple[str, str, bool]]:
    """(head key, body key, negative) between what is derived; '*' is any predicate."""
    heads = {a.key or "*" for r in rules for a in r.head}
    edges = []
    for r in rules:
        for h in r.head:
            for b in r.body:
                if isinstance(b, Atom):
                    k = b.key or "*"
                    for d in heads:
                        if d == k or k == "*" or d == "*" or (k.startswith("type ") and d == "*"):
                            edges.append((h.key or "*", d, b.negated))
    return edges


def _components(edges: list[tuple[str, str, bool]], keys: list[str]) -> dict[str, int]:
    """For each key its place among the strongly connected components, what it depends on first."""
    below: dict[str, set[str]] = {k: set() for k in keys}
    for h, b, _ in edges:
        below[h].add(b)
    reach = {k: set(v) for k, v in below.items()}
    changed = True
    while changed:
        changed = False
        for k in keys:
            more = set().union(*(reach[x] for x in reach[k])) - reach[k] if reach[k] else set()
            if more:
                reach[k] |= more
                changed = True
    same = {k: frozenset({k} | {x for x in reach[k] if k in reach[x]}) for k in keys}
    depth: dict[frozenset, int] = {}

    def place(c: frozenset) -> int:
        if c not in depth:
            lower = {same[x] for k in c for x in below[k]} - {c}
            depth[c] = 1 + max(map(place, lower), default=-1)
        return depth[c]

    return {k: place(same[k]) for k in keys}


def stratify(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in strata: what a rule needs is complete before it runs, but for what depends on itself."""
    edges = dependencies(rules)
    keys = list(dict.fromkeys(a.key or "*" for r in rules for a in r.head))
    place = _components(edges, keys)
    for h, b, negative in edges:
        if negative and place[h] <= place[b]:
            raise NotStratified("a predicate depends on its own negation")
    of = lambda r: max(place[a.key or "*"] for a in r.head)
    return [own for k in sorted({of(r) for r in rules}) if (own := [r for r in rules if of(r) == k])]


def recursive(stratum: list[Rule]) -> bool:
    """Whether a rule of the stratum can need what another, or itself, derives there."""
    heads = {a.key or "*" for r in stratum for a in r.head}
    return any(isinstance(b, Atom) and (b.key is None or b.key in heads or "*" in heads) for r in stratum for b in r.body)


def chain(stratum: list[Rule]) -> tuple[Rule, str] | None:
    """The one recursive rule of a stratum, if it joins two predicates end to end into one of them, and the side
    on which it recurs: left, right or both."""
    heads = {a.key or "*" for r in stratum for a in r.head}
    own = [r for r in stratum if any(isinstance(b, Atom) and (b.key is None or b.key in heads) for b in r.body)]
    if "*" in heads or len(own) != 1 or len(own[0].head) != 1 or len(own[0].body) != 2:
        return None
    h, (x, y) = own[0].head[0], own[0].body
    if not all(isinstance(a, Atom) and not a.negated and a.key and not isinstance(a.p, Var) and isinstance(a.s, Var) and isinstance(a.o, Var) for a in (h, x, y)):
        return None
    if x.o != y.s and y.o == x.s:
        x, y = y, x
    if x.o != y.s or (h.s, h.o) != (x.s, y.o) or len({x.s, x.o, y.o}) != 3 or (h.key not in (x.key, y.key)) or heads & ({x.key, y.key} - {h.key}):
        return None
    if any(len(r.head) > 1 and any(a.key == h.key for a in r.head) for r in stratum):
        return None
    return own[0], "both" if x.key == y.key else "left" if x.key == h.key else "right"


def skolem(rule: Rule, var: str, frontier: list[str], s: Solutions) -> Column:
    """One node per rule, variable and values of what head and body share."""
    tag = hashlib.sha1(f"{rule.canonical()}|{var}".encode()).hexdigest()[:12]
    return F.concat(F.lit(f"_:sk_{tag}_"), F.sha1(F.concat_ws("\x01", *[s.term(v) for v in frontier])) if frontier else F.lit("0"))


@dataclass
class Inference:
    """``derived``: new triples, with ``rule`` and ``premises`` where asked for; ``known``: facts and these."""

    derived: DataFrame
    known: DataFrame
    rounds: int
    firings: dict[str, int] = field(default_factory=dict)


class Engine:
    """``builtins``: further built-in predicates, as in PREDICATES. ``provenance`` keeps for each triple one
    rule and the triples that it fired on."""

    def __init__(self, rules: list[Rule], builtins: dict[str, Callable] | None = None, provenance: bool = False, limit: int = 1000):
        self.rules = distinct_rules(rules)
        self.strata = stratify(self.rules)
        self.builtins = PREDICATES | (builtins or {})
        self.provenance, self.limit = provenance, limit
        self.columns = TRIPLE + (["rule", "premises"] if provenance else [])

    def _scan(self, a: Atom, triples: DataFrame) -> Solutions:
        return QuadStore(triples.select(*TRIPLE, F.lit("").alias("g")), many_graphs=False).scan(Triple(a.s, a.p, a.o), Dataset())

    def body(self, rule: Rule, known: DataFrame, new: DataFrame | None, at: int | None) -> Solutions:
        """Solutions of a rule's body; the atom at place ``at`` takes new triples only."""
        atoms = [(k, b) for k, b in enumerate(rule.body) if isinstance(b, Atom) and not b.negated]
        tests = [b for b in rule.body if not (isinstance(b, Atom) and not b.negated)]
        order = sorted(atoms, key=lambda x: x[0] != at)
        out, left = None, list(order)
        while left:
            near = next((x for x in left if out is None or set(x[1].variables()) & set(out.descs)), left[0])
            left.remove(near)
            s = self._scan(near[1], new if near[0] == at else known)
            out = s if out is None else join(out, s)
            ready = [t for t in tests if set(t.variables()) <= set(out.descs) and isinstance(t, Builtin)]
            for t in ready:
                tests.remove(t)
                out = out.where(self._test(t, out))
        if out is None:
            out = Solutions.unit(known.sparkSession)
        for t in tests:
            out = anti_join(out, self._scan(Atom(t.s, t.p, t.o), known)) if isinstance(t, Atom) else out.where(self._test(t, out))
        return out

    def _test(self, b: Builtin, s: Solutions) -> Column:
        value = lambda t: V.of(s.col(t), s.descs[t]) if isinstance(t, Var) else V.constant(t)
        return self.builtins[b.op](value(b.left), value(b.right))

    def fire(self, rule: Rule, s: Solutions) -> DataFrame:
        """The head's triples for each solution."""
        made = rule.existentials()
        frontier = [v for v in dict.fromkeys(v for a in rule.head for v in a.variables()) if v not in made]

        def part(t) -> Column:
            if isinstance(t, Var):
                return skolem(rule, t, frontier, s) if t in made else s.term(t)
            return F.lit(encode(t))

        def triple(a: Atom) -> Column:
            return F.struct(part(a.s).alias("s"), part(a.p).alias("p"), part(a.o).alias("o"))

        df = s.df.select(F.explode(F.array(*[triple(a) for a in rule.head])).alias("t"), *self._proof(rule, s, triple))
        out = df.select("t.s", "t.p", "t.o", *(["rule", "premises"] if self.provenance else []))
        return out.where(~T.is_literal(F.col("s")) & T.is_iri(F.col("p")))

    def _proof(self, rule: Rule, s: Solutions, triple) -> list[Column]:
        if not self.provenance:
            return []
        atoms = [triple(b) for b in rule.body if isinstance(b, Atom) and not b.negated]
        return [F.lit(rule.name or str(rule)).alias("rule"), (F.array(*atoms) if atoms else F.array().cast("array<struct<s:string,p:string,o:string>>")).alias("premises")]

    def _once(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*TRIPLE).agg(F.min(F.struct("rule", "premises")).alias("x")).select(*TRIPLE, "x.rule", "x.premises") if self.provenance else df.distinct()

    def run(self, facts: DataFrame, added: DataFrame | None = None) -> Inference:
        """The least model. ``facts`` (s, p, o); with ``added``, facts is taken as closed already and only
        what follows with the added triples is derived, which negation forbids."""
        if added is not None and any(isinstance(b, Atom) and b.negated for r in self.rules for b in r.body):
            raise NotStratified("rules with negation can't be continued, only run again")
        facts = facts.select(*TRIPLE)
        spark = facts.sparkSession
        start = Rounds(spark, "facts")
        if added is None:
            base, _ = start.add(facts.distinct())
        else:  # what is closed stays where it is
            added, _ = start.add(added.select(*TRIPLE).distinct().join(facts, TRIPLE, "left_anti"))
            base = facts.unionByName(added)
        derived = Rounds(spark, "derived")
        rounds, firings = 0, {}

        def known() -> DataFrame:
            return base if not derived.parts else base.unionByName(derived.all().select(*TRIPLE))

        for stratum in self.strata:
            new = added
            if added is not None and derived.parts:
                new = added.unionByName(derived.all().select(*TRIPLE))
            linked = chain(stratum) if added is None and not self.provenance else None
            plain = [r for r in stratum if linked is None or r is not linked[0]]
            again = recursive(plain)
            heads = {a.key or "*" for r in stratum for a in r.head}
            changed: set[str] | None = None  # the keys that new triples can have; None is any
            while plain:
                rounds += 1
                if rounds > self.limit:
                    raise NoFixpoint(f"no fixpoint after {self.limit} rounds")
                if new is None:
                    plans = [(r, None) for r in plain]
                else:
                    plans = [(r, k) for r in plain for k, b in enumerate(r.body) if isinstance(b, Atom) and not b.negated and (b.key is None or changed is None or b.key in changed or "*" in changed)]
                if not plans:
                    break
                now = known()
                parts = [self.fire(r, self.body(r, now, new, k)) for r, k in plans]
                found = self._new(self._once(reduce(DataFrame.unionByName, parts)), now, stratum)
                step, n = derived.add(found)
                if n and self.provenance:
                    for r in step.groupBy("rule").count().collect():
                        firings[r["rule"]] = firings.get(r["rule"], 0) + r["count"]
                if not n or not again:
                    break
                new, changed = step.select(*TRIPLE), heads
            if linked is not None:
                rounds += 1
                derived.add(self._new(self._doubled(*linked, known()), known(), stratum))
        schema = "s string, p string, o string" + (", rule string, premises array<struct<s:string,p:string,o:string>>" if self.provenance else "")
        out = derived.all() if derived.parts else spark.createDataFrame([], schema)
        return Inference(out, base.unionByName(out.select(*TRIPLE)), rounds, firings)

    def _new(self, found: DataFrame, now: DataFrame, stratum: list[Rule]) -> DataFrame:
        """What isn't known yet; only triples with the predicates that the stratum derives are looked at."""
        predicates = {a.p for r in stratum for a in r.head}
        if not any(isinstance(p, Var) for p in predicates):
            now = now.where(F.col("p").isin(sorted(encode(p) for p in predicates)))
        return found.join(now, TRIPLE, "left_anti").select(*self.columns)

    @staticmethod
    def _doubled(rule: Rule, side: str, known: DataFrame) -> DataFrame:
        """All that a chain rule derives: the closure of the step, which doubles its reach each round, before or
        after what the head's predicate has already."""
        head = rule.head[0]
        x, y = rule.body if rule.body[0].o == rule.body[1].s and rule.body[0].s == head.s else reversed(rule.body)
        step = y if side == "left" else x
        pairs = lambda a: known.where(F.col("p") == encode(a.p)).select(F.col("s").alias("a"), F.col("o").alias("b"))
        reach = transitive_closure(pairs(step))
        if side == "both":
            out = reach
        else:
            base = pairs(head)
            first, then = (base, reach) if side == "left" else (reach, base)
            out = first.alias("x").join(then.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").distinct()
        triples = out.select(F.col("a").alias("s"), F.lit(encode(head.p)).alias("p"), F.col("b").alias("o"))
        return triples.where(~T.is_literal(F.col("s")))


def closure(facts: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """Facts and all that follows, as a table of triples."""
    return Engine(rules, **options).run(facts).known


def proof(inference: Inference, s, p, o) -> dict | None:
    """How a triple came about, as nested dictionaries down to facts; looks up one level of premises at a time,
    until none is left. Steps already seen aren't looked up again, which ends cycles."""
    goal = tuple(encode(t) for t in (s, p, o))
    steps: dict[tuple, tuple] = {}
    wanted = {goal}
    while wanted:
        ask = inference.derived.sparkSession.createDataFrame(sorted(wanted), "s string, p string, o string")
        found = inference.derived.join(F.broadcast(ask), TRIPLE).collect()
        for r in found:
            steps[(r["s"], r["p"], r["o"])] = (r["rule"], [tuple(x) for x in r["premises"]])
        wanted = {x for r in found for x in map(tuple, r["premises"])} - set(steps)
    if goal not in steps and not inference.known.where((F.col("s") == goal[0]) & (F.col("p") == goal[1]) & (F.col("o") == goal[2])).limit(1).count():
        return None

    tree = {"triple": goal}
    left = [(tree, frozenset())]  # no recursion, since proofs may be deeper than Python's stack
    while left:
        node, above = left.pop()
        t = node["triple"]
        if t in steps and t not in above:
            node["rule"], premises = steps[t]
            node["premises"] = [{"triple": x} for x in premises]
            left += [(x, above | {t}) for x in node["premises"]]
    return tree


__all__ = ["Engine", "Inference", "Iri", "NoFixpoint", "NotStratified", "closure", "dependencies", "proof", "skolem", "stratify"]
