"""Goal-directed rewriting: only what can contribute to a goal is derived."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import reachable
from ..terms import TYPE, Iri, Var, encode
from .ast import Atom, Builtin, Rule
from .engine import Engine, chain, stratify

MAGIC = "urn:magic:"


def derived_keys(rules: list[Rule]) -> set[str]:
    return {a.key for r in rules for a in r.head if a.key}


def split_mixed(rules: list[Rule], stored: set[str]) -> tuple[list[Rule], dict[str, str]]:
    """Predicates that are both stored and derived: stored triples are read under another name by a rule each."""
    renamed = {k: k + "_ext" for k in derived_keys(rules) if k in stored and not k.startswith("type ")}
    x, y = Var("x"), Var("y")
    bridge = [Rule((Atom(x, Iri(k), y),), (Atom(x, Iri(n), y),), f"stored {k}") for k, n in renamed.items()]
    return rules + bridge, renamed


def adornment(a: Atom, bound: set[str]) -> str:
    """b or f for the subject and, unless the class is constant, the object."""
    args = [a.s] if a.p == TYPE and not isinstance(a.o, Var) else [a.s, a.o]
    return "".join("b" if not isinstance(t, Var) or t in bound else "f" for t in args)


def _magic(a: Atom, pattern: str) -> Atom | None:
    """The atom that asks for the bound arguments."""
    name = Iri(MAGIC + pattern + ":" + (a.key or ""))
    args = [t for t, b in zip((a.s, a.o), pattern) if b == "b"]
    if not args:
        return Atom(Iri(MAGIC + "goal"), Iri(TYPE), name)
    return Atom(args[0], Iri(TYPE), name) if len(args) == 1 else Atom(args[0], name, args[1])


def sideways(rule: Rule, pattern: str) -> list:
    """The body in an order that passes bindings on: atoms with more bound arguments first, then as written;
    tests as soon as they are bound."""
    head = rule.head[0]
    args = [head.s] if head.p == TYPE and not isinstance(head.o, Var) else [head.s, head.o]
    bound = {t for t, b in zip(args, pattern) if b == "b" and isinstance(t, Var)}
    left, out = list(rule.body), []
    while left:
        ready = [b for b in left if isinstance(b, Builtin) and set(b.variables()) <= bound]
        ready += [b for b in left if isinstance(b, Atom) and b.negated and set(b.variables()) <= bound]
        if not ready:
            atoms = [b for b in left if isinstance(b, Atom) and not b.negated] or left
            ready = [max(atoms, key=lambda b: (sum(not isinstance(t, Var) or t in bound for t in (b.s, b.o)) if isinstance(b, Atom) else 0, -left.index(b)))]
        b = ready[0]
        left.remove(b)
        out.append(b)
        bound |= set(b.variables())
    return out


def transform(rules: list[Rule], goals: list[Atom]) -> tuple[list[Rule], list[Atom]]:
    """Rules and seed facts that derive the goals' answers. Existential heads, negated derived atoms and
    variable predicates keep the full rules of what they need."""
    rules = [replace(r, head=(h,)) for r in rules for h in r.head] if not any(r.existentials() and len(r.head) > 1 for r in rules) else rules
    derived = derived_keys(rules)
    if any(len(r.head) > 1 or r.head[0].key is None or any(isinstance(b, Atom) and (b.key is None or (b.negated and b.key in derived)) for b in r.body) for r in rules):
        return rules, []
    out: list[Rule] = []
    seeds = []
    todo: list[tuple[str, str]] = []
    seen: set[tuple[str, str]] = set()
    for g in goals:
        pattern = adornment(g, set())
        m = _magic(g, pattern)
        seeds.append(m)
        todo.append((g.key, pattern))
    while todo:
        key, pattern = todo.pop()
        if (key, pattern) in seen:
            continue
        seen.add((key, pattern))
        for r in rules:
            if r.head[0].key != key:
                continue
            guard = _magic(r.head[0], pattern)
            body = sideways(r, pattern)
            bound = {v for v in guard.variables()}
            done: list = [guard]
            for b in body:
                if isinstance(b, Atom) and b.key in derived:
                    p = adornment(b, bound)
                    ask = _magic(b, p)
                    if not (len(done) == 1 and ask == guard):
                        out.append(Rule((ask,), tuple(x for x in done if not isinstance(x, Builtin) or set(x.variables()) <= bound), f"ask {b.key} {p}"))
                    todo.append((b.key, p))
                done.append(b)
                bound |= set(b.variables())
            out.append(Rule(r.head, (guard, *body), r.name))
    return out, seeds


def _along_chain(facts: DataFrame, rules: list[Rule], goal: Atom, **options) -> DataFrame | None:
    """A goal on a predicate that one chain rule extends, bound at the end that the chain goes on from: the nodes that
    the bound term reaches by the chain's step, then what the other rules say of these. None for other goals."""
    stratum = next((x for x in stratify(rules) if any(a.key == goal.key for r in x for a in r.head)), [])
    found = chain(stratum)
    if found is None or any(a.key != goal.key for r in stratum for a in r.head) or any(len(r.head) > 1 or r.existentials() for r in stratum):
        return None
    rule, side = found
    if any(isinstance(b, Atom) and (b.key is None or b.key in derived_keys(rules)) for r in stratum if r is not rule for b in r.body):
        return None
    at_end = side == "left" or isinstance(goal.s, Var)
    if isinstance(goal.o if at_end else goal.s, Var) or (side == "right" and at_end):
        return None
    x, y = rule.body if rule.body[0].s == rule.head[0].s else reversed(rule.body)
    step = y if side == "left" else x
    if side != "both" and step.key in derived_keys(rules):
        return None
    engine = Engine(rules, **options)
    facts = facts.select("s", "p", "o")
    parts = [facts.where(F.col("p") == encode(goal.p))] + [engine.fire(r, engine.body(r, facts, None, None)).select("s", "p", "o") for r in stratum if r is not rule]
    base = reduce(DataFrame.union, parts)
    hops = base if side == "both" else facts.where(F.col("p") == encode(step.p))
    seed = facts.sparkSession.createDataFrame([(encode(goal.o if at_end else goal.s),)], "node string")
    nodes = reachable(hops.select(F.col("s").alias("a"), F.col("o").alias("b")), seed, reverse=at_end).select("node").distinct()
    bound = encode(goal.o if at_end else goal.s)
    here = base.join(nodes, F.col("o" if at_end else "s") == F.col("node"), "left_semi")
    return here.select(F.col("s") if at_end else F.lit(bound).alias("s"), "p", F.lit(bound).alias("o") if at_end else F.col("o")).distinct()


def answers(facts: DataFrame, rules: list[Rule], goal: Atom, **options) -> DataFrame:
    """The triples that match a goal in the closure of the facts."""
    known = _along_chain(facts, rules, goal, **options)
    if known is None:
        rewritten, seeds = transform(rules, [goal])
        spark = facts.sparkSession
        if seeds:
            rows = [tuple(encode(t) for t in (a.s, a.p, a.o)) for a in seeds]
            facts = facts.select("s", "p", "o").union(spark.createDataFrame(rows, "s string, p string, o string"))
        known = Engine(rewritten, **options).run(facts).known
    tests = [F.col(c) == encode(t) for c, t in zip("spo", (goal.s, goal.p, goal.o)) if not isinstance(t, Var)]
    for t in tests:
        known = known.where(t)
    if isinstance(goal.s, Var) and goal.s == goal.o:
        known = known.where("s = o")
    return known.where(~F.col("p").startswith(f"<{MAGIC}") & ~F.col("o").startswith(f"<{MAGIC}"))
