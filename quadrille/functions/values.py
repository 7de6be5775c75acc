"""FILTER expressions over terms, as columns. An error is NULL, so SQL's three-valued logic is SPARQL's.

A ``Value`` offers one column per family of values: number, boolean, time, date and string. A family
that a value can't have, by what is known before any row is read, is None and costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..terms import XSD, Desc

FAMILIES = ("num", "bool", "time", "date", "str")
DATE_TIMES = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[XXX]")


@dataclass
class Value:
    term: Column
    text: Column
    dt: Column | str | None = None
    lang: Column | str = ""
    kind: str | None = None
    families: dict[str, Column] = field(default_factory=dict)


def family(dt: str) -> str | None:
    if dt in T.NUMBERS:
        return "num"
    return {"": "str", XSD + "string": "str", XSD + "boolean": "bool", XSD + "dateTime": "time", XSD + "date": "date"}.get(dt)


def parsed(text: Column, to: str) -> Column:
    """The value that a lexical form has in a family; NULL if it has none."""
    if to == "num":
        return text.try_cast("double")
    if to == "bool":
        return F.lower(text).isin("1", "true")
    if to == "time":
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_TIMES])
    return F.regexp_replace(text, "Z$", "").try_cast("date") if to == "date" else text


def of(col: Column, desc: Desc) -> Value:
    """The value of a variable's column."""
    if desc.kind == "U":
        return Value(desc.term(col), desc.text(col), kind="U")
    if desc.kind == "L":
        f = None if desc.lang else family(desc.dt)
        own = col.cast("double") if f == "num" else col
        return Value(desc.term(col), desc.text(col), desc.dt, desc.lang, "L", {f: own} if f else {})
    text, dt, tag = T.lex(col), T.datatype(col), T.lang(col)
    fam = {"num": F.when(dt.isin(list(T.NUMBERS)), parsed(text, "num"))}
    for name, d in (("bool", "boolean"), ("time", "dateTime"), ("date", "date")):
        fam[name] = F.when(dt == XSD + d, parsed(text, name))
    fam["str"] = F.when(dt.isin(list(T.STRINGS)) & (tag == ""), text)
    return Value(col, text, dt, tag, None, fam)


def constant(t) -> Value:
    if not isinstance(t, T.Literal):
        return Value(F.lit(T.encode(t)), F.lit(str(t)), kind="U" if isinstance(t, T.Iri) else "B")
    f = None if t.lang else family(t.dt)
    return Value(F.lit(T.encode(t)), F.lit(t.lex), t.dt, t.lang, "L", {f: parsed(F.lit(t.lex), f)} if f else {})


def typed(col: Column, dt: str) -> Value:
    """A computed literal."""
    f = family(dt)
    return Value(Desc("L", dt=dt).term(col), col.cast("string"), dt, "", "L", {f: col.cast("double") if f == "num" else col})


def truth(col: Column) -> Value:
    return typed(col, XSD + "boolean")


def ebv(v: Value) -> Column:
    """Effective boolean value; NULL for what has none."""
    parts = []
    for f, test in (("bool", lambda c: c), ("num", lambda c: (c != 0) & ~F.isnan(c)), ("str", lambda c: F.length(c) > 0)):
        if f in v.families:
            parts.append(test(v.families[f]))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast("boolean")


OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Value, b: Value) -> Column:
    """By value within a family; by identity of terms for = and != elsewhere; else an error."""
    parts = [OPS[op](a.families[f], b.families[f]) for f in FAMILIES if f in a.families and f in b.families]
    if op in ("=", "!="):
        same = a.term == b.term
        literals = [T.is_literal(x.term) if x.kind is None else F.lit(x.kind == "L") for x in (a, b)]
        if a.kind is None or b.kind is None or (a.kind == "L") != (b.kind == "L") or not parts:
            # different literals of unlike types can't be told equal or not; other terms can
            known = F.when(same, F.lit(True)).when(same.isNull(), None).when(literals[0] & literals[1] & _unlike(a, b), None).otherwise(F.lit(False))
            parts.append(known if op == "=" else ~known)
    if not parts:
        return F.lit(None).cast("boolean")
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def _unlike(a: Value, b: Value) -> Column:
    tag = lambda v: F.lit(v.lang) if isinstance(v.lang, str) else F.coalesce(v.lang, F.lit(""))
    return (tag(a) == "") & (tag(b) == "")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = a.families.get("num"), b.families.get("num")
    if op == "+" and (x is None or y is None) and "str" in a.families and "str" in b.families:
        return typed(F.concat(a.families["str"], b.families["str"]), "")
    if x is None or y is None:
        return typed(F.lit(None).cast("double"), XSD + "double")
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()
    whole = all(isinstance(v.dt, str) and v.dt in T.INTEGERS for v in (a, b)) and op != "/"
    return typed(out, XSD + ("integer" if whole else "double"))


def cast(v: Value, dt: str) -> Value:
    """The XSD constructor functions."""
    f = family(dt)
    if f == "num":
        base = [v.families[x].cast("double") for x in ("num", "bool") if x in v.families] + [F.when(_not_iri(v), v.text.try_cast("double"))]
        x = F.coalesce(*base)
        if dt in T.INTEGERS:
            x = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")
            return Value(Desc("L", dt=dt).term(x), x.cast("string"), dt, "", "L", {"num": x.cast("double")})
        return typed(x, dt)
    if f == "bool":
        base = [v.families["num"] != 0] if "num" in v.families else []
        base.append(F.when(F.lower(v.text).isin("1", "true"), F.lit(True)).when(F.lower(v.text).isin("0", "false"), F.lit(False)))
        return typed(F.coalesce(*base), dt)
    if f in ("time", "date"):
        own = [v.families[f]] if f in v.families else []
        x = F.coalesce(*own, parsed(v.text, f)) if f == "time" else F.coalesce(*own, *([v.families["time"].cast("date")] if "time" in v.families else []), parsed(F.substring(v.text, 1, 10), f))
        return typed(x, dt)
    return typed(v.text, dt)


def _not_iri(v: Value) -> Column:
    return T.is_literal(v.term) if v.kind is None else F.lit(v.kind == "L")


def _is(kind: str, test) -> Callable[[Value], Value]:
    return lambda v: truth(test(v.term) if v.kind is None else F.when(v.term.isNotNull(), F.lit(v.kind == kind)))


def _lang(v: Value) -> Value:
    return typed(F.coalesce(F.lit(v.lang) if isinstance(v.lang, str) else v.lang, F.lit("")), "")


def _datatype(v: Value) -> Value:
    dt = F.lit(v.dt) if isinstance(v.dt, str) else v.dt
    tag = F.lit(v.lang) if isinstance(v.lang, str) else v.lang
    if dt is None:
        out = F.lit(None).cast("string")
    else:
        out = F.when(v.term.isNotNull() & (tag == ""), F.when(dt == "", F.lit(XSD + "string")).otherwise(dt))
    return Value(F.concat(F.lit("<"), out, F.lit(">")), out, kind="U")


def _langmatches(tag: Value, span: Value) -> Value:
    a, b = F.lower(tag.text), F.lower(span.text)
    return truth(F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))


def _regex(text: Value, pattern: Value, flags: Value | None = None) -> Value:
    p = pattern.text if flags is None else F.when(flags.text == "", pattern.text).otherwise(F.concat(F.lit("(?"), flags.text, F.lit(")"), pattern.text))
    s = text.families.get("str", F.lit(None).cast("string"))
    return truth(F.regexp_like(s, p))


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "STR": lambda v: typed(v.text, ""),
    "LANG": _lang,
    "DATATYPE": _datatype,
    "LANGMATCHES": _langmatches,
    "BOUND": lambda v: truth(v.term.isNotNull()),
    "ISIRI": _is("U", T.is_iri),
    "ISURI": _is("U", T.is_iri),
    "ISBLANK": _is("B", T.is_blank),
    "ISLITERAL": _is("L", T.is_literal),
    "SAMETERM": lambda a, b: truth(a.term == b.term),
    "REGEX": _regex,
}

#: IRI of an extension function: fn(*values) -> Value; register() adds to it.
EXTENSIONS: dict[str, Callable[..., Value]] = {}


def register(iri: str, fn: Callable[..., Value]) -> None:
    EXTENSIONS[iri] = fn


def order_key(v: Value, bound: bool = False) -> list[Column]:
    """Sort keys: unbound, blank, IRI, literal; literals by number, time, boolean, string, then by form.
    ``bound``: the value is never missing, so one of a known kind needs no rank."""
    have = [f for f in ("num", "time", "date", "bool", "str") if f in v.families]
    keys = []
    if v.kind is None:
        keys.append(F.when(v.term.isNull(), 0).when(T.is_blank(v.term), 1).when(T.is_iri(v.term), 2).otherwise(3))
    elif not bound:
        keys.append(F.when(v.term.isNull(), 0).otherwise(1))
    if len(have) > 1:
        keys.append(reduce(lambda w, x: w.when(v.families[x[1]].isNotNull(), x[0]), enumerate(have), F).otherwise(len(have)))
    return keys + [v.families[f] for f in have] + ([] if v.kind == "L" and have else [v.text])
