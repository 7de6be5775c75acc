"""Tables of solution mappings and their joins.

Each variable is a column, NULL where it is unbound. ``descs`` says what is known of each column, and
``bound`` which variables every row binds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import DYNAMIC, Desc


def column_name(var: str) -> str:
    """A column name that differs from others' whatever the session's case sensitivity."""
    low = var.lower()
    return low if low == var else low + "__" + "".join("01"[c.isupper()] for c in var)


@dataclass
class Solutions:
    df: DataFrame
    descs: dict[str, Desc]
    bound: frozenset[str]

    @staticmethod
    def unit(spark) -> Solutions:
        """One solution that binds nothing."""
        return Solutions(spark.range(1).select(), {}, frozenset())

    def col(self, var: str) -> Column:
        return F.col(f"`{column_name(var)}`")

    def term(self, var: str) -> Column:
        return self.descs[var].term(self.col(var))

    def project(self, names: list[str]) -> Solutions:
        cols = [(self.col(v) if v in self.descs else F.lit(None).cast("string")).alias(column_name(v)) for v in names]
        return Solutions(self.df.select(*cols), {v: self.descs.get(v, DYNAMIC) for v in names}, self.bound & frozenset(names))

    def where(self, condition: Column) -> Solutions:
        return replace(self, df=self.df.where(condition))

    def with_desc(self, want: dict[str, Desc]) -> Solutions:
        """The same solutions, the variables in ``want`` held as described there."""
        change = {v for v, d in want.items() if v in self.descs and self.descs[v] != d}
        if not change:
            return self
        cols = [(self.term(v) if v in change else self.col(v)).alias(column_name(v)) for v in self.descs]
        return Solutions(self.df.select(*cols), {v: want[v] if v in change else d for v, d in self.descs.items()}, self.bound)

    def terms(self) -> DataFrame:
        """All variables as term strings."""
        return self.df.select(*[self.term(v).alias(v) for v in self.descs])

    def values(self) -> DataFrame:
        """Variables as what they are held as: keys, native values or term strings."""
        return self.df.select(*[self.col(v).alias(v) for v in self.descs])

    def texts(self) -> DataFrame:
        """Lexical forms and IRIs as strings."""
        from .terms import lex

        return self.df.select(*[(lex(self.col(v)) if d.kind is None else d.text(self.col(v))).alias(v) for v, d in self.descs.items()])


def _common(a: Desc, b: Desc) -> Desc:
    return a if a == b else DYNAMIC


def _aligned(left: Solutions, right: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    shared = [v for v in left.descs if v in right.descs]
    want = {v: _common(left.descs[v], right.descs[v]) for v in shared}
    return left.with_desc(want), right.with_desc(want), shared


def disjoint(a: Desc, b: Desc) -> bool:
    """Whether no term of one can be one of the other."""
    if a.kind is None or b.kind is None or a == b:
        return False
    if a.kind != b.kind:
        return True
    if a.kind == "U":
        return not (a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix))
    return (a.dt, a.lang) != (b.dt, b.lang)


def _renamed(right: Solutions, shared: list[str]) -> DataFrame:
    return right.df.select(*[right.col(v).alias(("r_" if v in shared else "") + column_name(v)) for v in right.descs])


def _r(var: str) -> Column:
    return F.col(f"`r_{column_name(var)}`")


def _merge(left: Solutions, right: Solutions, shared: list[str], df: DataFrame, outer: bool) -> Solutions:
    cols = []
    for v in left.descs:
        c = left.col(v)
        cols.append((F.coalesce(c, _r(v)) if v in shared and v not in left.bound else c).alias(column_name(v)))
    cols += [right.col(v) for v in right.descs if v not in shared]
    bound = left.bound if outer else left.bound | right.bound
    return Solutions(df.select(*cols), left.descs | {v: d for v, d in right.descs.items() if v not in shared}, bound)


def _compatible(left: Solutions, right: Solutions, shared: list[str]) -> Column | None:
    parts = []
    for v in shared:
        c = left.col(v) == _r(v)
        if v not in left.bound:
            c = c | left.col(v).isNull()
        if v not in right.bound:
            c = c | _r(v).isNull()
        parts.append(c)
    return reduce(lambda a, b: a & b, parts) if parts else None


def join(left: Solutions, right: Solutions) -> Solutions:
    """All compatible pairs: shared variables are equal, or unbound on a side.

    Variables that both sides always bind are equi-join keys. Where only such are shared nothing else is
    needed; where there are none, the sides are split by what is unbound, so that each part is an
    equi-join again."""
    if any(disjoint(left.descs[v], right.descs[v]) for v in left.bound & right.bound):
        out = join(left.with_desc({v: DYNAMIC for v in left.descs}), right.with_desc({v: DYNAMIC for v in right.descs}))
        return out.where(F.lit(False))
    left, right, shared = _aligned(left, right)
    loose = [v for v in shared if v not in left.bound or v not in right.bound]
    if not shared:
        return _merge(left, right, shared, left.df.crossJoin(right.df), False)
    if not loose or len(loose) < len(shared) or len(loose) > 2:
        return _merge(left, right, shared, left.df.join(_renamed(right, shared), _compatible(left, right, shared)), False)
    parts = []
    for a in product(*[(True,) if v in left.bound else (True, False) for v in loose]):
        for b in product(*[(True,) if v in right.bound else (True, False) for v in loose]):
            test = lambda s, have: reduce(lambda x, y: x & y, [s.col(v).isNotNull() if h else s.col(v).isNull() for v, h in zip(loose, have)])  # noqa: E731, B023
            x = replace(left.where(test(left, a)), bound=left.bound)
            y = right.where(test(right, b))
            keys = [v for v, h, k in zip(loose, a, b) if h and k]
            r = _renamed(y, shared)
            df = x.df.join(r, reduce(lambda p, q: p & q, [x.col(v) == _r(v) for v in keys])) if keys else x.df.crossJoin(r)
            parts.append(_merge(x, y, shared, df, False))
    return replace(parts[0], df=reduce(DataFrame.unionByName, [p.df for p in parts]))


def left_join(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """Compatible pairs that meet the condition, and the left solutions without any.

    ``condition``: from solutions with the columns of both sides to a column; it is part of the join."""
    left, right, shared = _aligned(left, right)
    r = _renamed(right, shared)
    on = _compatible(left, right, shared)

    def test(part: Solutions) -> Column | None:
        if condition is None:
            return None
        merged = _Merged(part, right, shared)
        return F.coalesce(condition(merged), F.lit(False))

    def joined(part: Solutions, on: Column | None) -> DataFrame:
        own = [c for c in (on, test(part)) if c is not None]
        return part.df.join(r, reduce(lambda a, b: a & b, own) if own else F.lit(True), "left")

    split = [v for v in shared if v not in left.bound and v in right.bound]
    if len(split) == 1 and all(v in left.bound for v in shared if v != split[0]):
        v = split[0]
        have = left.where(left.col(v).isNotNull())
        lack = left.where(left.col(v).isNull())
        df = joined(have, _compatible(replace(left, bound=left.bound | {v}), right, shared)).unionByName(joined(lack, _compatible(left, right, [x for x in shared if x != v])))
    else:
        df = joined(left, on)
    return _merge(left, right, shared, df, True)


class _Merged(Solutions):
    """Both sides of a join under way, for conditions that see the variables of either."""

    def __init__(self, left: Solutions, right: Solutions, shared: list[str]):
        super().__init__(left.df, left.descs | {v: d for v, d in right.descs.items() if v not in shared}, left.bound | right.bound)
        self._loose = {v for v in shared if v not in left.bound}

    def col(self, var: str) -> Column:
        own = super().col(var)
        return F.coalesce(own, _r(var)) if var in self._loose else own


def anti_join(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """The left solutions without a compatible right one that meets the condition."""
    left, right, shared = _aligned(left, right)
    on = [c for c in (_compatible(left, right, shared),) if c is not None]
    if condition is not None:
        on.append(F.coalesce(condition(_Merged(left, right, shared)), F.lit(False)))
    return replace(left, df=left.df.join(_renamed(right, shared), reduce(lambda a, b: a & b, on) if on else F.lit(True), "left_anti"))


def union(left: Solutions, right: Solutions) -> Solutions:
    """Both sides' solutions, as a bag."""
    left, right, _ = _aligned(left, right)
    df = left.df.unionByName(right.df, allowMissingColumns=True)
    return Solutions(df, left.descs | right.descs, left.bound & right.bound)


def distinct(s: Solutions) -> Solutions:
    return replace(s, df=s.df.distinct()) if s.descs else replace(s, df=s.df.limit(1))
