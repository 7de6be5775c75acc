"""Where triple patterns are scanned: a table of quads, or relational tables seen as a graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..plans.algebra import Triple
from ..solutions import Solutions, column_name, union
from ..terms import DYNAMIC, TYPE, Desc, Iri, Literal, Var


@dataclass(frozen=True)
class Dataset:
    """Which graphs a query sees. ``graphs``: the default graph's, None for all; ``named``: those GRAPH may
    name, None for all; ``graph``: the one that the pattern is in, a variable or an IRI."""

    graphs: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None
    graph: Var | Iri | None = None


def _same(cols: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, [cols[0] == c for c in cols[1:]]) if len(cols) > 1 else None


def _solutions(df: DataFrame, slots: list[tuple[object, Column, Desc]]) -> Solutions:
    """Constants become conditions, variables columns; a variable in two slots makes them equal."""
    by: dict[str, list[tuple[Column, Desc]]] = {}
    conditions = []
    for term, col, desc in slots:
        if isinstance(term, Var):
            by.setdefault(term, []).append((col, desc))
        else:
            conditions.append(equals(col, desc, term))
    descs, cols = {}, []
    for v, own in by.items():
        desc = own[0][1] if all(d == own[0][1] for _, d in own) else DYNAMIC
        held = [c if d == desc else d.term(c) for c, d in own]
        if (same := _same(held)) is not None:
            conditions.append(same)
        conditions.append(held[0].isNotNull())
        descs[v] = desc
        cols.append(held[0].alias(column_name(v)))
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    return Solutions(df.select(*cols), descs, frozenset(descs))


def equals(col: Column, desc: Desc, term) -> Column:
    """Whether a column holds the constant; compares native values, so that the scan can filter by them."""
    if desc.kind is None:
        return col == T.encode(term)
    if desc.kind == "U":
        if not isinstance(term, Iri) or not term.startswith(desc.prefix):
            return F.lit(False)
        key = term[len(desc.prefix) :]
        return col == F.lit(int(key)) if key.isdigit() and key == str(int(key)) and int(key) < 1 << 63 else col.cast("string") == key
    if not isinstance(term, Literal) or (term.dt, term.lang) != (desc.dt, desc.lang):
        return F.lit(False)
    to = T.native(desc.dt)
    return col == (F.lit(term.lex).cast(to) if to else F.lit(term.lex))


class QuadStore:
    """A DataFrame (s, p, o, g) of term strings; ``stats`` orders joins.

    ``many_graphs`` False promises that no triple is in two graphs, so the union of all needs no
    de-duplication. ``lax``: a plain literal in a pattern also matches typed ones of the same form."""

    def __init__(self, quads: DataFrame, many_graphs: bool = True, stats: dict[str, tuple[int, int, int]] | None = None, lax: bool = False):
        self.quads, self.many_graphs, self.stats, self.lax = quads, many_graphs, stats or {}, lax
        self.spark: SparkSession = quads.sparkSession

    def triples(self, data: Dataset = Dataset()) -> DataFrame:
        df = self.quads if data.graphs is None else self.quads.where(F.col("g").isin([f"<{g}>" if g else "" for g in data.graphs]))
        df = df.select("s", "p", "o")
        return df.distinct() if self.many_graphs and (data.graphs is None or len(data.graphs) > 1) else df

    def stars(self, triples: list[Triple], data: Dataset) -> list[tuple[list[Triple], Solutions]]:
        return [([t], self.scan(t, data)) for t in triples]

    def scan(self, t: Triple, data: Dataset) -> Solutions:
        slots = [(t.s, F.col("s"), DYNAMIC), (t.p, F.col("p"), DYNAMIC), (t.o, F.col("o"), DYNAMIC)]
        df = self.quads
        if self.lax and isinstance(t.o, Literal) and not t.o.dt and not t.o.lang:
            df = df.where(T.is_literal(F.col("o")) & (T.lex(F.col("o")) == t.o.lex) & (T.lang(F.col("o")) == ""))
            slots.pop()
        if data.graph is not None:
            if data.named is not None:
                df = df.where(F.col("g").isin([f"<{g}>" for g in data.named]))
            return _solutions(df.where(F.col("g") != ""), [*slots, (data.graph, F.col("g"), DYNAMIC)])
        if data.graphs is not None:
            df = df.where(F.col("g").isin([f"<{g}>" if g else "" for g in data.graphs]))
        out = _solutions(df, slots)
        if self.many_graphs and (data.graphs is None or len(data.graphs) > 1):
            out.df = out.df.distinct() if out.descs else out.df.limit(1)
        return out

    def estimate(self, t: Triple) -> float:
        """Expected rows of a pattern from the predicate statistics."""
        if isinstance(t.p, Var) or t.p not in self.stats:
            n, s, o = (sum(x[k] for x in self.stats.values()) or 1e9 for k in range(3))
        else:
            n, s, o = self.stats[t.p]
        return n / (1 if isinstance(t.s, Var) else max(s, 1)) / (1 if isinstance(t.o, Var) else max(o, 1))


@dataclass
class TableMap:
    """A table as a graph: each row is a subject, each column a predicate; NULL is no triple.

    ``unique`` promises that no two rows have one subject, so patterns on it need no joins."""

    df: DataFrame
    prefix: str
    key: Column
    rdf_class: str = ""
    columns: dict[str, tuple[Desc, Column]] = field(default_factory=dict)
    unique: bool = True
    graph: tuple[Desc, Column] | None = None
    rows: float = 1e6

    @property
    def subject(self) -> Desc:
        return Desc("U", self.prefix)


_CLASS = Desc("U", "")


class MappedStore:
    """Relational tables as one graph. Constant predicates are resolved to columns before any row is read."""

    def __init__(self, tables: list[TableMap]):
        self.tables = tables
        self.spark = tables[0].df.sparkSession

    def _predicates(self, m: TableMap) -> dict[str, tuple[Desc, Column]]:
        return m.columns | ({TYPE: (_CLASS, F.lit(m.rdf_class))} if m.rdf_class else {})

    def _graphed(self, m: TableMap, data: Dataset) -> tuple[DataFrame, list] | None:
        if data.graph is None:
            if data.graphs is None:
                return m.df, []
            if m.graph is None:
                return None
            return m.df.where(m.graph[0].text(m.graph[1]).isin(list(data.graphs))), []
        if m.graph is None:
            return None
        df = m.df if data.named is None else m.df.where(m.graph[0].text(m.graph[1]).isin(list(data.named)))
        return df, [(data.graph, m.graph[1], m.graph[0])]

    def stars(self, triples: list[Triple], data: Dataset) -> list[tuple[list[Triple], Solutions]]:
        """One scan for all patterns on one subject whose predicates only one table has, if no two of its rows
        have one subject; a scan each for the others."""
        groups: dict[int, list[Triple]] = {}
        out = []
        for t in triples:
            have = [k for k, m in enumerate(self.tables) if not isinstance(t.p, Var) and self._has(m, t)]
            if len(have) == 1 and self.tables[have[0]].unique:
                groups.setdefault(have[0], []).append(t)
            else:
                out.append(([t], self.scan(t, data)))
        for k, own in groups.items():
            m, s = self.tables[k], own[0].s
            found = self._graphed(m, data)
            if found is None or not (isinstance(s, Var) or isinstance(s, Iri) and s.startswith(m.prefix)):
                out += [([t], self.scan(t, data)) for t in own]
                continue
            df, extra = found
            values = self._predicates(m)
            slots = [(t.o, values[t.p][1], values[t.p][0]) for t in own if not (t.p == TYPE and t.o == m.rdf_class)]
            out.append((own, _solutions(df, [(s, m.key, m.subject), *slots, *extra])))
        return out

    def _has(self, m: TableMap, t: Triple) -> bool:
        return t.p in self._predicates(m) and not (t.p == TYPE and isinstance(t.o, Iri) and t.o != m.rdf_class)

    def _exploded(self, m: TableMap, t: Triple, df: DataFrame, extra: list) -> Solutions:
        """A table's rows for a variable predicate: one scan, a row per column that isn't NULL."""
        if not isinstance(t.s, Var):
            df = df.where(equals(m.key, m.subject, t.s))
        row = F.explode(F.array(*[F.struct(F.lit(f"<{p}>").alias("p"), d.term(c).alias("o")) for p, (d, c) in self._predicates(m).items()]))
        graph = [d.term(c).alias("g") for _, c, d in extra]
        df = df.select(m.subject.term(m.key).alias("s"), row.alias("t"), *graph).select("s", "t.p", "t.o", *["g" for _ in extra]).where("o is not null")
        x = _solutions(df, [(t.s, F.col("s"), DYNAMIC), (t.p, F.col("p"), DYNAMIC), (t.o, F.col("o"), DYNAMIC), *[(g, F.col("g"), DYNAMIC) for g, _, _ in extra]])
        if not m.unique:
            x.df = x.df.distinct()
        return x

    def scan(self, t: Triple, data: Dataset) -> Solutions:
        parts = []
        for m in self.tables:
            if not isinstance(t.s, Var) and not (isinstance(t.s, Iri) and t.s.startswith(m.prefix)):
                continue
            found = self._graphed(m, data)
            if found is None:
                continue
            df, extra = found
            if isinstance(t.p, Var):
                parts.append(self._exploded(m, t, df, extra))
                continue
            for p, (desc, col) in self._predicates(m).items():
                if t.p != p:
                    continue
                if p == TYPE and isinstance(t.o, Iri) and t.o != m.rdf_class:
                    continue
                value = [] if p == TYPE and isinstance(t.o, Iri) else [(t.o, col, desc)]
                x = _solutions(df.where(col.isNotNull()), [(t.s, m.key, m.subject), *value, *extra])
                if not m.unique:
                    x.df = x.df.distinct()
                parts.append(x)
        if not parts:
            names = list(dict.fromkeys([*t.variables(), *([data.graph] if isinstance(data.graph, Var) else [])]))
            empty = self.spark.createDataFrame([], ", ".join(f"`{column_name(v)}` string" for v in names) or "x int")
            return Solutions(empty if names else empty.select(), {v: DYNAMIC for v in names}, frozenset(names))
        return reduce(union, parts)

    def triples(self, data: Dataset = Dataset()) -> DataFrame:
        return self.scan(Triple(Var("s"), Var("p"), Var("o")), data).terms()

    def quads(self) -> DataFrame:
        """All tables as a table of quads, which a QuadStore can hold."""
        parts = []
        for m in self.tables:
            g = m.graph[0].term(m.graph[1]) if m.graph else F.lit("")
            have = self._predicates(m)
            row = F.explode(F.array(*[F.struct(F.lit(f"<{p}>").alias("p"), d.term(c).alias("o")) for p, (d, c) in have.items()]))
            x = m.df.select(m.subject.term(m.key).alias("s"), row.alias("t"), g.alias("g")).where("t.o is not null")
            x = x.select("s", "t.p", "t.o", "g")
            parts.append(x if m.unique else x.distinct())
        return reduce(DataFrame.unionByName, parts)

    def estimate(self, t: Triple) -> float:
        have = [m.rows for m in self.tables if isinstance(t.p, Var) or t.p in self._predicates(m)]
        return sum(have) / (1 if isinstance(t.s, Var) else 1e6) / (1 if isinstance(t.o, Var) else 10)
