"""A graph, or several, as an immutable table of quads (s, p, o, g) of term strings."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..storage import written
from ..terms import RDF, RDFS, Bnode, Iri, Literal, decode, encode
from .closure import components, fixpoint, reachable
from .stores import QuadStore

COLUMNS = ["s", "p", "o", "g"]
SCHEMA = "s string, p string, o string, g string"


class Ambiguous(ValueError):
    """More than one value where one was asked for."""


def _slot(col: str, x) -> Column | None:
    if x is None:
        return None
    if isinstance(x, re.Pattern):
        return T.lex(F.col(col)).rlike(f"^(?:{x.pattern})")
    if isinstance(x, (list, tuple)) and not isinstance(x, Literal):
        return F.col(col).isin([encode(t) for t in x]) if x else None
    return F.col(col) == encode(x)


class Graph:
    """Operations that change a graph give a new one."""

    def __init__(self, quads: DataFrame):
        self.quads_df = quads.select(*COLUMNS)
        self.spark: SparkSession = quads.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, triples, graph: str = "") -> Graph:
        """From (s, p, o) or (s, p, o, graph) terms on the driver."""
        rows = {(encode(t[0]), encode(t[1]), encode(t[2]), f"<{t[3]}>" if len(t) > 3 and t[3] else (f"<{graph}>" if graph else "")) for t in triples}
        return cls(spark.createDataFrame(sorted(rows), SCHEMA))

    def store(self, many_graphs: bool = True) -> QuadStore:
        return QuadStore(self.quads_df, many_graphs)

    # -- scans --

    def quads(self, s=None, p=None, o=None, g=None) -> DataFrame:
        """Matching quads. None is any; a list is one of its terms (an empty one any); a compiled pattern
        matches the lexical form from its start."""
        tests = [c for c in (_slot("s", s), _slot("p", p), _slot("o", o), _slot("g", g)) if c is not None]
        return self.quads_df.where(reduce(lambda a, b: a & b, tests)) if tests else self.quads_df

    def triples(self, s=None, p=None, o=None, g=None) -> DataFrame:
        """Matching triples of the union of all graphs."""
        return self.quads(s, p, o, g).select("s", "p", "o").distinct()

    def resolved(self, s=None, p=None, o=None) -> DataFrame:
        """(s, p, o, contexts): each matching triple once, with its graphs."""
        return self.quads(s, p, o).groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("g")).alias("contexts"))

    def triples_choices(self, s=None, p=None, o=None) -> DataFrame:
        if sum(isinstance(x, list) for x in (s, p, o)) != 1:
            raise ValueError("exactly one slot takes a list")
        return self.triples(s, p, o)

    def contains(self, s, p, o) -> bool:
        return not self.quads(s, p, o).limit(1).isEmpty()

    def contexts(self, s=None, p=None, o=None) -> DataFrame:
        return self.quads(s, p, o).select("g").distinct()

    def count(self) -> int:
        return self.triples().count()

    def graph(self, *names: str) -> Graph:
        """The named graphs alone."""
        return Graph(self.quads_df.where(F.col("g").isin([f"<{n}>" if n else "" for n in names])))

    def aggregate(self, *names: str) -> DataFrame:
        """The triples of several graphs as a bag: one that is in two counts twice."""
        return self.graph(*names).quads_df.select("s", "p", "o")

    def subjects(self, p=None, o=None) -> DataFrame:
        return self.triples(None, p, o).select("s")

    def predicates(self, s=None, o=None) -> DataFrame:
        return self.triples(s, None, o).select("p")

    def objects(self, s=None, p=None) -> DataFrame:
        return self.triples(s, p, None).select("o")

    def subject_predicates(self, o=None) -> DataFrame:
        return self.triples(None, None, o).select("s", "p")

    def subject_objects(self, p=None) -> DataFrame:
        return self.triples(None, p, None).select("s", "o")

    def predicate_objects(self, s=None) -> DataFrame:
        return self.triples(s, None, None).select("p", "o")

    def value(self, s=None, p=None, o=None, default=None, any: bool = True):
        """The one term for the one open slot; ``any`` False raises if there are several."""
        open_ = [c for c, x in zip("spo", (s, p, o)) if x is None]
        if len(open_) != 1:
            return None
        rows = self.triples(s, p, o).select(open_[0]).orderBy(open_[0]).limit(2).collect()
        if len(rows) > 1 and not any:
            raise Ambiguous(f"several values for {(s, p, o)}")
        return decode(rows[0][0]) if rows else default

    def label(self, s, default=""):
        return self.value(s, Iri(RDFS + "label"), default=default)

    def comment(self, s, default=""):
        return self.value(s, Iri(RDFS + "comment"), default=default)

    # -- changes --

    def add(self, *triples, graph: str = "") -> Graph:
        return Graph(self.quads_df.union(Graph.of(self.spark, triples, graph).quads_df).distinct())

    def remove(self, s=None, p=None, o=None, g=None) -> Graph:
        tests = [c for c in (_slot("s", s), _slot("p", p), _slot("o", o), _slot("g", g)) if c is not None]
        return Graph(self.quads_df.where(~reduce(lambda a, b: a & b, tests)) if tests else self.quads_df.limit(0))

    def set(self, s, p, o, graph: str = "") -> Graph:
        """Replaces the values of (s, p)."""
        return self.remove(s, p).add((s, p, o), graph=graph)

    def remove_context(self, name: str) -> Graph:
        return self.remove(g=Iri(name))

    # -- set operations --

    def _plain(self, df: DataFrame) -> Graph:
        return Graph(df.withColumn("g", F.lit("")))

    def __add__(self, other: Graph) -> Graph:
        return self._plain(self.triples().union(other.triples()).distinct())

    def __mul__(self, other: Graph) -> Graph:
        return self._plain(self.triples().intersect(other.triples()))

    def __sub__(self, other: Graph) -> Graph:
        return self._plain(self.triples().subtract(other.triples()))

    # -- structure --

    def edges(self, p=None) -> DataFrame:
        return self.triples(None, p, None).select(F.col("s").alias("a"), F.col("o").alias("b"))

    def transitive_objects(self, s, p) -> DataFrame:
        """The subject and all that it reaches by the property."""
        return reachable(self.edges(p), self._seed(s)).select("node")

    def transitive_subjects(self, p, o) -> DataFrame:
        return reachable(self.edges(p), self._seed(o), reverse=True).select("node")

    def _seed(self, *terms) -> DataFrame:
        return self.spark.createDataFrame([(encode(t),) for t in terms], "node string")

    def items(self, head) -> DataFrame:
        """(position, item) of an RDF list."""
        cells = reachable(self.edges(Iri(RDF + "rest")), self._seed(head)).select("node", F.col("depth").alias("position"))
        first = self.quads(None, Iri(RDF + "first"), None).select("s", F.col("o").alias("item"))
        return cells.join(first, cells.node == first.s).select("position", "item").orderBy("position")

    def lists(self) -> DataFrame:
        """(head, items array) of every list in the graph."""
        rest = self.edges(Iri(RDF + "rest"))
        heads = rest.select(F.col("a").alias("head")).join(rest.select(F.col("b").alias("head")), "head", "left_anti")
        cells = reachable(rest, heads).select("seed", "node", "depth")
        first = self.quads(None, Iri(RDF + "first"), None).select("s", "o")
        pairs = cells.join(first, cells.node == first.s).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("depth", "o"))).alias("x"))
        return pairs.select(F.col("seed").alias("head"), F.transform("x", lambda e: e["o"]).alias("items"))

    def on_collection(self, item) -> DataFrame:
        """(head) of every list that holds an item."""
        return self.lists().where(F.array_contains("items", encode(item))).select("head")

    def sequence(self, container) -> DataFrame:
        """(position, item) of a container's numbered members."""
        q = self.quads(container, re.compile(re.escape(RDF + "_") + "[0-9]+$"), None)
        return q.select(F.regexp_extract("p", "_([0-9]+)>$", 1).cast("int").alias("position"), F.col("o").alias("item")).orderBy("position")

    def all_nodes(self) -> DataFrame:
        t = self.triples()
        return t.select(F.col("s").alias("node")).union(t.select("o")).distinct()

    def components(self) -> DataFrame:
        return components(self.edges())

    def connected(self) -> bool:
        return self.components().select("component").distinct().limit(2).count() <= 1

    def cluster(self, seed, forward: bool = True, backward: bool = False) -> DataFrame:
        """Triples found from a term by going on from objects and predicates, or backwards from subjects."""
        t = self.quads_df.select("s", "p", "o")  # what is found is made distinct, not all triples
        hops = []
        if forward:
            hops += [t.select(F.col("s").alias("a"), F.col("o").alias("b")), t.select(F.col("s").alias("a"), F.col("p").alias("b"))]
        if backward:
            hops.append(t.select(F.col("o").alias("a"), F.col("s").alias("b")))
        nodes = reachable(reduce(DataFrame.union, hops), self._seed(seed)).select("node")
        parts = ([t.join(nodes, t.s == nodes.node, "left_semi")] if forward else []) + ([t.join(nodes, t.o == nodes.node, "left_semi")] if backward else [])
        return reduce(DataFrame.union, parts).distinct()

    # -- comparison --

    def same_ground(self, other: Graph) -> bool:
        """Whether the triples without blank nodes are the same, and the others as many."""
        blank = T.is_blank(F.col("s")) | T.is_blank(F.col("o"))
        a, b = self.triples(), other.triples()
        x, y = a.where(~blank), b.where(~blank)
        return x.subtract(y).isEmpty() and y.subtract(x).isEmpty() and a.where(blank).count() == b.where(blank).count()

    def colours(self) -> DataFrame:
        """(node, colour): blank nodes by what is around them, other nodes by what they are.

        A blank node's colour is renewed from a sum of hashes over its triples, which needs no list of neighbours, until a
        round tells no more nodes apart."""
        t = self.triples()
        near = t.select(F.col("s").alias("n"), F.lit(">").alias("d"), "p", F.col("o").alias("m")).union(t.select(F.col("o"), F.lit("<"), "p", "s"))
        near = near.where(T.is_blank(F.col("n")))
        fixed = near.where(~T.is_blank(F.col("m"))).groupBy("n").agg(F.sum(F.xxhash64("d", "p", "m").cast("decimal(38,0)")).alias("h"))
        open_ = near.where(T.is_blank(F.col("m")))
        nodes = near.select(F.col("n").alias("node")).distinct()
        now = written(nodes.join(fixed, nodes.node == fixed.n, "left").select("node", F.sha1(F.coalesce("h", F.lit(0)).cast("string")).alias("colour")), "colours")
        many = now.select("colour").distinct().count()
        while True:
            c = now.select(F.col("node").alias("m"), F.col("colour").alias("c"))
            seen = open_.join(c, "m").groupBy("n").agg(F.sum(F.xxhash64("d", "p", "c").cast("decimal(38,0)")).alias("h"))
            now = written(now.join(seen, now.node == seen.n, "left").select("node", F.sha1(F.concat_ws("|", "colour", F.coalesce("h", F.lit(0)).cast("string"))).alias("colour")), "colours")
            more = now.select("colour").distinct().count()
            if more == many:
                break
            many = more
        rest = self.all_nodes().where(~T.is_blank(F.col("node")))
        return now.union(rest.select("node", F.col("node").alias("colour")))

    def isomorphic(self, other: Graph, ambiguous: int = 10_000) -> bool:
        """Whether some renaming of blank nodes makes the graphs equal.

        Graphs that differ with colours for blank nodes are unlike. Where each blank node has a colour of its own the
        others are alike; else the triples between nodes that share their colours are searched for a renaming, which
        is done on the driver and raises if there are more than ``ambiguous``."""

        def coloured(g: Graph) -> tuple[DataFrame, DataFrame]:
            c = g.colours()
            t = written(g.triples().join(c.toDF("s", "cs"), "s").join(c.toDF("o", "co"), "o"), "coloured")
            shared = c.where(T.is_blank(F.col("node"))).groupBy("colour").count().where("count > 1").select("colour")
            either = t.join(shared, t.cs == shared.colour, "left_semi").union(t.join(shared, t.co == shared.colour, "left_semi")).distinct()
            return t.select("cs", "p", "co"), either

        (x, a), (y, b) = coloured(self), coloured(other)
        if not (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()):
            return False
        rows = [g.limit(ambiguous + 1).collect() for g in (a, b)]
        if max(map(len, rows)) > ambiguous:
            raise ValueError(f"more than {ambiguous} triples have blank nodes that look alike")
        return renaming(*[[(r["s"], r["cs"], r["p"], r["o"], r["co"]) for r in part] for part in rows])


def renaming(x: list[tuple], y: list[tuple]) -> bool:
    """Whether the blank nodes of ``x`` can be mapped to those of ``y``, each to one of its colour, so that the triples
    (s, colour, p, o, colour) agree. Nodes next to mapped ones come first, so a wrong choice shows soon."""
    if len(x) != len(y):
        return False
    blank = lambda n: n.startswith("_:")
    colour = [{n: c for s, cs, _, o, co in g for n, c in ((s, cs), (o, co)) if blank(n)} for g in (x, y)]
    if sorted(colour[0].values()) != sorted(colour[1].values()):
        return False
    of: dict[str, list[str]] = {}
    for n, c in colour[1].items():
        of.setdefault(c, []).append(n)
    there = {(s, p, o) for s, _, p, o, _ in y}
    own: dict[str, list[tuple]] = {n: [] for n in colour[0]}
    for s, _, p, o, _ in x:
        for n in {s, o}:
            if n in own:
                own[n].append((s, p, o))
    order: list[str] = []
    placed: set[str] = set()
    for start in sorted(own, key=lambda n: (len(of[colour[0][n]]), n)):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in placed:
                placed.add(n)
                order.append(n)
                todo += [m for t in own[n] for m in (t[0], t[2]) if m in own and m not in placed]
    to: dict[str, str] = {}
    used: set[str] = set()

    def fits(n: str) -> bool:
        for s, p, o in own[n]:
            a, b = to.get(s, None if s in own else s), to.get(o, None if o in own else o)
            if a is not None and b is not None and (a, p, b) not in there:
                return False
        return True

    tried = [iter(of[colour[0][order[0]]])] if order else []
    while tried:  # no recursion, since there may be many nodes
        n = order[len(tried) - 1]
        if n in to:
            used.discard(to.pop(n))
        for m in tried[-1]:
            if m in used:
                continue
            to[n] = m
            if fits(n):
                used.add(m)
                break
            del to[n]
        else:
            tried.pop()
            continue
        if len(tried) == len(order):
            return True
        tried.append(iter(of[colour[0][order[len(tried)]]]))
    return not order


class Collection:
    """An RDF list in a graph, by its head. Operations that change it give the changed graph's collection; only
    the cells that change are replaced."""

    def __init__(self, graph: Graph, head):
        self.graph, self.head = graph, head
        self._cells: list[tuple[str, str]] | None = None

    def cells(self) -> list[tuple[str, str]]:
        """(cell, item) in order."""
        if self._cells is None:
            cells = reachable(self.graph.edges(Iri(RDF + "rest")), self.graph._seed(self.head)).select("node", "depth")
            first = self.graph.quads(None, Iri(RDF + "first"), None).select("s", "o")
            rows = cells.join(first, cells.node == first.s).select("depth", "s", "o").collect()  # one list
            self._cells = [(r["s"], r["o"]) for r in sorted(rows)]
        return self._cells

    def __len__(self) -> int:
        return len(self.cells())

    def __iter__(self):
        return (decode(o) for _, o in self.cells())

    def __getitem__(self, k: int):
        return decode(self.cells()[k][1])

    def index(self, item) -> int:
        return [o for _, o in self.cells()].index(encode(item))

    def _changed(self, gone: list[tuple], made: list[tuple], head=None) -> Collection:
        old = self.graph.spark.createDataFrame(gone or [("", "", "")], "s string, p string, o string")
        kept = self.graph.quads_df.join(F.broadcast(old), ["s", "p", "o"], "left_anti")
        new = self.graph.spark.createDataFrame([(*t, "") for t in made], SCHEMA)
        return Collection(Graph(kept.select(*COLUMNS).union(new)), head or self.head)

    def set(self, k: int, item) -> Collection:
        cell, old = self.cells()[k]
        return self._changed([(cell, f"<{RDF}first>", old)], [(cell, f"<{RDF}first>", encode(item))])

    def append(self, *items) -> Collection:
        cells = [f"_:c{uuid.uuid4().hex}" for _ in items]
        made = [t for c, item, after in zip(cells, items, [*cells[1:], f"<{RDF}nil>"]) for t in ((c, f"<{RDF}first>", encode(item)), (c, f"<{RDF}rest>", after))]
        if not items:
            return self
        if not len(self):
            return self._changed([], made, decode(cells[0]))
        last = self.cells()[-1][0]
        return self._changed([(last, f"<{RDF}rest>", f"<{RDF}nil>")], [(last, f"<{RDF}rest>", cells[0]), *made])

    def delete(self, k: int) -> Collection:
        cells = self.cells()
        k = range(len(cells))[k]
        cell, item = cells[k]
        after = cells[k + 1][0] if k + 1 < len(cells) else f"<{RDF}nil>"
        gone = [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", after)]
        if not k:
            return self._changed(gone, [], decode(after))
        before = cells[k - 1][0]
        return self._changed([*gone, (before, f"<{RDF}rest>", cell)], [(before, f"<{RDF}rest>", after)])

    def clear(self) -> Collection:
        cells = self.cells()
        rest = [c for c, _ in cells[1:]] + [f"<{RDF}nil>"]
        gone = [t for (c, o), after in zip(cells, rest) for t in ((c, f"<{RDF}first>", o), (c, f"<{RDF}rest>", after))]
        return self._changed(gone, [], Iri(RDF + "nil"))


class Namespaces:
    """Prefixes, and names shortened by them."""

    def __init__(self, bound: dict[str, str] | None = None):
        self.bound = {"rdf": RDF, "rdfs": RDFS, "xml": "http://www.w3.org/XML/1998/namespace"} | (bound or {})

    def bind(self, prefix: str, iri: str, override: bool = True) -> None:
        if override or prefix not in self.bound:
            self.bound[prefix] = iri

    def split(self, iri: str) -> tuple[str, str]:
        m = re.fullmatch(r"(.*[^\w.-])?([^\W\d][\w.-]*)", iri, re.S)
        if not m or not m[1]:
            raise ValueError(f"can't split {iri}")
        return m[1], m[2]

    def qname(self, iri: str) -> str:
        ns, local = self.split(iri)
        for prefix, known in self.bound.items():
            if known == ns:
                return f"{prefix}:{local}" if prefix else local
        k = 1
        while f"ns{k}" in self.bound:
            k += 1
        self.bound[f"ns{k}"] = ns
        return f"ns{k}:{local}"

    def expand(self, name: str) -> Iri:
        prefix, _, local = name.partition(":")
        return Iri(self.bound[prefix] + local)


__all__ = ["Ambiguous", "Bnode", "Collection", "Graph", "Namespaces", "fixpoint"]
