"""Recursive operators: least fixpoints by semi-naive rounds, each round a written table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, written


def fixpoint(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """The least set that holds ``start`` and all that ``step(new, known)`` derives.

    Only the rows of the last round are derived from. What is known is a union of the rounds' tables, so a
    round writes no more than it found; a row is found once."""
    known = Rounds(start.sparkSession, "fixpoint")
    new, n = known.add(start.distinct())
    for _ in range(limit):
        if not n:
            return known.all() if known.parts else new
        new, n = known.add(step(new, known.all()).distinct().join(known.all(), start.columns, "left_anti"))
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def _compose(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.alias("x").join(y.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")


def transitive_closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """All (a, b) with a path from a to b along ``edges`` (a, b); cycles end. ``reflexive`` adds (x, x) for
    every node.

    Round k knows the pairs up to 2^k steps apart and those exactly 2^k steps apart; the latter, followed by
    the former, double the reach. The rounds are logarithmic in the longest shortest path."""
    known = Rounds(edges.sparkSession, "closure")
    power, n = known.add(edges.select("a", "b").distinct())
    first = power
    while n:
        _, n = known.add(_compose(power, known.all()).distinct().join(known.all(), ["a", "b"], "left_anti"))
        if n:
            power = written(_compose(power, power).distinct(), "power")
    found = known.all() if known.parts else first
    if reflexive:
        nodes = edges.select("a").union(edges.select("b"))
        found = found.union(nodes.select("a", F.col("a").alias("b"))).distinct()
    return found


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int | None = None) -> DataFrame:
    """(seed, node, depth) of every node that a seed reaches, itself included at depth 0, with the least depth."""
    a, b = ("b", "a") if reverse else ("a", "b")
    hops = edges.select(F.col(a).alias("from"), F.col(b).alias("to"))  # a hop that is there twice is found once, below
    known = Rounds(edges.sparkSession, "reach")
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    new, n = known.add(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    first, k = new, 0
    while n and (depth is None or k < depth):
        k += 1
        found = new.join(hops, new.node == hops["from"]).select("seed", F.col("to").alias("node"), F.lit(k).alias("depth")).distinct()
        new, n = known.add(found.join(known.all().select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "depth"))
    return known.all() if known.parts else first


def transitive_generic(step: Callable[[DataFrame], DataFrame], seeds: DataFrame) -> DataFrame:
    """What repeated application of ``step`` (nodes to nodes, one column) yields; the seeds only if reached again."""
    column = seeds.columns[0]
    first = step(seeds).toDF(column).distinct()
    return fixpoint(first, lambda new, _: step(new).toDF(column))


def paths(edges: DataFrame, seeds: DataFrame, depth: int = 100) -> DataFrame:
    """(seed, node, path): every simple path from a seed, by a recursive query.

    A path of more than ``depth`` steps, or more rows than Spark's ``spark.sql.cteRecursionRowLimit``, is an error when the
    result is read, never a shorter result; both limits can be raised."""
    spark = edges.sparkSession
    name = f"_edges_{uuid.uuid4().hex}"
    edges.select("a", "b").createOrReplaceTempView(name)
    seeds.select(F.col(seeds.columns[0]).alias("seed")).createOrReplaceTempView(name + "_seeds")
    found = spark.sql(
        f"""WITH RECURSIVE walk(seed, node, path) MAX RECURSION LEVEL {depth + 1} AS (
              SELECT seed, seed, array(seed) FROM {name}_seeds
              UNION ALL SELECT w.seed, e.b, array_append(w.path, e.b) FROM walk w JOIN {name} e ON w.node = e.a WHERE NOT array_contains(w.path, e.b))
            SELECT * FROM walk"""
    )
    spark.catalog.dropTempView(name)
    spark.catalog.dropTempView(name + "_seeds")
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected ``edges`` (a, b), named by their least node.

    Edges are contracted towards smaller nodes until every node points at its least one, which takes a
    number of rounds that is logarithmic in practice."""
    nodes = edges.select("a").union(edges.select("b")).distinct()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (r[0], r[1]) == state or not r[0]:
            break
        state = (r[0], r[1])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    return nodes.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))


def common_ancestors(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """(ancestor, x, y): unobserved nodes that two observed ones, neither above the other, both reach upwards
    along ``edges`` (child a, parent b); x < y."""
    seen = observed.select(F.col(observed.columns[0]).alias("seed")).distinct()
    up = written(reachable(edges, seen).where("depth > 0").select("seed", F.col("node").alias("ancestor")), "up")
    free = up.join(seen, up.ancestor == seen.seed, "left_anti")
    x, y = free.alias("x"), free.alias("y")
    pairs = x.join(y, (F.col("x.ancestor") == F.col("y.ancestor")) & (F.col("x.seed") < F.col("y.seed"))).select(F.col("x.ancestor").alias("ancestor"), F.col("x.seed").alias("x"), F.col("y.seed").alias("y"))
    one = up.select(F.col("seed").alias("x"), F.col("ancestor").alias("y"))
    two = up.select(F.col("seed").alias("y"), F.col("ancestor").alias("x"))
    return pairs.join(one, ["x", "y"], "left_anti").join(two, ["x", "y"], "left_anti").select("ancestor", "x", "y")


def proximal_primitives(edges: DataFrame, primitive: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): the nearest primitive ancestors, those with no other primitive ancestor of the seed below them."""
    up = written(reachable(edges, seeds).where("depth > 0").select("seed", "node"), "up")
    p = primitive.select(F.col(primitive.columns[0]).alias("node")).distinct()
    own = written(up.join(p, "node", "left_semi"), "own")
    above = reachable(edges, own.select("node").distinct()).where("depth > 0").select(F.col("seed").alias("low"), F.col("node").alias("high"))
    beaten = own.alias("x").join(above, F.col("x.node") == F.col("low")).select("x.seed", F.col("high").alias("node")).distinct()
    return own.join(beaten, ["seed", "node"], "left_anti").select("seed", "node")


def segment(edges: DataFrame, seeds: DataFrame, up: int | None = None, down: int | None = 0, links: DataFrame | None = None) -> DataFrame:
    """(node, boundary): nodes within ``up`` steps above or ``down`` steps below the seeds, or linked to these;
    boundary nodes have parents outside."""
    parts = reachable(edges, seeds, depth=up).select("node").union(reachable(edges, seeds, reverse=True, depth=down).select("node"))
    if links is not None:
        found = written(parts.distinct(), "segment")
        parts = found.union(links.join(found, links.a == found.node, "left_semi").select("b"))
    inside = written(parts.distinct(), "segment")
    out = edges.join(inside, edges.a == inside.node, "left_semi").join(inside, edges.b == inside.node, "left_anti").select(F.col("a").alias("node")).distinct()
    return inside.join(out.withColumn("boundary", F.lit(True)), "node", "left").select("node", F.coalesce("boundary", F.lit(False)).alias("boundary"))
