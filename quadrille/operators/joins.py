"""Joins of the iterator algebra, as hints on declarative joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Builds on the right side, probes with the left."""
    return left.join(right.hint("shuffle_hash"), on, how)


def merge_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def theta_join(left: DataFrame, right: DataFrame, theta: Callable[[DataFrame, DataFrame], Column], how: str = "inner") -> DataFrame:
    """An arbitrary condition on pairs."""
    return left.join(right, theta(left, right), how)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left rows with a partner, each looked up in the sorted right side."""
    return left.join(right.select(*on).distinct().hint("merge"), on, "left_semi")


def predicate_join_statistics(triples: DataFrame) -> DataFrame:
    """(p, q, slots, matches): how many pairs of triples with these predicates join on each pair of slots.

    Counts per predicate and node are multiplied, so the pairs themselves are never built."""
    t = triples.select("s", "p", "o")
    side = lambda slot: t.groupBy("p", F.col(slot).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    counts = side("s").withColumn("slot", F.lit("s")).union(side("o").withColumn("slot", F.lit("o")))
    x, y = counts.alias("x"), counts.alias("y")
    pairs = x.join(y, F.col("x.node") == F.col("y.node"))
    return pairs.groupBy(F.col("x.p").alias("p"), F.col("y.p").alias("q"), F.concat("x.slot", F.lit("-"), "y.slot").alias("slots")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("matches"))


def predicate_statistics(triples: DataFrame) -> DataFrame:
    """(p, triples, subjects, objects) of each predicate."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def collected_statistics(triples: DataFrame) -> dict[str, tuple[int, int, int]]:
    """The same by predicate IRI, for ordering joins; one row per predicate."""
    return {r["p"][1:-1]: (r["triples"], r["subjects"], r["objects"]) for r in predicate_statistics(triples).collect()}
