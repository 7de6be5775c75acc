"""An inverted index over the literals of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as T

STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


# Words travel as a list a subject and predicate: they are compared within it, and its terms aren't repeated for each word.


def _once(lists: DataFrame) -> DataFrame:
    return lists.groupBy("s", "p").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))


def word_lists(triples: DataFrame) -> DataFrame:
    """(s, p, words): the words of the literals of a subject and predicate, held in one row."""
    return _once(triples.where(T.is_literal(F.col("o"))).select("s", "p", words(T.lex(F.col("o"))).alias("words")))


def with_words(lists: DataFrame, added: DataFrame) -> DataFrame:
    return _once(lists.union(added))


def without_words(lists: DataFrame, removed: DataFrame, rest: DataFrame) -> DataFrame:
    """The lists without what only the removed triples' lists have; ``rest``: the lists of the triples that stay."""
    less = lambda c, name: F.array_except(c, F.coalesce(F.col(name), F.array().cast("array<string>")))
    gone = removed.join(rest.withColumnRenamed("words", "stay"), ["s", "p"], "left").select("s", "p", less("words", "stay").alias("gone"))
    return lists.join(gone, ["s", "p"], "left").select("s", "p", less("words", "gone").alias("words"))


def postings(lists: DataFrame) -> DataFrame:
    """(term, s, p) of word lists."""
    return lists.select(F.explode("words").alias("term"), "s", "p")


def _lists(ix: DataFrame) -> DataFrame:
    return ix.groupBy("s", "p").agg(F.collect_list("term").alias("words"))


def index(triples: DataFrame) -> DataFrame:
    """(term, s, p): a row for each word of a literal, once per subject and predicate."""
    return postings(word_lists(triples))


def add(ix: DataFrame, triples: DataFrame) -> DataFrame:
    return postings(with_words(_lists(ix), word_lists(triples)))


def remove(ix: DataFrame, triples: DataFrame, rest: DataFrame) -> DataFrame:
    """The index without what only the removed triples had; ``rest``: the triples that stay."""
    near = rest.join(triples.select("s", "p").distinct(), ["s", "p"], "left_semi")
    return postings(without_words(_lists(ix), word_lists(triples), word_lists(near)))


def search(ix: DataFrame, query: str | list[str], predicate: str | None = None) -> DataFrame:
    """(s, p) with any of the query's words."""
    terms = query.lower().split() if isinstance(query, str) else [q.lower() for q in query]
    tests = [F.col("term").isin(terms)] + ([F.col("p") == f"<{predicate}>"] if predicate else [])
    return ix.where(reduce(lambda a, b: a & b, tests)).select("s", "p").distinct()


def values(found: DataFrame, triples: DataFrame) -> DataFrame:
    """The literals behind a search's hits."""
    return triples.where(T.is_literal(F.col("o"))).join(found, ["s", "p"], "left_semi")
