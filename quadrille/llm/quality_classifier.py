"""Quality selection by importance resampling.

Two generative models of hashed one- and two-token features, one of target text (labelled good) and
one of the whole raw corpus, give each document the log of its importance weight: the sum over its
features of the log of their probability ratio. Gumbel noise, fixed by the document's id, is added, and
the documents with the k greatest sums are the sample.

Tokens are runs of word characters and runs of other visible characters. The raw counts cover every
document; the target counts at most ``target_bound`` labelled ones. k is ``share`` of the documents; by
default the good share of the labels plus ``margin``. The k-th greatest sum is found by narrowing
histograms, so no sort gathers the corpus; documents tied with it are all chosen.

Edge cases: a null or empty text has weight 0; a very long text is a batch of its own; without labels every document is chosen; repeated rows
get equal sums; a null id counts as id 0 for the noise; an empty table gives an empty result; other
columns are kept by ``selected`` and ignored by ``sums``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_ids
from .storage import written
from .textscan import BLANK, U64, mix, pieces, text_bytes, windows, word_hashes

BUCKETS = 1 << 14
_KIND = np.full(256, 2, np.uint8)
_KIND[BLANK] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token and each two consecutive tokens of a row."""
    data, off = text_bytes(col)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    row = np.searchsorted(off, starts, "right") - 1
    h = word_hashes(data, starts, ends)
    pair = windows(h, 2)
    same = row[1:] == row[:-1]
    both = np.concatenate([mix(h ^ U64(0x5851F42D4C957F2D)), pair[same]])
    return np.concatenate([row, row[:-1][same]]), (both >> U64(64 - 14)).astype(np.int64)


def _count(target: np.ndarray):
    def run(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches, "text", 2 << 20):
            row, bucket = features(piece.column(1))
            ids = piece.column(0).cast(pa.int64()).fill_null(-1).to_numpy()
            raw += np.bincount(bucket, minlength=BUCKETS)
            chosen = np.isin(ids, target)
            if chosen.any():
                good += np.bincount(bucket[chosen[row]], minlength=BUCKETS)
        if raw.any():
            yield pa.record_batch([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(good)], ["bucket", "raw", "good"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target_bound: int = 20000) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket."""
    good = np.array(sorted(bounded_ids(labels.where("quality = 1"), target_bound)), np.int64)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count(good), "bucket int, raw long, good long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["good"]
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _sums(ratio: np.ndarray, seed: int):
    def run(ids: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, bucket = features(text)
        weight = np.bincount(row, ratio[bucket], len(text))
        h = mix(ids.cast(pa.int64()).fill_null(0).to_numpy().view(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        u = ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        return weight, weight - np.log(-np.log(u))

    return run


def sums(docs: DataFrame, ratio: np.ndarray, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight and gumbel, the sum with its noise."""
    of = _sums(ratio, seed)

    def run(batches):
        for piece in pieces(batches, "text", 2 << 20):
            weight, total = of(piece.column(0), piece.column(1))
            yield pa.record_batch([piece.column(0), pa.array(weight), pa.array(total)], ["doc_id", "log_weight", "gumbel"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, log_weight double, gumbel double")


def kth_greatest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th greatest value of a column by histograms of at most ``bins`` bins over ever narrower ranges."""
    x = F.col(column)
    r = values.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count(x).alias("n")).first()
    if k <= 0 or not r["n"]:
        return math.inf
    if k >= r["n"]:
        return -math.inf
    low, high = r["a"], r["b"]
    while low < high:
        width = (high - low) / bins
        at = F.least(F.lit(bins - 1), F.floor((x - low) / width).cast("int")) if width > 0 else F.lit(0)
        rows = values.where(x.between(low, high)).groupBy(at.alias("at")).agg(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect()
        for row in sorted(rows, key=lambda row: -row["at"]):
            if k <= row["n"]:
                if (low, high) == (row["a"], row["b"]) and len(rows) == 1:
                    raise ArithmeticError("the histogram can't tell the values apart")
                low, high = row["a"], row["b"]
                break
            k -= row["n"]
    return low


def _cutoff(docs: DataFrame, labels: DataFrame, share: float | None, margin: float, target_bound: int, seed: int):
    if share is None:
        good = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double")).alias("s")).first()["s"]
        share = 1.0 if good is None else min(1.0, good + margin)
    ratio = fit(docs, labels, target_bound)
    found = written(sums(docs, ratio, seed), "sums")
    k = math.ceil(share * found.count())
    return ratio, found, kth_greatest(found, "gumbel", k)


def quality_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.01, target_bound: int = 20000, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight, gumbel and whether it is among the k chosen."""
    _, found, least = _cutoff(docs, labels, share, margin, target_bound, seed)
    return found.withColumn("kept", F.col("gumbel") >= F.lit(least))


def selected(docs: DataFrame, labels: DataFrame, share: float | None = None, margin: float = 0.01, target_bound: int = 20000, seed: int = 42) -> DataFrame:
    """The chosen rows of ``docs``, with all their columns. The sums are computed again rather than joined,
    so no text is shuffled."""
    ratio, _, least = _cutoff(docs, labels, share, margin, target_bound, seed)
    of = _sums(ratio, seed)

    def run(batches):
        for piece in pieces(batches, "text", 2 << 20):
            names = piece.schema.names
            _, total = of(piece.column(names.index("doc_id")), piece.column(names.index("text")))
            yield piece.filter(pa.array(total >= least))

    return docs.mapInArrow(run, docs.schema)
