"""Benchmark decontamination by greedy string tiling.

Words are runs of digits, letters and all characters beyond ASCII, lower-cased by Unicode's rules. A document and a
benchmark item are compared if they share a seed: ``seed`` consecutive words. Tiling then marks, again
and again, the longest match between words that are not yet marked, down to matches of ``seed`` words; of
equally long ones that which begins first in the item, then in the text. Matches are found by running
Karp-Rabin hashes of ``seed`` words; equal hashes along a diagonal make up its longest matches, and a match
of which parts are marked already goes on waiting as what is left of it.
The item's marked share is its coverage; passages in another order still count. A document is contaminated
by an item that it covers to at least ``threshold``.

The item side is a stated query set: it is read in blocks of at most ``block_words`` words, one at a time. Each
block is sent to the tasks for one pass over the documents; where there are more, the rows are written between two
passes, so neither the driver nor a plan ever holds more than one. Documents are never shuffled. A tile lies
in words that seeds cover, which bounds the coverage from above and leaves tiling to likely pairs.

Edge cases: a null or empty text is not contaminated, coverage 0; a very long text is read whole, a batch of its
own; an item of fewer words than a seed has a seed of all its words; an item without words, or null, matches
nothing; a null item id is left out, and items that share an id are judged apart and reported once; repeated rows
give equal rows; empty tables give an empty or a clean result; other columns are kept by ``clean`` and ignored by
``overlaps``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textscan import mix, pieces, same_row, spans, text_bytes, windows, word_hashes

NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False
_BASE = 0x9E3779B97F4A7C15


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(pc.utf8_lower(col))
    starts, ends, row = spans(data, off, NOT_WORD)
    return word_hashes(data, starts, ends), row


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin hash of each window of ``n`` words, modulo 2^64, each from the one before: a prefix sum of
    the words times growing powers, less that before the window, is the window's hash times its first power."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    power = np.ones(len(words) + 1, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.cumprod(power)
    inverse = np.ones(len(words), np.uint64)
    inverse[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    inverse = np.cumprod(inverse)
    sums = np.append(np.uint64(0), np.cumsum(words * power[: len(words)]))
    return (sums[n:] - sums[:-n]) * inverse[: len(words) - n + 1]


def _diagonals(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(-length, place in pattern, place in text) of the matches of ``least`` words or more that can't be longer."""
    a, b = _rolling(pattern, least), _rolling(text, least)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    many = high - low
    p = np.repeat(np.arange(len(a)), many)
    t = order[np.repeat(low, many) + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)]
    for k in range(least):  # hashes nominate, words decide
        same = pattern[p + k] == text[t + k]
        p, t = p[same], t[same]
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    first = np.flatnonzero(np.append(True, (np.diff(t - p) != 0) | (np.diff(p) != 1))) if len(p) else p
    size = np.diff(np.append(first, len(p))) + least - 1
    return list(zip((-size).tolist(), p[first].tolist(), t[first].tolist()))


def tiles(pattern, text, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of 64-bit words: (place in pattern, place in text, length), longest
    first, none overlapping."""
    pattern, text = (np.asarray(x).astype(np.uint64) for x in (pattern, text))
    waiting = _diagonals(pattern, text, least)
    heapify(waiting)
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    found = []
    while waiting:
        size, p, t = heappop(waiting)
        free = free_p[p : p - size] & free_t[t : t - size]
        if free.all():
            found.append((p, t, -size))
            free_p[p : p - size] = free_t[t : t - size] = False
            continue
        edge = np.flatnonzero(np.diff(free, prepend=False, append=False))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heappush(waiting, (a - b, p + a, t + a))
    return found


class Block:
    """Some benchmark items with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        h, row = _words(pa.array(texts, pa.large_string()))
        self.seed, self.ids = seed, ids
        self.words = [h[row == k] for k in range(len(ids))]
        sizes = sorted({min(seed, len(w)) for w in self.words if len(w)})
        self.index = {}
        for n in sizes:
            keys, item, place = [], [], []
            for k, w in enumerate(self.words):
                if min(seed, len(w)) == n:
                    keys.append(windows(w, n))
                    item.append(np.full(len(keys[-1]), k))
                    place.append(np.arange(len(keys[-1])))
            keys, item, place = map(np.concatenate, (keys, item, place))
            order = np.argsort(keys, kind="stable")
            self.index[n] = keys[order], item[order], place[order]

    def scan(self, col: pa.Array, threshold: float) -> list[list[tuple[int, float]]]:
        """Per row the (item, coverage) that reach the threshold."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(col))]
        h, row = _words(col)
        for n, (keys, item, place) in self.index.items():
            at = np.flatnonzero(same_row(row, n))
            w = windows(h, n)[at] if len(at) else np.zeros(0, np.uint64)
            low, high = np.searchsorted(keys, w, "left"), np.searchsorted(keys, w, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            reps = (high - low)[hit]
            where = np.repeat(at[hit], reps)
            entry = np.repeat(low[hit], reps) + np.arange(len(where)) - np.repeat(np.cumsum(reps) - reps, reps)
            order = np.lexsort((where, item[entry], row[where]))
            where, entry = where[order], entry[order]
            pair = row[where] * len(self.ids) + item[entry]
            edge = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
            for a, b in zip(edge[:-1], edge[1:]):
                k = int(item[entry[a]])
                pattern = self.words[k]
                covered = np.zeros(len(pattern) + 1, np.int64)
                np.add.at(covered, place[entry[a:b]], 1)
                np.add.at(covered, place[entry[a:b]] + n, -1)
                if (np.cumsum(covered)[:-1] > 0).sum() < threshold * len(pattern):
                    continue
                spots = np.unique((where[a:b, None] + np.arange(n)).ravel())
                gaps = np.flatnonzero(np.diff(spots) != 1) + 1
                text = np.insert(h[spots], gaps, mix(~np.arange(len(gaps)).astype(np.uint64)))  # a gap matches nothing
                marked = sum(t[2] for t in tiles(pattern, text, n))
                if marked >= threshold * len(pattern):
                    out[int(row[where[a]])].append((self.ids[k], marked / len(pattern)))
        return out


def blocks(items: DataFrame, seed: int = 5, block_words: int = 1 << 20) -> Iterator[Block]:
    """The items (item_id, text), read one after another, in blocks of at most ``block_words`` words. A longer
    item is a block of its own."""
    ids, texts, size = [], [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].split()) + 1
        if ids and size + n > block_words:
            yield Block(ids, texts, seed)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Block(ids, texts, seed)


def _passes(rows: DataFrame, items: DataFrame, seed: int, block_words: int, over) -> DataFrame:
    """``over`` each block in turn; between two of them the rows are written."""
    first = True
    for block in blocks(items, seed, block_words):
        rows = (rows if first else written(rows, "pass")).mapInArrow(over(block), rows.schema)
        first = False
    return rows


def overlaps(docs: DataFrame, items: DataFrame, threshold: float = 0.8, seed: int = 5, block_words: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, the best coverage that reaches the threshold (else 0) and the item_ids."""

    def over(block: Block):
        def run(batches):
            for piece in pieces(batches, "text", 2 << 20):
                hits = block.scan(piece.column(1), threshold)
                best = [max(c, max((x for _, x in h), default=0.0)) for c, h in zip(piece.column(2).to_pylist(), hits)]
                have = [sorted({*i, *(x for x, _ in h)}) for i, h in zip(piece.column(3).to_pylist(), hits)]
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(best, pa.float64()), pa.array(have, pa.list_(pa.int64()))], names)

        return run

    names = ["doc_id", "text", "coverage", "item_ids"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("coverage"), F.array().cast("array<long>").alias("item_ids"))
    rows = _passes(rows, items, seed, block_words, over)
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "coverage", "item_ids")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, seed: int = 5, block_words: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""

    def over(block: Block):
        def run(batches):
            for piece in pieces(batches, "text", 2 << 20):
                hits = block.scan(piece.column(piece.schema.names.index("text")), threshold)
                yield piece.filter(pa.array([not h for h in hits], pa.bool_()))

        return run

    return _passes(docs, items, seed, block_words, over)
