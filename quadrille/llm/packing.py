"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's ids (its text's, then one end id) are first cut into full windows; the shorter rests are
placed longest first, each into the open window with the least room that still takes it. A segment
tree over the remaining capacities finds that window.

Pieces of one length are interchangeable, so the plan needs only how many there are of each length: at
most ``size`` counts reach the driver, whatever the corpus. Windows are kept as intervals of equal
room, and one step places as many pieces as an interval takes; the result is that of placing the
pieces one by one. The executors number the pieces of each length, in salted groups with prefix sums,
and read window and offset off the plan.

The ids are those of the ``tokenizers`` vocabulary file, read as it stands: the string of a special token is that token.
``tiktoken`` computes the same ids from the same vocabulary given as ranks, six times as fast, for texts without such
a string.

Edge cases: a null or empty text is the end id alone; a text of any length is cut, never shortened; pieces of equal
length are placed in order of id, start and CRC;
repeated rows are packed as often as they occur; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textscan import pieces

SIZE = 2048
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    exact = []  # read only where a text needs it

    def slow(text: str) -> list[int]:
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(json_path))
        return exact[0].encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    with open(json_path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except ValueError:  # its pattern gives up on very long runs
            return slow(text)

    return encode


def _pieces(tokenizer: tuple, size: int, end: int):
    def run(batches):
        encode = _encoder(*tokenizer)
        for piece in pieces(batches, "text", 4 << 20):
            ids, start, length, crc, total = [], [], [], [], []
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                tokens = np.array([*encode(text.as_py() or ""), end], "<u4")
                for a in range(0, len(tokens), size):
                    part = tokens[a : a + size]
                    ids.append(doc)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(tokens))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class _Room:
    """A segment tree over capacities 0 to ``size``; each leaf holds the intervals of windows with that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, room: int, low: int, high: int) -> None:
        if low < high:
            self.at[room].append((low, high))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        found = self.at[room].pop()
        self._mark(room)
        return found

    def _mark(self, room: int) -> None:
        k = room + self.leaves
        self.any[k] = bool(self.at[room])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that some window has."""
        k = need + self.leaves
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Best-fit decreasing over piece counts by length.

    Returns segments (length, first rank, first window, offset, pieces per window), in order of length
    and rank, and intervals (first window, end, room left)."""
    room, opened, segments = _Room(size), 0, []
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            fit = room.tightest(length)
            if fit is None:
                fit, (low, high) = size, (opened, opened + total - rank)
            else:
                low, high = room.take(fit)
            each = fit // length
            windows = min(high - low, (total - rank) // each)
            if not windows:
                windows, each = 1, total - rank
            segments.append((length, rank, low, size - fit, each))
            room.put(fit - each * length, low, low + windows)
            if high <= opened:
                room.put(fit, low + windows, high)
            opened = max(opened, low + windows)
            rank += windows * each
    rest = [(low, high, r) for r, at in enumerate(room.at) for low, high in at]
    return sorted(segments), sorted(rest)


def _place(segments, rest, size: int):
    table = np.array(segments, np.int64).reshape(-1, 5)
    key = table[:, 0] << 44 | table[:, 1]
    ends = np.array(rest, np.int64).reshape(-1, 3)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            k = rank - s[:, 1]
            window = s[:, 2] + k // s[:, 4]
            fill = size - ends[np.searchsorted(ends[:, 0], window, "right") - 1, 2]
            whole = np.where(fill & (fill - 1) == 0, fill, size)
            cols = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.record_batch([*cols, pa.array(window), pa.array(s[:, 3] + k % s[:, 4] * length), pa.array(whole)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

    return run


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as known

    return known.path("byte_bpe_50k.json"), known.path("byte_bpe_50k.tiktoken"), known.PATTERN


def pack(docs: DataFrame, tokenizer: tuple | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece its document, start, length, CRC and place; sequence_length is what its sequence is padded to.

    ``tokenizer``: the vocabulary file, and its ranks file and pattern or twice None."""
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer or default_tokenizer(), size, end), PIECES)
    cut = written(cut, "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    groups = written(cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    segments, rest = plan(counts, size)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("place", F.row_number().over(within)).join(offsets.hint("merge"), ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place") - 1).alias("rank"))
    return ranked.mapInArrow(_place(segments, rest, size), PIECES + ", sequence_id long, offset long, sequence_length long")
