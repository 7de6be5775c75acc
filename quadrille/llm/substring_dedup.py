"""Removal of repeated word passages by level-wise doubling.

A passage counts from ``min_words`` words on. The levels are window lengths that at most double: half of
``min_words``, ``min_words``, then twice as many, and so on. Only windows that repeat at one length are extended to the
next, until no candidates survive.

* Half: a window of ``min_words`` words is represented by the smallest hash among its half-length windows. Equal
  passages choose equal representatives, so a quarter of the half windows is enough and no repeat is lost. This
  level only nominates.
* ``min_words``: windows whose representative repeats are compared in full. This level decides what is removed,
  whatever the full length of a passage.
* Twice that and beyond: these levels can't change what is removed; they tell how long the repeats are. They
  look at anchors, windows of ``min_words`` words chosen by the low bits of their hashes: one in ``ANCHORS`` at twice
  ``min_words``, half as many at each level after that, so that all of them together cost less than the deciding level.
  An anchor's window goes on to the next level only if another document has it too. ``longest_level`` is the greatest
  length at which one of a document's anchored windows was found in another document, 0 if none was.
* With ``every_window`` the anchors' answer is only a lower bound, and ``longest_level`` the greatest length at which any
  window of the document is in another one. A window of a level can only repeat if each window of ``min_words`` words
  in it does, which bounds a document's level from above. Where the bounds differ, the document asks: windows between
  them are represented by the smallest hash among their windows of ``min_words`` words, equal windows by equal
  ones, and all windows that have an asked representative, in whatever document, are compared in full.

Texts travel as compressed chunks of whole documents. Each chunk sends one entry per distinct window,
so a passage that a third of all documents shares reaches a reducer once per chunk, not once per
document. What comes back to a chunk are the repeated windows only; the chunk's own text turns them
into positions. Window keys carry 64 bits at the first level, which only nominates, and in the longer levels, and 96
at ``min_words``.

Edge cases: a null or blank text has no words and loses none; a very long text is a chunk of its own; a null
document id counts as larger than any other, and is returned as null; repeated rows with one id count as one
document, and repeats inside one document stay; of documents that tie in a passage the one with the smallest id keeps
it; an empty table gives an empty result; ``without_repeats`` keeps other columns, ``repeated_words`` ignores them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textscan import U64, _powers, mix, pieces, same_row, spans, text_bytes, windows, word_hashes

CHUNK_BYTES = 4 << 20
ANCHORS = 8
NULL_ID = (1 << 63) - 1
CHUNKS = "chunk long, body binary"
KEYS = "bucket int, chunk long, body binary"
HITS = "chunk long, hits binary"
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u4")])
_Q = 0xD1342543DE82EF95
_Q_INV = pow(_Q, -1, 1 << 64)


def _pack(level: int = 1, /, **arrays: np.ndarray) -> bytes:
    batch = pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level).compress(sink.getvalue())


def _unpack(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()


def _chunk(limit: int, level: int):
    def row(held, key):
        table = pa.Table.from_batches(held).combine_chunks()
        body = _pack(level, **{n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in zip(table.column_names, table.columns)})
        return pa.record_batch([pa.array([key], pa.int64()), pa.array([body], pa.binary())], ["chunk", "body"])

    def run(batches):
        key = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for piece in pieces(batches, "text", limit):
            n = piece.column(piece.schema.get_field_index("text")).nbytes
            if held and size + n > limit:
                yield row(held, key)
                held, size, key = [], 0, key + 1
            held.append(piece)
            size += n
        if held:
            yield row(held, key)

    return run


class _Words:
    """The words of a chunk and their windows."""

    def __init__(self, body: bytes):
        self.batch = _unpack(body)
        self.docs = self.batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()
        self.data, self.off = text_bytes(self.batch.column("text"))
        self.starts, self.ends, self.row = spans(self.data, self.off)
        self.h = word_hashes(self.data, self.starts, self.ends)

    def seeds(self, half: int, full: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions of full-length windows, and of each one's representative half window."""
        at = np.flatnonzero(same_row(self.row, full))
        h = windows(self.h, half)
        if not len(at):
            return at, at
        best, where = h[at], at.copy()
        for k in range(1, full - half + 1):
            x = h[at + k]
            less = x < best
            best[less], where[less] = x[less], at[less] + k
        return at, where

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), _KEY)
        out["hi"] = windows(self.h, n, 1)[at]
        out["lo"] = (windows(self.h, n, 2)[at] >> U64(32)).astype(np.uint32)
        return out


def _per_bucket(chunk: int, hi: np.ndarray, lo: np.ndarray | None, doc: np.ndarray, buckets: int):
    """Rows of KEYS: each bucket's distinct keys with their smallest document and whether a second has them."""
    if not len(hi):
        return
    order = np.lexsort((doc, hi) if lo is None else (doc, lo, hi))
    hi, doc = hi[order], doc[order]
    new = np.ones(len(hi), bool)
    new[1:] = hi[1:] != hi[:-1]
    if lo is not None:
        lo = lo[order]
        new[1:] |= lo[1:] != lo[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hi)) - 1
    low, many = doc[first], doc[last] != doc[first]
    hi = hi[first]
    lo = None if lo is None else lo[first]
    bucket = ((hi >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = []
    for a, b in zip(edge[:-1], edge[1:]):
        by = np.argsort(low[a:b], kind="stable") + a  # documents in order: their differences compress
        cols = {"hi": hi[by], "doc": np.diff(low[by], prepend=0), "many": many[by]}
        if lo is not None:
            cols["lo"] = lo[by]
        rows.append((int(bucket[a]), chunk, _pack(**cols)))
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "body"])


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def _seed_keys(half: int, full: int, buckets: int):
    def run(batches):
        for r in _rows(batches):
            w = _Words(r["body"])
            _, where = w.seeds(half, full)
            where = np.unique(where)
            yield from _per_bucket(r["chunk"], windows(w.h, half)[where] if len(where) else where.astype(U64), None, w.docs[w.row[where]], buckets)

    return run


def _anchored(hi: np.ndarray, one_in: int = ANCHORS) -> np.ndarray:
    return hi & U64(one_in - 1) == 0


def _reduce(wide: bool, firsts: bool = False):
    """Per bucket (its rows come together): the keys of two documents or more, for each chunk that has
    one of the later documents, and anchors and keys of a nominating level for any that has them. With
    ``firsts`` also 32 bits of each other key, for the chunk that has the first document only."""

    def bucket(rows):
        hi, lo, doc, many, owner = [], [], [], [], []
        for k, r in enumerate(rows):
            b = _unpack(r["body"])
            hi.append(b.column(0).to_numpy())
            doc.append(np.cumsum(b.column(1).to_numpy()))
            many.append(b.column(2).to_numpy(zero_copy_only=False))
            lo.append(b.column(3).to_numpy() if wide else np.zeros(0, np.uint32))
            owner.append(np.full(len(hi[-1]), k, np.int32))
        hi, lo, doc, many, owner = map(np.concatenate, (hi, lo, doc, many, owner))
        order = np.lexsort((doc, lo, hi) if wide else (doc, hi))
        hi, doc, many, owner = hi[order], doc[order], many[order], owner[order]
        new = np.ones(len(hi), bool)
        new[1:] = hi[1:] != hi[:-1]
        if wide:
            lo = lo[order]
            new[1:] |= lo[1:] != lo[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low = doc[first][group]
        differs = np.logical_or.reduceat(many | (doc != low), first)[group]
        later = many | (doc > low)
        keep = (later | (differs & _anchored(hi))) if wide else differs
        out = []

        def send(keep, **cols):
            cols, to = {n: c[keep] for n, c in cols.items()}, owner[keep]
            order = np.argsort(to, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(order))
            for a, b in zip(edge[:-1], edge[1:]):
                by = order[a:b]
                out.append((rows[int(to[by[0]])]["chunk"], _pack(**{n: c[by] for n, c in cols.items()})))

        send(keep, hi=hi, **({"lo": lo, "doc": low} if wide else {}))
        if firsts:
            send(differs & ~keep, first=(hi >> U64(32)).astype(np.uint32))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["chunk", "hits"])

    def run(batches):
        held = []
        for r in _rows(batches):
            if held and held[0]["bucket"] != r["bucket"]:
                yield from bucket(held)
                held = []
            held.append(r)
        if held:
            yield from bucket(held)

    return run


def _hits(bodies: list[bytes] | None) -> dict[str, np.ndarray]:
    found = [_unpack(b) for b in bodies or ()]
    names = dict.fromkeys(n for b in found for n in b.schema.names)
    return {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in found if n in b.schema.names]) for n in names}


def _within(keys: np.ndarray, hits: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` are among the hits, and the smallest document of each."""
    table = np.zeros(len(hits["hi"]), _KEY)
    table["hi"], table["lo"] = hits["hi"], hits["lo"]
    order = np.lexsort((table["lo"], table["hi"]))
    table, low = table[order], hits["doc"][order]
    both = np.concatenate([table, keys])
    rank = np.unique(both, return_inverse=True)[1]
    of = np.full(rank.max(initial=-1) + 1, -1, np.int64)
    of[rank[: len(table)]] = np.arange(len(table))
    at = of[rank[len(table) :]]
    return at >= 0, np.where(at >= 0, low[at], NULL_ID)


def _full_keys(half: int, full: int, buckets: int):
    def run(batches):
        for r in _rows(batches):
            hits = _hits(r["hits"])
            if not hits:
                continue
            w = _Words(r["body"])
            at, where = w.seeds(half, full)
            at = at[np.isin(windows(w.h, half)[where], hits["hi"])] if len(at) else at
            k = w.keys(at, full)
            yield from _per_bucket(r["chunk"], k["hi"], k["lo"], w.docs[w.row[at]], buckets)

    return run


def _flag(full: int):
    """Over chunks with their hits: the words, which of them go, the places of repeated anchors, and which
    windows another document has, as far as the hits tell (those by 32 bits may be wrong)."""

    def run(batches):
        for r in _rows(batches):
            w = _Words(r["body"])
            hits = _hits(r["hits"])
            mark = np.zeros(len(w.h) + 1, np.int64)
            again = np.zeros(len(w.h) + 1, bool)
            anchors = np.zeros(0, np.int64)
            if hits:
                at = np.flatnonzero(same_row(w.row, full))
                hi = windows(w.h, full, 1)[at]
            if "first" in hits:
                again[at[np.isin((hi >> U64(32)).astype(np.uint32), hits["first"])]] = True
            if "hi" in hits:
                at = at[np.isin(hi, hits["hi"])]
                found, low = _within(w.keys(at, full), hits)
                at, low = at[found], low[found]
                again[at] = True
                anchors = at[_anchored(windows(w.h, full, 1)[at])]
                at = at[w.docs[w.row[at]] > low]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + full, -1)
            yield r["chunk"], w, np.cumsum(mark)[:-1] > 0, anchors, again

    return run


def _long_windows(w: _Words):
    """A function of places and a length: the hashes of the windows there, from prefix sums over the words."""
    power, inverse = _powers(_Q, len(w.h) + 1), _powers(_Q_INV, len(w.h) + 1)
    sums = np.append(U64(0), np.cumsum(mix(w.h + U64(1)) * power[: len(w.h)]))
    return lambda a, n: mix((sums[a + n] - sums[a]) * inverse[a] ^ U64(n)).view(np.int64)


def _longer(w: _Words, anchors: np.ndarray, full: int) -> dict[int, list[np.ndarray]]:
    """By row: the hashes of each anchor's windows of twice ``full`` words, four times as many, ..., as far as
    the anchor takes part and the document goes."""
    words = np.append(np.flatnonzero(np.diff(w.row, prepend=-1)), len(w.row))
    end = words[np.searchsorted(words, anchors, "right")]
    hi = windows(w.h, full, 1)[anchors]
    long = _long_windows(w)
    keys: list[list[int]] = [[] for _ in anchors]
    n, one_in, alive = 2 * full, ANCHORS, np.arange(len(anchors))
    while True:
        alive = alive[(anchors[alive] + n <= end[alive]) & _anchored(hi[alive], one_in)]
        if not len(alive):
            break
        for k, x in zip(alive.tolist(), long(anchors[alive], n).tolist()):
            keys[k].append(x)
        n, one_in = 2 * n, 2 * one_in
    out: dict[int, list] = {}
    for k, x in enumerate(keys):
        if x:
            out.setdefault(int(w.row[anchors[k]]), []).append(x)
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the ``n`` values from each place on."""
    out, k = x, 1
    while 2 * k <= n:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(x) - n + 1], out[n - k :])


def _representatives(w: _Words, again: np.ndarray, full: int) -> dict[int, list[list[int]]]:
    """By row: the distinct representatives of its windows of twice ``full`` words, four times as many, ..., of
    which no part of ``full`` words is found in one document only."""
    hi = windows(w.h, full, 1)
    alone = np.append(0, np.cumsum(~again[: len(hi)]))
    out: dict[int, list] = {}
    n = 2 * full
    while n <= len(w.h):
        size = n - full + 1
        at = np.flatnonzero(alone[size:] == alone[:-size])  # parts overlap, so these windows lie in one row each
        if not len(at):
            break
        least, row = _least(hi, size)[at], w.row[at]
        new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]))
        least, row = least[new], row[new]
        order = np.lexsort((least, row))
        least, row = least[order], row[order]
        new = np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]))
        keys, row = mix(least[new] ^ U64(n)).view(np.int64), row[new]
        edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out.setdefault(int(row[a]), []).append(keys[a:b].tolist())
        n *= 2
    return out


def _digest(full: int, every_window: bool):
    def run(batches):
        for chunk, w, gone, anchors, again in _flag(full)(batches):
            edge = np.searchsorted(w.row, np.arange(len(w.docs) + 1))
            lost = np.append(0, np.cumsum(gone))[edge]
            sums = []
            raw = w.data.tobytes()
            for k in range(len(w.docs)):
                a, b = edge[k], edge[k + 1]
                s, e = w.starts[a:b][~gone[a:b]].tolist(), w.ends[a:b][~gone[a:b]].tolist()
                sums.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(s, e)])).hexdigest())
            longer, asked = _longer(w, anchors, full), _representatives(w, again, full) if every_window else {}
            keys, asks = (pa.array([x.get(k, []) for k in range(len(w.docs))], pa.list_(pa.list_(pa.int64()))) for x in (longer, asked))
            place = pa.array(np.arange(len(w.docs)))
            cols = [w.batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(edge)), pa.array(np.diff(lost)), pa.array(sums), pa.array([chunk] * len(w.docs), pa.int64()), place, keys, asks]
            yield pa.record_batch(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "chunk", "place", "anchors", "representatives"])

    return run


def _cut(full: int):
    """The texts without the flagged words; the white space after a removed word goes with it."""

    def run(batches):
        for _, w, gone, _, _ in _flag(full)(batches):
            drop = np.zeros(len(w.data) + 1, np.int64)
            end = w.off[w.row + 1]
            until = np.append(w.starts[1:], len(w.data))
            until = np.minimum(until, end)
            np.add.at(drop, w.starts[gone], 1)
            np.add.at(drop, until[gone], -1)
            keep = np.cumsum(drop)[:-1] == 0
            data = w.data[keep]
            off = np.append(0, np.cumsum(keep))[w.off]
            text = pa.Array.from_buffers(pa.large_string(), len(w.docs), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
            text = pc.if_else(w.batch.column("text").is_null(), None, text.cast(pa.string()))
            names = w.batch.schema.names
            yield pa.record_batch([text if n == "text" else w.batch.column(n) for n in names], names)

    return run


def _only(batches):
    """The chunks without the rows that aren't among their ``places``, with the places of those that are."""
    for r in _rows(batches):
        batch, places = _unpack(r["body"]), pa.array(sorted(r["places"]), pa.int64())
        cols = {n: batch.column(n).take(places) for n in ("doc_id", "text")}
        yield pa.record_batch([pa.array([r["chunk"]], pa.int64()), pa.array([_pack(**cols, place=places)], pa.binary())], ["chunk", "body"])


def _of_row(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(keys.view(U64) ^ mix(place.astype(U64)))


def _asked_windows(full: int):
    """Over reduced chunks with the (place, key) of asked representatives: the windows that these stand for."""

    def run(batches):
        for r in _rows(batches):
            w = _Words(r["body"])
            place = w.batch.column("place").to_numpy()
            want = _of_row(np.array([x["key"] for x in r["asked"]], np.int64), np.array([x["place"] for x in r["asked"]], np.int64))
            hi, long, n = windows(w.h, full, 1), _long_windows(w), 2 * full
            while n <= len(w.h):
                at = np.flatnonzero(same_row(w.row, n))
                if not len(at):
                    break
                key = mix(_least(hi, n - full + 1)[at] ^ U64(n)).view(np.int64)
                at = at[np.isin(_of_row(key, place[w.row[at]]), want)]
                row, key = w.row[at], long(at, n)
                cols = [np.full(len(at), r["chunk"]), place[row], w.docs[row], np.full(len(at), n), key]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["chunk", "place", "doc", "level", "key"])
                n *= 2

    return run


def _levels(docs: DataFrame, min_words: int, chunk_bytes: int, every_window: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk, body) and (chunk, body, hits) of every chunk: hits are its windows of ``min_words`` words that a smaller
    document has too."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    half, buckets = (min_words + 1) // 2, 4 * parts
    chunks = written(docs.mapInArrow(_chunk(chunk_bytes, 9 if every_window else 1), CHUNKS), "chunks")
    placed = chunks.repartition(parts, "chunk")

    def gathered(keys: DataFrame, wide: bool) -> DataFrame:
        rows = keys.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
        hits = rows.mapInArrow(_reduce(wide, wide and every_window), HITS)
        return hits.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list("hits").alias("hits"))

    # both joins below are left joins, so that one exchange of the chunks serves them both
    halves = gathered(chunks.mapInArrow(_seed_keys(half, min_words, buckets), KEYS), False)
    fulls = gathered(placed.join(halves, "chunk", "left").mapInArrow(_full_keys(half, min_words, buckets), KEYS), True)
    return chunks, placed.join(fulls, "chunk", "left")


def _extended(anchors: DataFrame, full: int) -> DataFrame:
    """(chunk, place, longest_level) of the rows with an anchored window that another document has. ``anchors``
    has (chunk, place, doc, keys); level by level, those whose window repeats are extended."""
    found, n, k = None, 2 * full, 1
    while not anchors.isEmpty():
        key = F.get("keys", F.lit(k - 1))
        several = anchors.groupBy(key.alias("key")).agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
        anchors = written(anchors.join(several, key == several["key"], "left_semi"), "level")
        now = anchors.select("chunk", "place", F.lit(n).cast("long").alias("level"))
        found = now if found is None else found.union(now)
        anchors = anchors.where(F.size("keys") > k)
        n, k = 2 * n, k + 1
    if found is None:
        return anchors.select("chunk", "place", F.lit(0).cast("long").alias("longest_level"))
    return found.groupBy("chunk", "place").agg(F.max("level").alias("longest_level"))


def _completed(rows: DataFrame, chunks: DataFrame, bound: DataFrame, full: int) -> DataFrame:
    """(chunk, place, longest_level) of the rows with any window that another document has: ``bound`` has what
    anchors found. Rows with representatives at levels beyond that ask for them."""
    held = rows.where(F.size("representatives") > 0).select("chunk", "place", "representatives")
    level = F.expr(f"shiftleft({2 * full}L, k)")
    undecided = (
        held.select("chunk", "place", F.size("representatives").alias("n")).join(bound, ["chunk", "place"], "left")
        .select("chunk", "place", F.coalesce("longest_level", F.lit(0)).alias("known"), (F.col("n") - 1).alias("k"))
        .where(level > F.col("known")).drop("k")
    )
    asks = (
        held.join(undecided, ["chunk", "place"]).select("known", F.posexplode("representatives").alias("k", "keys"))
        .where(level > F.col("known")).select(F.explode("keys").alias("key")).distinct()
    )
    keys = held.select("chunk", "place", F.explode(F.flatten("representatives")).alias("key"))
    asked = keys.join(asks, "key", "left_semi").groupBy("chunk").agg(F.collect_set("place").alias("places"), F.collect_list(F.struct("place", "key")).alias("asked"))
    asked = written(asked, "asked")
    # the places, a few bytes per row that takes part, go to the chunks; of the chunks only these rows are shuffled
    texts = chunks.join(F.broadcast(asked.select("chunk", "places")), "chunk").select("chunk", "places", "body").mapInArrow(_only, CHUNKS)
    # shuffled even where the next join needs no shuffle: else its tasks would run both functions at once, each in a worker of its
    # own, and executors keep all the workers they ever had, each as large as its largest chunk made it
    texts = texts.repartition("chunk")
    schema = "chunk long, place long, doc long, level long, key long"
    found = written(texts.join(asked.select("chunk", "asked"), "chunk").select("chunk", "body", "asked").mapInArrow(_asked_windows(full), schema), "asked-windows")
    several = found.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("key")
    more = found.join(several, "key", "left_semi").select("chunk", "place", F.col("level").alias("longest_level"))
    return bound.union(more).groupBy("chunk", "place").agg(F.max("longest_level").alias("longest_level"))


def repeated_words(docs: DataFrame, min_words: int = 13, chunk_bytes: int = CHUNK_BYTES, every_window: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, the SHA-256 of the kept words, and longest_level, which
    looks at every window or at anchors only."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, chunk long, place long, anchors array<array<long>>, representatives array<array<long>>"
    chunks, levels = _levels(docs, min_words, chunk_bytes, every_window)
    rows = written(levels.mapInArrow(_digest(min_words, every_window), schema), "digests")
    anchors = rows.where(F.size("anchors") > 0).select("chunk", "place", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.explode("anchors").alias("keys"))
    found = _extended(anchors, min_words)
    if every_window:
        found = _completed(rows, chunks, found, min_words)
    return rows.join(found, ["chunk", "place"], "left").select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("longest_level", F.lit(0)).cast("long").alias("longest_level"))


def without_repeats(docs: DataFrame, min_words: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without repeated passages."""
    return _levels(docs, min_words, chunk_bytes)[1].mapInArrow(_cut(min_words), docs.schema)
