"""Near duplicates by SimHash fingerprints and an inverted index over their byte positions.

A fingerprint has 8 bytes. Two that differ in at most ``max_bits`` bits differ in at most as many
bytes, so they share at least ``8 - max_bits`` positional bytes: the guaranteed minimum. The index lists
each fingerprint under the bytes at some choices of four positions, such that two fingerprints with the
guaranteed minimum agree in all four of at least one choice (2, 6 or 14 choices for 1, 2 or 3 bits). Single
bytes would have postings of a 256th of the table; four bytes keep them short however large it is.
For each pair that meets in a posting all shared positional bytes are tallied; pairs below the minimum
are dropped, the others are verified by their bits. The tally also names the one posting that may
report the pair.

Only distinct fingerprints are indexed, so copies never multiply. In a hot posting, of over ``HOT`` fingerprints,
pairs aren't enumerated: each member looks up its neighbours at every flip of bits in the four free positions,
which is exact too and grows with the members, not with their pairs. A posting of over ``SPLIT`` fingerprints is
split by further byte positions, again such that each pair meets. Links join fingerprints by their
smallest document, and components come from repeated distributed joins.

``similar_documents`` is for lower similarities, which few bits of 64 don't express: texts of similarity 0.8
differ in 4 to 18 bits. It links what the index finds and then completes that by an exact join on the
shingle sets; every link is verified on the sets, so links are neither missed nor added but for collisions
of 64-bit hashes. Two sets of the similarity differ in a bounded part of each. A set of which more is found
in no other set, among the shingles of a fixed share of the hash range, has no partner and is left out
before most shingles travel. Shingles of the rest are ordered by the number of sets that hold them, rarest first; two
sets of the similarity share one among the first ``size - ceil(similarity * size) + 1`` of both. Those
prefixes are posted, and every pair of a posting that its sizes and places allow is compared by the whole
sets. A passage that many documents share comes last in the order, behind what a document has alone.

Edge cases: a text with fewer words than a shingle is one shingle; one without words, or null, has
fingerprint zero and links like any other; very long texts are taken whole, each a batch of its own; a null
id counts as larger than any other, and the largest long is an id like any other; repeated rows share
fingerprint and component; documents at equal distance all link; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .textscan import LOWER, U64, mix, pieces, same_row, spans, text_bytes, windows, word_hashes

SEED = 42
HOT = 64
SPLIT = 1 << 16
_STEP = 1 << 17


def _normal(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes with the words of a row joined by one space, and the words' places there."""
    low = LOWER[data]
    starts, ends, row = spans(low, off)
    keep = np.zeros(len(low) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep, dtype=np.int8)[:-1] > 0
    inner = ends[:-1][row[:-1] == row[1:]] if len(row) else ends
    low[inner] = 0x20
    keep[inner] = True
    place = np.append(0, np.cumsum(keep))
    return low[keep].tobytes(), place[starts], place[ends], row


def _ones(hashes: np.ndarray, owner: np.ndarray, ones: np.ndarray) -> None:
    """Adds to ``ones`` (rows x 64) how often each bit is set in the hashes of each row; ``owner`` is sorted."""
    for a in range(0, len(hashes), _STEP):
        h, o = hashes[a : a + _STEP], owner[a : a + _STEP]
        first = _runs(o)[0]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[o[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)


def _majority(ones: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per row the bits that are set in over half of its ``count`` hashes."""
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")


def _fingerprints(shingle: int):
    def run(batches):
        digest = xxhash.xxh64_intdigest
        for piece in pieces(batches, "text", 1 << 20):
            data, off = text_bytes(piece.column(1))
            text, starts, ends, row = _normal(data, off)
            n = piece.num_rows
            words = np.bincount(row, minlength=n)
            count = np.maximum(words - shingle + 1, (words > 0).astype(np.int64))
            base = np.append(0, np.cumsum(words))[:-1]
            first = np.append(0, np.cumsum(count))
            ones = np.zeros((n, 64), np.int64)
            for a in range(0, int(first[-1]), _STEP):
                k = np.arange(a, min(a + _STEP, int(first[-1])))
                owner = np.searchsorted(first, k, "right") - 1
                at = k - first[owner] + base[owner]
                to = np.minimum(at + shingle, (base + words)[owner]) - 1
                _ones(np.array([digest(text[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[to].tolist())], np.uint64), owner, ones)
            yield pa.record_batch([piece.column(0).cast(pa.int64()), pa.array(_majority(ones, count).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _choices(max_bits: int) -> list[tuple[int, ...]]:
    """The four free byte positions of each posting: every ``max_bits`` positions lie within one choice."""
    planes = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]  # each three in exactly one
    if max_bits == 3:
        return planes
    if max_bits == 2:
        return [c for c in planes if c[0] ^ c[1] == 1]  # two of the pairs 01, 23, 45, 67
    return [(0, 1, 2, 3), (4, 5, 6, 7)]


def _bits(positions) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(max_bits: int):
    """Over rows (posting, shared, part, fp, rep) in order of the first three: the linked (a, b) by rep."""
    free = _choices(max_bits)
    parts = [list(combinations(f, max_bits)) for f in free]
    reports = np.full(256, -1, np.int64)  # by the set of differing bytes: the posting that reports such a pair
    within = np.full((len(free), 256), -1, np.int64)  # and where that is split, the part
    for k in reversed(range(len(free))):
        for n in range(1, max_bits + 1):
            for c in combinations(free[k], n):
                at = sum(1 << x for x in c)
                reports[at] = k
                within[k, at] = next(j for j, part in enumerate(parts[k]) if set(c) <= set(part))
    flips = np.array([sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(range(64), n)], np.uint64)

    def linked(posting, part, x, y):
        diff = x ^ y
        same = np.ascontiguousarray(diff).view(np.uint8).reshape(-1, 8) == 0
        enough = np.flatnonzero(same.sum(axis=1) >= 8 - max_bits)  # the tally against the guaranteed minimum
        differing = ~same[enough] @ (1 << np.arange(8))
        posting, part = (x[enough] if np.ndim(x) else x for x in (posting, part))
        own = (reports[differing] == posting) & ((part < 0) | (within[posting, differing] == part))
        return enough[own & (np.bitwise_count(diff[enough]) <= max_bits)]

    def found(posting, shared, part, fp, rep):
        new = np.append(True, (posting[1:] != posting[:-1]) | (shared[1:] != shared[:-1]) | (part[1:] != part[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(fp)))
        group = np.cumsum(new) - 1
        big = size > HOT
        for lag in range(1, int(size[~big].max(initial=1))):
            i = np.flatnonzero((group[:-lag] == group[lag:]) & ~big[group[:-lag]])
            i = i[linked(posting[i], part[i], fp[i], fp[i + lag])]
            yield rep[i], rep[i + lag]
        for g in np.flatnonzero(big):
            a, b = first[g], first[g] + size[g]
            order = np.argsort(fp[a:b])
            own, who = fp[a:b][order], rep[a:b][order]
            mask = np.uint64(_bits(free[posting[a]] if part[a] < 0 else parts[posting[a]][part[a]]))
            for flip in flips[(flips & ~mask) == 0]:
                other = own ^ flip
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                i = np.flatnonzero((own[at] == other) & (own < other))
                i = i[linked(posting[a], part[a], own[i], other[i])]
                yield who[i], who[at[i]]

    def run(batches):
        for posting, shared, part, fp, rep in _whole(batches, 3):
            pairs = list(found(posting.astype(np.int64), shared, part.astype(np.int64), fp.view(np.uint64), rep))
            a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(distinct: DataFrame, max_bits: int = 2, split: int = SPLIT) -> DataFrame:
    """(a, b): the reps of all pairs of ``distinct`` (fp, rep) within ``max_bits``."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    free = _choices(max_bits)

    def shared(positions) -> Column:
        return F.col("fp").bitwiseAND(F.lit(_signed(~_bits(positions) & ((1 << 64) - 1))).cast("long"))

    def posted(df: DataFrame, postings: list[tuple[int, int, Column]]) -> DataFrame:
        entry = [F.struct(F.lit(k).cast("byte").alias("posting"), at.alias("shared"), F.lit(j).cast("byte").alias("part")) for k, j, at in postings]
        return df.select("fp", "rep", F.explode(F.array(*entry)).alias("p")).select("p.posting", "p.shared", "p.part", "fp", "rep")

    rows = posted(distinct, [(k, -1, shared(c)) for k, c in enumerate(free)])
    large = written(rows.groupBy("posting", "shared").count().where(F.col("count") > split).select("posting", "shared"), "large")
    if not large.isEmpty():
        again = posted(distinct, [(k, j, shared(part)) for k, c in enumerate(free) for j, part in enumerate(combinations(c, max_bits))])
        whole = F.lit(None).cast("long")
        for k, c in enumerate(free):
            whole = F.when(F.col("posting") == k, F.col("shared").bitwiseAND(F.lit(_signed(~_bits(c) & ((1 << 64) - 1))).cast("long"))).otherwise(whole)
        again = again.withColumn("whole", whole)
        of = large.select("posting", F.col("shared").alias("whole"))
        rows = rows.join(large, ["posting", "shared"], "left_anti").union(again.join(of, ["posting", "whole"], "left_semi").select(*rows.columns))
    rows = rows.repartition("posting", "shared", "part").sortWithinPartitions("posting", "shared", "part")
    return rows.mapInArrow(_links(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint in hex, component_id and the number of fingerprints linked to its own."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = written(links(distinct.select("fp", F.col("fp").alias("rep")), max_bits), "links")
    named = components(found)
    degree = found.union(found.select("b", "a")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    of = distinct.join(named, distinct.fp == named.node, "left").join(degree, distinct.fp == degree.a, "left")
    of = of.select("fp", "least", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = prints.join(written(of.join(smallest, "component").select("fp", "component_id", "n_links"), "named"), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


# -- by similarity --

_SET_SEED = U64(0x243F6A8885A308D3)
_SLACK = 1e-9  # of float products such as 0.8 * 5
_PAIRS = 1 << 20
_SEEN = 1 << 20
SHARE = 0.3  # of the hash range, for leaving out sets without a partner
FEW_KEYS = 4_000_000  # as many keys, of 8 bytes, are broadcast; more are joined by a shuffle


def _sets(shingle: int):
    """Over batches (doc_id, text, ...): each piece, its rows' keys, fingerprint and size, and the distinct
    shingles of the rows one after the other. The key is a hash of the set, 0 for an empty one."""

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            data, off = text_bytes(piece.column(1))
            low = LOWER[data]
            starts, ends, row = spans(low, off)
            h = word_hashes(low, starts, ends)
            n = piece.num_rows
            at = np.flatnonzero(same_row(row, shingle))
            value, owner = (windows(h, shingle)[at], row[at]) if len(at) else (np.zeros(0, U64), at)
            words = np.bincount(row, minlength=n)
            short = np.flatnonzero((words > 0) & (words < shingle))  # fewer words: one shingle
            own = [windows(h[(a := np.searchsorted(row, k)) : a + words[k]], int(words[k])) for k in short]
            value, owner = np.concatenate([value, *own]), np.concatenate([owner, short])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, owner = value[new], owner[new]
            count = np.bincount(owner, minlength=n)
            have = np.flatnonzero(count)
            key, ones = np.zeros(n, U64), np.zeros((n, 64), np.int64)
            if len(have):
                first = np.append(0, np.cumsum(count))[:-1][have]
                key[have] = mix(np.add.reduceat(mix(value ^ _SET_SEED), first) ^ count[have].astype(U64))
                _ones(value, owner, ones)
            yield piece, key.view(np.int64), _majority(ones, count).view(np.int64), count, value, owner

    return run


def _own_share(value: np.ndarray) -> np.ndarray:
    return value < U64(int(SHARE * 2**64))


def _keys(shingle: int):
    def run(batches):
        for piece, key, fp, count, value, owner in _sets(shingle)(batches):
            held = np.bincount(owner[_own_share(value)], minlength=len(key))
            cols = [piece.column(0).cast(pa.int64()), piece.column(2), pa.array(key), pa.array(fp), pa.array(count.astype(np.int32)), pa.array(held.astype(np.int32))]
            yield pa.record_batch(cols, ["doc_id", "text_hash", "key", "fp", "size", "held"])

    return run


def _fresh(key: np.ndarray, seen: set) -> np.ndarray:
    """The rows whose keys this task hasn't had; it remembers a bounded number, since repeats do no harm."""
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    for k in np.flatnonzero(first):
        if int(key[k]) in seen:
            first[k] = False
        elif len(seen) < _SEEN:
            seen.add(int(key[k]))
    return first


def _sampled(shingle: int):
    """(shingle, key) of the shingles in the share of the hash range that decides on partners."""

    def run(batches):
        seen: set = set()
        for _, key, _, _, value, owner in _sets(shingle)(batches):
            i = np.flatnonzero(_fresh(key, seen)[owner] & _own_share(value))
            yield pa.record_batch([pa.array(value[i].view(np.int64)), pa.array(key[owner[i]])], ["shingle", "key"])

    return run


def _arrays(shingle: int):
    """(key, size, shingles) of every set."""

    def run(batches):
        seen: set = set()
        for _, key, _, count, value, _ in _sets(shingle)(batches):
            edge = np.append(0, np.cumsum(count))
            rows = np.flatnonzero(_fresh(key, seen) & (count > 0))
            for a in range(0, len(rows), 256):
                some = rows[a : a + 256]
                lists = pa.array([value[edge[k] : edge[k + 1]].view(np.int64) for k in some], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(key[some]), pa.array(count[some].astype(np.int32)), lists], ["key", "size", "shingles"])

    return run


def _in_several(batches):
    """Of rows (shingle, key) in that order: (key, n), the shingles of a key that another key has too, added up
    within a batch."""
    for shingle, key in _whole(batches):
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        shingle, key = shingle[new], key[new]
        c = _runs(shingle)[1]
        keys, n = np.unique(key[np.repeat(c, c) > 1], return_counts=True)
        yield pa.record_batch([pa.array(keys), pa.array(n)], ["key", "n"])


def _whole(batches, by: int = 1):
    """The sorted rows as arrays of whole groups: rows equal in the first ``by`` columns stay together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = [v[-1] for v in values[:by]]
        other = np.flatnonzero(np.logical_or.reduce([v != x for v, x in zip(values, last)]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and not cut and any(h[-1] != v[0] for h, v in zip(held[-1][:by], values)):
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in values])]
            held = []
        held.append([c[cut:] for c in values])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return first, np.diff(np.append(first, len(x)))


def _repeated(batches):
    """Of rows (shingle, key, size) in order of shingle and key: those of shingles that more than one key has,
    with the number of keys."""
    for shingle, key, size in _whole(batches):
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
        shingle, key, size = shingle[new], key[new], size[new]
        count = np.repeat(c := _runs(shingle)[1], c)
        i = np.flatnonzero(count > 1)
        yield pa.record_batch([pa.array(x) for x in (key[i], count[i].astype(np.int64), shingle[i], size[i])], ["key", "n", "shingle", "size"])


def _candidates(similarity: float):
    """Over rows (key, n, shingle, size) in that order: the sets that can have a partner, with their repeated
    shingles and how many of them, rarest first, are in the prefix. Shingles that no other set has come
    first in the order; where they fill the prefix there is no partner."""

    def run(batches):
        for key, _, shingle, size in _whole(batches):
            first, length = _runs(key)
            size = size[first].astype(np.int64)
            single = size - length
            prefix = size - np.ceil(similarity * size - _SLACK).astype(np.int64) + 1 - single
            for a in range(0, len(first), 256):
                i = np.flatnonzero(prefix[a : a + 256] > 0) + a
                if len(i):
                    sets = pa.array([shingle[first[k] : first[k] + length[k]] for k in i], pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(key[first[i]]), pa.array(size[i].astype(np.int32)), pa.array(np.minimum(prefix, length)[i].astype(np.int32)), sets], ["key", "size", "prefix", "shingles"])

    return run


def _neighbours(batches):
    """Of rows (shingle, size, key, ...) in that order: each key with the next of its posting."""
    for shingle, _, key, *_ in _whole(batches):
        i = np.flatnonzero(shingle[:-1] == shingle[1:])
        yield pa.record_batch([pa.array(np.minimum(key[i], key[i + 1])), pa.array(np.maximum(key[i], key[i + 1]))], ["a", "b"])


def _pairs(similarity: float):
    """Of rows (shingle, size, key, left, component) in that order, ``left`` being the members of the set from the
    shingle on: all pairs of a posting that are not joined yet and can have the similarity by their sizes and
    by what is left of both."""

    def run(batches):
        for shingle, size, key, left, component in _whole(batches):
            first, length = _runs(shingle)
            end = np.repeat(first + length, length)
            most = np.floor(size / similarity + _SLACK)
            # rows are in order of size within a posting, so partners of a row are the rows up to some place
            to = np.arange(len(key))
            for f, n in zip(first[length > 1].tolist(), length[length > 1].tolist()):
                to[f : f + n] = f + np.searchsorted(size[f : f + n], most[f : f + n], "right")
            many = np.maximum(np.minimum(to, end) - np.arange(len(key)) - 1, 0)
            total = np.cumsum(many)
            at = 0
            while at < len(key):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
                own = many[at:stop]
                x = np.repeat(np.arange(at, stop), own)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
                need = similarity / (1 + similarity) * (size[x].astype(np.int64) + size[y]) - _SLACK
                i = (component[x] != component[y]) & (np.minimum(left[x], left[y]) >= need)
                x, y = x[i], y[i]
                yield pa.record_batch([pa.array(np.minimum(key[x], key[y])), pa.array(np.maximum(key[x], key[y]))], ["a", "b"])
                at = stop

    return run


def _alike(similarity: float):
    """Of rows (a, b, size and shingles of both): the pairs of that Jaccard similarity at least. Shingles that
    only one set has are in no overlap."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                both = len(np.intersect1d(batch.column(4)[k].values.to_numpy(), batch.column(5)[k].values.to_numpy(), assume_unique=True))
                keep[k] = both * (1 + similarity) >= similarity * (int(na[k]) + int(nb[k])) - _SLACK
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 3, few_keys: int = FEW_KEYS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, component_id, and whether the row is the ``first`` of its
    component, by id and hash. Documents of a Jaccard similarity of their shingles of ``similarity`` or more
    are linked, others are not. Texts without a word are alike."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    prints = written(texts.mapInArrow(_keys(shingle), "doc_id long, text_hash long, key long, fp long, size int, held int"), "keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # sets of which too much is found nowhere else have no partner
    sampled = texts.mapInArrow(_sampled(shingle), "shingle long, key long").repartition(parts, "shingle").sortWithinPartitions("shingle", "key")
    common = sampled.mapInArrow(_in_several, "key long, n long").groupBy("key").agg(F.sum("n").alias("common"))
    distinct = prints.where("size > 0").groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("held").alias("held"))
    alone = F.col("held") - F.coalesce("common", F.lit(0)) > F.col("size") - F.ceil(F.col("size") * similarity - _SLACK)
    able = written(distinct.join(common, "key", "left").where(~alone).select("key", "fp"), "able")
    few = able.count() <= few_keys
    chosen = texts.mapInArrow(_arrays(shingle), "key long, size int, shingles array<long>")
    chosen = chosen.join(F.broadcast(able.select("key")) if few else able.select("key"), "key", "left_semi")

    members = chosen.select(F.explode("shingles").alias("shingle"), "key", "size").repartition(parts, "shingle").sortWithinPartitions("shingle", "key")
    repeated = members.mapInArrow(_repeated, "key long, n long, shingle long, size int").repartition(parts, "key").sortWithinPartitions("key", "n", "shingle")
    sets = written(repeated.mapInArrow(_candidates(similarity), "key long, size int, prefix int, shingles array<long>"), "sets")
    posted = sets.select("key", "size", F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("place", "shingle"), F.size("shingles").alias("held"))
    posted = posted.select("shingle", "size", "key", (F.col("held") - F.col("place")).alias("left"))

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "size", "key")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("key").alias(c), F.col("size").alias("n" + c), F.col("shingles").alias("s" + c)) for c in "ab")
        both = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb")
        return both.mapInArrow(_alike(similarity), "a long, b long")

    # first what the fingerprints' index links, and neighbours in postings: these join most of a large group,
    # whose other pairs then need no look
    of_fp = written(able.join(sets.select("key"), "key", "left_semi").groupBy("fp").agg(F.min("key").alias("rep")), "distinct")
    by_bits = links(of_fp, max_bits).union(able.join(of_fp, "fp").where("key <> rep").select("rep", "key"))
    by_bits = by_bits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = written(verified(by_bits.union(ordered(posted).mapInArrow(_neighbours, "a long, b long"))), "links")
    joined = written(components(near), "joined")
    known = posted.join(joined, posted.key == joined.node, "left").select("shingle", "size", "key", "left", F.coalesce("component", "key").alias("component"))
    rest = written(verified(ordered(known).mapInArrow(_pairs(similarity), "a long, b long")), "links")
    named = components(near.union(rest))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    of = prints.join(named, prints.key == named.node, "left").select(row.alias("row"), F.coalesce("component", "key").alias("component"))
    least = of.groupBy("component").agg(F.min("row").alias("least"))
    return of.join(least, "component").select("row.doc_id", "row.text_hash", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least")).alias("first"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near duplicates stays: that
    with the smallest id. Rows are told apart by id and text, so another text under the same id is judged by
    itself, and of equal rows one stays. Rows without an id stay."""
    names = docs.columns
    found = written(similar_documents(docs, shingle, similarity).where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n")), "rows")
    several = found.where("first and n > 1").select("doc_id", "text_hash")

    def joined(keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        return docs.join(k, (docs["doc_id"] == k["_id"]) & (F.xxhash64(docs["text"]) == k["_hash"]), how).select(*[docs[c] for c in names])

    kept = joined(found.where("not first or n > 1"), "left_anti")
    return kept if several.isEmpty() else kept.union(joined(several, "left_semi").dropDuplicates(["doc_id", "text"]))
