"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte trigrams (ASCII letters lower-cased, blanks as one boundary), damped
counts times inverse document frequency, normalised. Spherical k-means clusters the vectors of each
language; a text takes the language of the centroid with the greatest cosine. Beyond that centroid's
own distance limit, a low quantile of the cosines of its training texts, the prediction is flagged as
rejected; its nearest language is still named.

Fitting uses at most ``per_language`` labelled training documents of each language, those with the least hashes of
their ids, of which only trigram counts reach the driver; two scans find them, however many languages there are.
Prediction reads every text whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
could be learned; a very long text is counted slice by slice; ties go to the first language in order; repeated rows give
equal rows and count once in fitting; an empty table gives an empty result; only the id and the text are read for a
prediction, and other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold
from .textscan import BLANK, LOWER, pieces, text_bytes

DIMS = 4096
_SLICE = 1 << 22
_MAP = LOWER.copy()
_MAP[BLANK] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _grams(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram, and whether it counts: of blanks in a row only the last begins one."""
    gram = padded[:-2].astype(np.uint32) << 16 | padded[1:-1].astype(np.uint32) << 8 | padded[2:]
    return (gram * np.uint32(2654435761)) >> np.uint32(20), (padded[:-2] != 32) | (padded[1:-1] != 32)


def counts(data: np.ndarray, off: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Trigram counts of each row (rows x dims), a blank before and after each row."""
    n = len(off) - 1
    if len(data) > _SLICE:
        out = np.zeros((n, dims), np.float32)
        blank = np.full(1, 32, np.uint8)
        for k in range(n):
            for a in range(int(off[k]), int(off[k + 1]), _SLICE):
                b = min(a + _SLICE, int(off[k + 1]))
                before = blank if a == off[k] else _MAP[data[a - 1 : a]]
                after = blank if b == off[k + 1] else _MAP[data[b : b + 1]]
                key, inside = _grams(np.concatenate([before, _MAP[data[a:b]], after]))
                out[k] += np.bincount((key[inside] & np.uint32(dims - 1)).astype(np.int64), minlength=dims)
        return out
    size = np.diff(off)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), size) + 1
    padded[place] = _MAP[data]
    row = np.repeat(np.arange(n), size + 2)[:-2]
    key, inside = _grams(padded)
    end = np.cumsum(size + 2)
    inside[end[:-1] - 1] = inside[end[:-1] - 2] = False
    flat = row[inside] * dims + (key[inside] & np.uint32(dims - 1)).astype(np.int64)
    return np.bincount(flat, minlength=n * dims).reshape(n, dims).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next the vector farthest from all."""
    mean = v.mean(axis=0)
    centres = [v[np.argmax(v @ mean)]]
    while len(centres) < min(k, len(v)):
        centres.append(v[np.argmin((v @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.array([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(c: np.ndarray, langs: list[str], k: int = 4, quantile: float = 0.005) -> dict:
    """A model from trigram counts (documents x DIMS) and languages: idf, centroids, their languages and least cosines."""
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))).astype(np.float32) + 1
    v = vectors(c, idf)
    langs = np.array(langs, object)
    names, centres, limits = [], [], []
    for name in sorted(set(langs)):
        own = v[langs == name]
        found = _cluster(own, k)
        cos = own @ found.T
        near = cos.argmax(axis=1)
        for j, centre in enumerate(found):
            mine = cos[near == j, j]
            names.append(name)
            centres.append(centre)
            limits.append(float(np.quantile(mine, quantile)) if len(mine) else 0.0)
    return {"idf": idf, "names": names, "centres": np.array(centres, np.float32).reshape(-1, DIMS), "limits": np.array(limits)}


def _predict(model: dict):
    names = np.array([*model["names"], "und"], object)

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            col = piece.column(2)
            for a in range(0, len(col), 256):
                part = col.slice(a, 256)
                data, off = text_bytes(part)
                letters = np.append(0, np.cumsum(_ASCII_LETTER[data] if len(data) else np.zeros(0, bool)))
                has = letters[off[1:]] > letters[off[:-1]]
                for i in np.flatnonzero(~has & (np.diff(off) > 0)):
                    has[i] = any(ch.isalpha() for ch in part[int(i)].as_py())
                best, score, far = np.full(len(part), len(names) - 1), np.zeros(len(part)), np.ones(len(part), bool)
                if len(names) > 1 and has.any():
                    cos = vectors(counts(data, off), model["idf"]) @ model["centres"].T
                    near = cos.argmax(axis=1)
                    value = cos[np.arange(len(part)), near]
                    best[has], score[has], far[has] = near[has], np.clip(value[has], 0, 1), value[has] < model["limits"][near[has]]
                cols = [piece.column(0).slice(a, 256), piece.column(1).slice(a, 256), pa.array(names[best], pa.string()), pa.array(score), pa.array(far)]
                yield pa.record_batch(cols, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def _least(bound: int):
    """Over rows (lang, h, doc_id, text): for each language the trigram counts of the ``bound`` least by h, id and
    counts. A task holds twice as many at most."""

    def run(batches):
        held: dict[str, dict[tuple, None]] = {}
        for piece in pieces(batches, "text", 1 << 20):
            langs, h, ids = (piece.column(k).to_pylist() for k in range(3))
            for a in range(0, len(ids), 256):
                for k, row in enumerate(counts(*text_bytes(piece.column(3).slice(a, 256))), a):
                    at = np.flatnonzero(row)
                    own = held.setdefault(langs[k], {})
                    own[h[k], ids[k], at.astype("<u2").tobytes(), row[at].astype("<f4").tobytes()] = None
                    if len(own) > 2 * bound:
                        held[langs[k]] = dict.fromkeys(sorted(own)[:bound])
        for lang, rows in held.items():
            kept = sorted(rows)[:bound]
            for a in range(0, len(kept), 100):
                part = list(zip(*kept[a : a + 100]))
                yield pa.record_batch([pa.array([lang] * len(part[0])), *(pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))], ["lang", "h", "doc_id", "at", "n"])

    return run


def train(docs: DataFrame, per_language: int = 1000) -> dict:
    """A model from a bounded sample of the labelled training folds of ``docs`` (doc_id, text, lang)."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    limits = {r["lang"]: min(1.0, (1.5 * per_language + 64) / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not limits:
        return fit(np.zeros((0, DIMS), np.float32), [])
    h = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 30))
    table = docs.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in limits.items()], "lang string, most long")  # a row a language
    rows = known.join(F.broadcast(table), "lang").where((h < F.col("most")) & F.col("text").isNotNull())
    rows = rows.select("lang", h.alias("h"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_least(per_language), "lang string, h long, doc_id long, at binary, n binary")
    found = sorted({tuple(r[k] if k < 3 else bytes(r[k]) for k in range(5)) for r in rows.collect()})
    seen: dict[str, int] = {}
    chosen = [r for r in found if (seen.update({r[0]: seen.get(r[0], 0) + 1}) or seen[r[0]] <= per_language)]
    c = np.zeros((len(chosen), DIMS), np.float32)
    for k, r in enumerate(chosen):
        c[k, np.frombuffer(r[3], "<u2")] = np.frombuffer(r[4], "<f4")
    return fit(c, [r[0] for r in chosen])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score and rejected."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
