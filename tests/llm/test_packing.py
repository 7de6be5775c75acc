import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from tokenizers import Tokenizer

from quadrille.llm.packing import default_tokenizer, pack, plan


def one_by_one(lengths, size):
    """Rooms left after best-fit decreasing, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else size) - x)
    return rooms


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 31, 64, 2048])
    lengths = [rng.randint(1, size) for _ in range(rng.choice([1, 5, 300, 3000]))] + [rng.randint(1, size)] * rng.choice([0, 500])
    counts = {x: lengths.count(x) for x in set(lengths)}
    segments, rest = plan(counts, size)
    fill = {}
    for length, total in counts.items():
        own = [s for s in segments if s[0] == length]
        for s, end in zip(own, [*(x[1] for x in own[1:]), total]):
            for k in range(end - s[1]):
                fill.setdefault(s[2] + k // s[4], []).append((s[3] + k % s[4] * length, length))
    assert sorted(fill) == list(range(len(fill)))
    left = []
    for w, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        left.append(size - at)
        assert any(a <= w < b and r == size - at for a, b, r in rest)
    assert sorted(left) == one_by_one(lengths, size)


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "Ünïcode 的　x\r\n", "<|endoftext|> it's", "a <|endoftext|>b<|endoftext|>", "<|endoftext |>", "x" * 5000, " " * 3000]
    texts += [" ".join(rng.choice(["the", "Größe", "ab12", "...", "\n"]) for _ in range(rng.choice([3, 100, 3000, 9000]))) for _ in range(40)]
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(3, "a", 7), (None, "null id", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = pack(df).toPandas()
    exact = Tokenizer.from_file(default_tokenizer()[0])
    for i, t, _ in rows[:-2]:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert (got.doc_id == 3).sum() == 2 and got.doc_id.isna().sum() == 1
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.append(0, g.length.cumsum()[:-1])).all() and g.length.sum() <= g.sequence_length.iloc[0] <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_the_small_table(spark):
    """Every document's ids, by their CRC, against the vocabulary file's own encoder."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    exact = Tokenizer.from_file(default_tokenizer()[0])
    got = pack(docs).toPandas().sort_values("start").groupby("doc_id")
    for r in docs.collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got.get_group(r.doc_id)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist() and own.length.sum() == len(ids)
