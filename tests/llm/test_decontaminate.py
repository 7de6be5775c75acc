import random

import pytest

from quadrille.llm.decontaminate import Block, clean, overlaps, tiles


def plain(pattern, text, least):
    """Greedy string tiling without hashes: the greatest match first."""
    pm, tm, total = [False] * len(pattern), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and not pm[p + k] and not tm[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return sorted(total)
        pm[p : p + k] = tm[t : t + k] = [True] * k
        total.append(k)


def parts(found):
    return sorted(k for *_, k in found)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_are_greedy(seed):
    rng = random.Random(seed)
    letters = range(rng.choice([3, 30]))
    pattern = [rng.choice(letters) for _ in range(rng.randrange(1, 50))]
    text = [rng.choice(letters) for _ in range(rng.randrange(1, 60))]
    for _ in range(3):
        a = rng.randrange(len(pattern))
        text[rng.randrange(len(text)) :][:0] = pattern[a : a + rng.randrange(1, 30)]
        text += pattern[a : a + 12]
    least = rng.choice([2, 3, 5])
    found = tiles(pattern, text, least)
    seen_p, seen_t = set(), set()
    for p, t, k in found:
        assert pattern[p : p + k] == text[t : t + k] and k >= least
        assert not seen_p & {*range(p, p + k)} and not seen_t & {*range(t, t + k)}
        seen_p |= {*range(p, p + k)}
        seen_t |= {*range(t, t + k)}
    assert parts(found) == plain(pattern, text, least)


def test_tiles_of_small_alphabets():
    """Many ties and occluded matches: all lengths are those of the plain version."""
    rng = random.Random(77)
    for _ in range(1500):
        letters = range(rng.randrange(2, 7))
        pattern, text = ([rng.choice(letters) for _ in range(rng.randrange(1, 26))] for _ in "pt")
        assert parts(tiles(pattern, text, 2)) == plain(pattern, text, 2)


def test_tiles_of_one_word():
    assert parts(tiles([1] * 40, [1] * 8000, 5)) == [40] and parts(tiles([1] * 8000, [1] * 40, 5)) == [40]
    assert tiles([], [1, 2, 3], 2) == tiles([1], [1], 2) == []


def covered(item, text, seed=5):
    """The marked share of an item, from the whole texts."""
    n = min(seed, len(item))
    return sum(plain(item, text, n)) / len(item) if item else 0.0


def test_coverage_against_brute_force(spark):
    """Reordered, cut and diluted passages; coverage on both sides of the threshold, ties, repeated rows, clashing columns."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randrange(1, 40))] for _ in range(8)] + [["w1"] * 20]
    rows = []
    for k in range(70):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        own = items[k % 9]
        cuts = sorted(rng.randrange(len(own) + 1) for _ in range(rng.randrange(0, 3)))
        pieces = [own[a:b] for a, b in zip([0, *cuts], [*cuts, len(own)])]
        rng.shuffle(pieces)
        for x in pieces[: rng.randrange(len(pieces) + 1)]:
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        rows.append((k, " ".join(w)))
    rows += [rows[3], (900, " ".join(["w1"] * 5000 + [f"x{k}" for k in range(100_000)]))]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, contaminated int, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in overlaps(df, bench).collect()}
    for i, t in rows:
        have = {k: covered(w, t.split()[:6000]) for k, w in enumerate(items)}
        have = {k: c for k, c in have.items() if c >= 0.8}
        assert got[i].item_ids == sorted(have) and abs(got[i].coverage - max(have.values(), default=0)) < 1e-12
    assert sum(r.contaminated for r in got.values()) > 10 and sum(not r.contaminated for r in got.values()) > 10


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)] + ["Éa", "ñu"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, text(rng.randrange(15, 50))) for k in range(12)] + [(50, ["short", "item", "xx"])]
    rows, want = [], {}
    for k in range(60):
        w, hit = text(rng.randrange(0, 300)), []
        if k % 3 == 0:
            i, own = items[k % 13]
            half = len(own) // 2
            parts = [own] if k % 2 else [own[half:], own[:half]]
            if i == 50:
                parts = [own]
            for part in parts:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + ["glue"] + [x.upper() + "," for x in part] + w[at:] if at == 0 or at == len(w) else [*part, "glue", *w]
            hit = [i]
        if k % 7 == 1:
            w = w + items[1][1][: len(items[1][1]) // 2]
        rows.append((k, " ".join(w)))
        want[k] = hit
    edge = [(100, None), (101, ""), (102, "!?"), (None, " ".join(items[0][1])), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "c", 1.5) for i, t in rows + edge], "doc_id long, text string, item_ids string, coverage double").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(60, None), (61, ""), (None, "a b c d e f g")], "item_id long, text string")
    got = overlaps(df, bench).collect()
    assert len(got) == len(rows) + len(edge)
    for r in got:
        if r.doc_id is not None:
            assert r.item_ids == want.get(r.doc_id, []) and r.contaminated == bool(r.item_ids)
    many = overlaps(df, bench, block_words=60).collect()
    key = lambda x: sorted(map(repr, x))
    assert key(many) == key(got)
    kept = clean(df, bench)
    assert kept.schema == df.schema and kept.count() == sum(not r.contaminated for r in got)
    assert overlaps(df.where("false"), bench).count() == 0
    assert overlaps(df, bench.where("false")).where("contaminated").count() == 0
    assert clean(df, bench.where("false")).count() == len(got)


def test_empty_block():
    import pyarrow as pa

    assert Block([1], ["..."], 5).scan(pa.array(["a b", None]), 0.8) == [[], []]
