import random
import re

import pytest
import xxhash

from quadrille.llm.simhash import links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= bits:
                    label[a], changed = label[b], True
    return label


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "Aéñßz" for b in "abXü,"]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 400))] for _ in range(12)]
    rows = []
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(k // 30):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 - k, rng.choice([" ", "  ", " \n", "\t"]).join(w)))
    rows += [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one "), (6, "a b"), (7, "A  B")]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    prints = {i: fingerprint(t, 3) for i, t in rows}
    label = components(prints, 2)
    got = near_duplicates(df, 3, 2).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):
        x = rng.choice([centre, rng.getrandbits(64)]) if rng.random() < 0.3 else rng.choice(sorted(prints))
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 40, 63])
        prints.add(x)
    prints |= {centre ^ k for k in range(150)}
    prints = sorted(prints)
    rows = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(prints)]
    want = [(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= bits]
    for split in (1 << 16, 30):  # large postings are split by further positions
        got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in links(spark.createDataFrame(rows, "fp long, rep long"), bits, split).collect())
        assert got == want


def test_every_guaranteed_pair_meets():
    from itertools import combinations

    from quadrille.llm.simhash import _choices

    for bits, many in ((1, 2), (2, 6), (3, 14)):
        free = _choices(bits)
        assert len(free) == many and all(len(c) == 4 for c in free)
        assert all(any(set(d) <= set(c) for c in free) for d in combinations(range(8), bits))


def test_empty_and_null_id(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [None, None]
    most = (1 << 63) - 1
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (most, "a b c"), (None, "d e f")], "doc_id long, text string")).collect()
    assert sorted((r.fingerprint, r.component_id) for r in got if r.component_id) == [(got[0].fingerprint, most)] * 2


def test_similar_documents(spark):
    from quadrille.llm.simhash import similar_documents

    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows, groups = [], {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 500))]
        for k in range(4):
            w = list(base)
            for _ in range(k * len(w) // 200):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((4 * g + k, " ".join(w).upper() if k == 1 else " ".join(w)))
            groups[4 * g + k] = 4 * g
    alone = [(1000 + k, " ".join(rng.choice(words) for _ in range(100))) for k in range(40)]
    edge = [(2000, None), (2001, " "), (2002, "a b"), (2003, "A  B"), (None, "x y z u v w")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + alone + edge], "doc_id long, text string, p0 int").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert len(got) == len(rows) + len(alone) + len(edge)
    assert sum(got[i] == groups[i] for i in groups) >= 0.97 * len(groups)
    assert all(got[i] == i for i, _ in alone) and got[2001] == 2000 and got[2003] == 2002 and got[None] is None
    assert similar_documents(df.where("false")).count() == 0


def jaccard_components(rows, similarity=0.8):
    """Brute force: the smallest id of each component of the pairs alike by five-word shingles."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: root(i) for i in sets}


def test_similar_documents_that_share_a_passage(spark):
    """Postings of far more than 32 members, with pairs of 0.8 to 0.9 planted among them."""
    from quadrille.llm.simhash import similar_documents

    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = fresh(140), []
    for k in range(400):
        own = passage + fresh(60)
        rows.append((2 * k, " ".join(own)))
        if k < 60:
            own[-(8 + k % 12) :] = fresh(8 + k % 12)
            rows.append((2 * k + 1, " ".join(own)))
    want = jaccard_components(rows)
    assert sum(want[i] != i for i in want) == 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for few in (10**6, 0):  # the keys of sets that may have partners are broadcast or joined by a shuffle
        assert {r.doc_id: r.component_id for r in similar_documents(df, few_keys=few).collect()} == want


def test_one_row_of_each_group_stays(spark):
    from quadrille.llm.simhash import without_near_duplicates

    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(5, text("a")), (3, text("a") + " more"), (7, text("b")), (7, text("a")), (7, text("b")), (9, None), (8, " "), (None, text("b")), (4, text("c", 3)), (4, text("c", 3)), (6, text("d", 100_000))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, first int, text_hash string").repartition(3)
    got = without_near_duplicates(df)
    assert got.schema == df.schema
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in got.collect()) == [(0, "b0"), (3, "a0"), (4, "c0"), (6, "d0"), (7, "b0"), (8, " ")]
    assert without_near_duplicates(df.where("false")).count() == 0


def test_similar_documents_below_the_limit_stay(spark):
    """Pairs of 0.5 to 0.78 aren't linked, nor are chains of them; pairs of 0.8 and a bit are."""
    from quadrille.llm.simhash import similar_documents

    rng = random.Random(22)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, low = [], 0
    for k in range(240):
        own, new = fresh(204), 22 + k % 46  # of 200 shingles; so many at the end differ
        if k % 2:
            new = 14 + k % 9
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-new] + fresh(new)))]
        low += (200 - new) / (200 + new) < 0.8
    want = jaccard_components(rows)
    assert low > 100 and sum(want[i] != i for i in want) == 240 - low
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
