import hashlib
import random
import re

from quadrille.llm.substring_dedup import repeated_words, without_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, n):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def longest(rows, n):
    """Brute force over the words themselves; only which windows are anchors comes from the operator's hashes."""
    import numpy as np
    import pyarrow as pa

    from quadrille.llm import substring_dedup as S

    split, hi = {}, {}
    for i, t in rows:
        data, off = S.text_bytes(pa.array([t or ""]))
        starts, ends, _ = S.spans(data, off)
        split[i] = WORD.findall(t or "")
        hi[i] = S.windows(S.word_hashes(data, starts, ends), n, 1) if len(starts) >= n else np.zeros(0, np.uint64)
    out = dict.fromkeys(split, 0)

    def holders(size):
        of = {}
        for i, w in split.items():
            for k in range(len(w) - size + 1):
                of.setdefault(tuple(w[k : k + size]), set()).add(i)
        return of

    size, one_in = 2 * n, S.ANCHORS
    alive = {(i, k) for i, h in hi.items() for k in range(len(h)) if int(h[k]) % S.ANCHORS == 0}
    short = holders(n)
    alive = {(i, k) for i, k in alive if len(short[tuple(split[i][k : k + n])]) > 1}
    while alive:
        of = holders(size)
        alive = {(i, k) for i, k in alive if int(hi[i][k]) % one_in == 0 and k + size <= len(split[i]) and len(of[tuple(split[i][k : k + size])]) > 1}
        for i, _ in alive:
            out[i] = size
        size, one_in = 2 * size, 2 * one_in
    return out


def test_longest_levels(spark):
    rng = random.Random(9)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(3000))
    rows = [(1, long), (2, "own words first " + long), (3, " ".join(long.split()[:200])), (4, "nothing of it")]
    got = {r.doc_id: r.longest_level for r in repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == longest(rows, 13) and got[1] == got[2] >= 416 and 26 <= got[3] <= 104 and got[4] == 0


def rows_of_all_kinds():
    rng = random.Random(3)
    words = ["a", "b", "é", "ñu", "c,", "dd", "x y"]
    rows = [(k, " ".join(rng.choice(words) + rng.choice("01") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    shared = " ".join(f"s{k}" for k in range(40))
    rows += [(100 + k, f"p{k}  \t{shared}\n\nq{k} " + shared[: 20 * k]) for k in range(12)]
    return rows + [(200, None), (201, ""), (202, " \n\t "), (203, "lone"), (204, rows[3][1]), (205, rows[3][1]), (206, " ".join(f"w{k % 20}" for k in range(3000)))]


def test_against_brute_force(spark):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)
    for n in (2, 5, 13):
        want = brute(rows, n)
        rows_ = repeated_words(df, n).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows_} == {i: v[:3] for i, v in want.items()}
        assert {r.doc_id: r.longest_level for r in rows_} == longest(rows, n)
        cut = without_repeats(df, n)
        assert cut.schema == df.schema
        assert {r.doc_id: (WORD.findall(r.text or ""), r.n_words) for r in cut.collect()} == {i: (v[3], "x") for i, v in want.items()}
        assert {r.doc_id for r in cut.where("text is null").collect()} == {200}


def test_many_chunks(spark):
    rows = rows_of_all_kinds()
    want = brute(rows, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_removed for r in repeated_words(df, 7, chunk_bytes=300).collect()} == {i: v[1] for i, v in want.items()}


def test_empty_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in repeated_words(df).collect())
    assert got == [(False, 0), (False, 0), (True, 20)]
    most = (1 << 63) - 1
    got = repeated_words(spark.createDataFrame([(most, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(most, 0)]


def longest_of_all(rows, n):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    out, size, alive = {i: 0 for i, _ in rows}, 2 * n, True
    while alive:
        of = {}
        for i, w in split:
            for k in range(len(w) - size + 1):
                of.setdefault(tuple(w[k : k + size]), set()).add(i)
        alive = {i for ids in of.values() if len(ids) > 1 for i in ids}
        out |= dict.fromkeys(alive, size)
        size *= 2
    return out


def test_longest_levels_of_every_window(spark):
    rng = random.Random(4)
    rows, k = rows_of_all_kinds(), 1000
    for size in list(range(24, 60)) + [103, 104, 207, 208, 415, 416]:  # few windows of a level, most of them no anchors
        passage = " ".join(f"r{rng.randrange(10**6)}" for _ in range(size))
        rows += [(k, f"a{k} {passage} b{k}"), (k + 1, f"c{k} d{k} {passage}")]
        # every 13 words of the next are found elsewhere, not all of them in one document
        rows += [(k + 2, " ".join(passage.split()[:20])), (k + 3, " ".join(passage.split()[5:]))]
        k += 10
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, chunk_bytes in ((2, 4 << 20), (5, 2000), (13, 4 << 20), (13, 1000)):
        want = longest_of_all(rows, n)
        got = repeated_words(df, n, chunk_bytes, every_window=True).collect()
        assert {r.doc_id: r.longest_level for r in got} == want
        assert want != longest(rows, n)  # anchors alone miss some
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: v[:3] for i, v in brute(rows, n).items()}


def test_query_looks_at_every_window(spark, tmp_path):
    from __spark_entry__ import queries

    passages = [" ".join(f"z{size}x{k}" for k in range(size)) for size in range(26, 46)]
    rows = [(2 * k + j, f"u{k}{j} {p} v{k}{j}") for k, p in enumerate(passages) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.longest_level for r in got} == {i: 26 for i, _ in rows} == longest_of_all(rows, 13)


def test_every_window_of_empty_tables_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words(empty, every_window=True).count() == 0
    text = " ".join(f"w{k}" for k in range(26))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (6, "w1"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.longest_level) for r in repeated_words(df, every_window=True).collect())
    assert got == [(5, 26), (5, 26), (6, 0), (7, 0), (99, 26)]
    got = repeated_words(df.where("doc_id > 4"), every_window=True).collect()
    assert {r.longest_level for r in got} == {0}


def workers_of_a_task(plan, stages):
    """The Python nodes of the stage that ``plan`` ends, each a worker of every task; those of the stages before go to ``stages``."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return workers_of_a_task(plan.executedPlan(), stages)
    inner = [plan.plan()] if "QueryStage" in name else [plan.children().apply(k) for k in range(plan.children().size())]
    n = sum(workers_of_a_task(x, stages) for x in inner) + (name == "MapInArrow")
    if "Exchange" in name:
        stages.append(n)
        return 0
    return n


def test_a_task_has_one_worker(spark, monkeypatch):
    from quadrille.llm import substring_dedup as S

    written, plans, stages = S.written, [], []

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan())
        return rows

    monkeypatch.setattr(S, "written", lambda df, name: (run(df), written(df, name))[1])
    passages = [" ".join(f"v{size}x{k}" for k in range(size)) for size in range(26, 60)]
    rows = [(2 * k + j, f"u{k}{j} {p} v{k}{j}") for k, p in enumerate(passages) for j in (0, 1)]
    got = run(repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_window=True))
    assert {r.doc_id: r.longest_level for r in got} == longest_of_all(rows, 13)
    for plan in plans:
        stages.append(workers_of_a_task(plan, stages))
    assert sum(stages) >= 7 and max(stages) == 1  # small tables, whose joins are broadcast, too
