import corpus_pipeline
import pytest

TABLES = "/root/testdata/sf0.1"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    w = [x for y in w for x in y.split()]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(rows, least=0.8):
    """Every pair of different sets of that similarity, by counting the shingles that they share."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(i)
    both = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    found = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in both.items()}
    return {p: j for p, j in found.items() if j >= least - 1e-12}


def test_near_duplicates_of_the_table_against_brute_force(spark):
    """All documents: recall by similarity, and no link below it."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = alike(rows)
    root = {i: i for i, _ in rows}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((of(a), of(b)))
        root[y] = x
    blank = [i for i, t in rows if not shingles(t)]
    for i in blank:
        root[i] = min(blank)
    from quadrille.llm.simhash import similar_documents

    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert got == {i: of(i) for i, _ in rows}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        there = [p for p, j in pairs.items() if low <= j < high]
        assert there and all(got[a] == got[b] for a, b in there)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, TABLES).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_substring_stage_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 24):
            key = tuple(w[k : k + 25])
            first[key] = min(i, first.get(key, i))
    want = {}
    for i, w in rows:
        gone = {j for k in range(len(w) - 24) if first[tuple(w[k : k + 25])] < i for j in range(k, k + 25)}
        left = [x for k, x in enumerate(w) if k not in gone]
        if left:
            want[i] = left
    got = corpus_pipeline.substring_dedup(spark, docs, "").collect()
    assert {r.doc_id: r.text.split() for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_any_rows(spark, tmp_path, empty):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names; or no rows at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, first int, row string, n long, text_hash string, gumbel double, kept boolean, coverage int, item_ids string, length int, rank int, chunk int, body string, hits string"
    pad = (1, "r", 2, "h", 0.5, False, 3, "i", 4, 5, 6, "b", "h")
    long = " ".join(f"word{k}" for k in range(50_000))
    rows = [(1, long, "en", "s", 9), (2, None, None, None, None), (None, "no id here " * 9, "en", None, 5), (3, "", "en", "s", 0), (4, "the same row twice " * 20, "en", "s", 1), (4, "the same row twice " * 20, "en", "s", 1), (5, "...", None, "s", 3), (4, "another text of that id " * 12, "de", "s", 2)]
    docs = spark.createDataFrame([] if empty else [(*r, *pad) for r in rows], names).repartition(3)
    spark.createDataFrame([] if empty else [(1, 1, 0), (None, 1, 1), (4, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, "a passage of the benchmark that no document has at all"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is not corpus_pipeline.packed:
            assert out.schema == docs.schema, name
        counts[name] = sorted((r.doc_id or 0) for r in out.collect())
    if empty:
        assert all(not x for x in counts.values())
    else:
        assert counts["SimHash near-dedup"] == [0, 1, 2, 4, 4, 5]  # texts without words are alike, of equal rows one stays
        assert counts["substring dedup"] == [0, 1, 4, 4, 4, 5] and counts["benchmark decontamination"] == [0, 1, 2, 3, 4, 4, 4, 5]
        assert {*counts["packing"]} == {0, 1, 2, 3, 4, 5} and {*counts["quality classifier"]} <= {0, 1, 2, 3, 4, 5}


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = "the of and that with this from shing tion reas".split()
    prose = lambda n: " ".join("".join(rng.choice(words) for _ in range(2)) for _ in range(n))
    item, passage = prose(30), prose(70)
    texts = [prose(rng.randrange(60, 200)) for _ in range(60)]
    texts[10] = texts[3]
    texts[20] += " " + item
    texts[30], texts[31] = texts[30] + " " + passage, passage + " " + texts[31]
    bad = [" ".join(w + "%%%" for w in prose(90).split()) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + bad)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(72)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert {*range(60)} <= seen[0] and len(seen[0]) < 72
    assert seen[1] == seen[0] - {10} and seen[2] == seen[1] and seen[3] == seen[2] - {20} and seen[4] == seen[3]
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out-2").collect()}
    assert passage in cut[30].text and cut[31].text.strip() == texts[31][len(passage) :].strip() and cut[31].n_chars == len(cut[31].text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
