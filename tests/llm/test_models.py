import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrille.llm import langid, quality_classifier, toxicity
from quadrille.llm.sampling import bounded_ids, fold

WORDS = {"en": "the of and that with this from ing tion er".split(), "de": "der die und nicht sich auf ung keit schön über".split(), "fr": "le la et que dans été où ment eau oux".split()}


def corpus(n=400):
    rng = random.Random(7)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(WORDS))
        w = ["".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(15, 80))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Vile,", "vile", "GRUBBY."])
        if bad:
            w = [x + rng.choice(["%%%", "$$$"]) for x in w]
        rows.append((k, " ".join(w), lang, int(not bad), int(toxic)))
    return rows


EDGES = [(None, "the of", "en", 1, 0), (900, None, "en", None, 1), (901, "", None, 1, None), (902, "123 ... \n", "de", 1, 0), (903, "ß" * 30, None, None, None), (5, "der die und", "de", 1, 0), (904, "the of and " * 20000, "en", 1, 0)]
SCHEMA = "doc_id long, text string, lang string, quality int, toxic int, score string, held_out int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 3) for r in rows], SCHEMA).repartition(3)


def test_fold(spark):
    import zlib

    df = spark.range(50).withColumn("f", fold(F.col("id")))
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())


def test_bounded_ids(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    ids = bounded_ids(df, 700)
    assert len(ids) == len(set(ids)) == 700 and ids == bounded_ids(df.repartition(7), 700)
    assert 300 < len(bounded_ids(df.union(df), 700)) <= 700
    assert bounded_ids(df.where("false"), 3) == [] and len(bounded_ids(df, 10**6)) == 5000


def test_trigram_counts_against_brute_force():
    texts = ["", "a", "Ab c", "  x\ty  ", "ß", "abab" * 9]
    got = langid.counts(*langid.text_bytes(pa.array(texts)))
    for t, row in zip(texts, got):
        b = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in b" " + t.encode() + b" ")
        want = np.zeros(langid.DIMS)
        for i in range(len(b) - 2):
            if b[i : i + 2] != b"  ":
                want[(int.from_bytes(b[i : i + 3], "big") * 2654435761 % 2**32 >> 20) & (langid.DIMS - 1)] += 1
        assert (row == want).all()


def test_long_texts_are_counted_slice_by_slice(monkeypatch):
    texts = pa.array(["Ab c  é" * 50, "", "x", " a  b " * 9])
    want = langid.counts(*langid.text_bytes(texts))
    monkeypatch.setattr(langid, "_SLICE", 7)
    assert (langid.counts(*langid.text_bytes(texts)) == want).all()


def test_predictions_against_brute_force(spark):
    """Each text's nearest centroid by plain loops over the model's numbers."""
    rows = corpus(150)
    df = table(spark, rows + EDGES)
    model = langid.train(df, per_language=25)
    assert len(model["names"]) <= 4 * 3 and model["centres"].shape == (len(model["names"]), langid.DIMS)
    got = {(r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(df, model).collect()}
    for i, text, *_ in rows:
        c = langid.counts(*langid.text_bytes(pa.array([text])))[0]
        v = [math.sqrt(x) * w for x, w in zip(c.tolist(), model["idf"].tolist())]
        norm = math.sqrt(sum(x * x for x in v))
        cos = [sum(x * y for x, y in zip(v, centre)) / norm for centre in model["centres"].tolist()]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert any((i, model["names"][best], round(cos[best] + d, 4)) in got for d in (-5e-5, 0, 5e-5))


def test_fitting_is_bounded_and_the_same_for_any_partitions(spark):
    df = table(spark, corpus(300) + [(7, "the of and", "en", 1, 0)] * 200)
    a, b = (langid.train(d, per_language=20) for d in (df, df.repartition(1)))
    assert a["names"] == b["names"] and np.allclose(a["centres"], b["centres"]) and np.allclose(a["limits"], b["limits"])


def test_toxic_scores_against_brute_force(spark):
    rows = corpus(300)
    df = table(spark, rows + EDGES)
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic", "text"))
    got = {r.doc_id: r.score for r in toxicity.predict(df, model).collect()}
    for i, text, *_ in rows:
        words = {w for w in re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(ch.lower() if ch.isascii() else ch for ch in text))}
        keys = {int(toxicity.word_sets(pa.array([w]))[0][0]) for w in words}
        z = model["bias"] + sum(float(model["weights"][k]) for k in keys)
        assert i == 5 or abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9  # two texts have id 5


def test_quality_weights_against_brute_force(spark):
    rows = corpus(200)
    df = table(spark, rows + EDGES).withColumn("gumbel", F.lit(1)).withColumn("log_weight", F.lit("x")).withColumn("kept", F.lit(0))
    ratio = quality_classifier.fit(df.drop("quality"), df.select("doc_id", "quality"))
    raw, good = {}, {}
    texts = [(r[0], r[1] or "", r[3]) for r in rows + EDGES]
    of = {}
    for i, text, q in texts:
        of[text] = quality_classifier.features(pa.array([text]))[1].tolist()
        for x in of[text]:
            raw[x] = raw.get(x, 0) + 1
            if i is not None and any(j == i and p == 1 for j, _, p in texts):
                good[x] = good.get(x, 0) + 1
    n, m, b = sum(raw.values()), sum(good.values()), quality_classifier.BUCKETS
    for x in random.Random(1).sample(sorted(raw), 200):
        assert abs(ratio[x] - (math.log((good.get(x, 0) + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b)))) < 1e-9
    got = {r.doc_id: r.log_weight for r in quality_classifier.sums(df, ratio).collect()}
    for i, text, _ in texts[:200]:
        if i != 5:
            assert abs(got[i] - sum(ratio[x] for x in of[text])) < 1e-6
    kept = quality_classifier.selected(df.drop("quality"), df.select("doc_id", "quality"), share=0.5)
    assert kept.schema == df.drop("quality").schema and kept.count() >= math.ceil(0.5 * len(texts))


def test_language(spark):
    rows = corpus()
    df = table(spark, rows + EDGES)
    got = langid.predict(df, langid.train(df, per_language=60)).collect()
    assert len(got) == len(rows) + len(EDGES)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.95 * len(held) and len(held) > 50
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 900}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[902].score == 0
    assert by[903].lang_pred != "und" and by[904].lang_pred == "en" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    blank = langid.predict(df, langid.train(df.where("false")))
    assert {(r.lang_pred, r.score) for r in blank.collect()} == {("und", 0.0)}
    assert langid.predict(df.where("false"), langid.train(df, 5)).count() == 0


def test_toxicity(spark):
    rows = corpus(1500)
    df = table(spark, rows + EDGES)
    docs, labels = df.drop("toxic"), df.select("doc_id", "toxic", "text")
    got = toxicity.predict(docs, toxicity.train(docs, labels)).collect()
    truth = {r[0]: r[4] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == len(rows) + len(EDGES)
    none = toxicity.predict(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.predict(docs.where("false"), toxicity.train(docs.where("false"), labels.where("false"))).count() == 0


def test_quality(spark):
    rows = corpus(600)
    df = table(spark, rows + EDGES)
    docs, labels = df.drop("quality"), df.select("doc_id", "quality", "text")
    got = quality_classifier.quality_sample(docs, labels).collect()
    truth = {r[0]: r[3] for r in rows}
    good = [r.kept for r in got if truth.get(r.doc_id) == 1]
    bad = [r.kept for r in got if truth.get(r.doc_id) == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.3 * len(bad)
    kept = quality_classifier.selected(docs, labels)
    assert kept.schema == docs.schema and sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in got if r.kept)
    ten = quality_classifier.quality_sample(docs, labels, share=0.1).where("kept").count()
    assert ten == -(-len(got) // 10)
    assert quality_classifier.quality_sample(docs, labels.where("false")).where("not kept").count() == 0
    assert quality_classifier.quality_sample(docs.where("false"), labels).count() == 0


def test_kth_greatest(spark):
    rng = random.Random(2)
    x = [rng.choice([rng.gauss(0, 1e-9), rng.gauss(0, 1e6), 3.0, 3.0000000000000004]) for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 2, 300, 450, 700, 899):
        assert quality_classifier.kth_greatest(df, "v", k, bins=16) == sorted(x, reverse=True)[k - 1]
