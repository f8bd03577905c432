import numpy as np
import pytest
from pyspark.sql import functions as F

from labarr.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_network_lookup_equals_the_plain_filters():
    net = langid.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (70, langid.WINDOW), dtype=np.uint8)
    x[3, 100:] = 0
    h, _ = net._pooled(x)
    plain = langid._softmax(np.tanh(h) @ net.dense + net.bias)
    assert net.predict(x) == pytest.approx(plain, abs=1e-5)


def test_long_texts_are_read_whole():
    net = langid.Network(["a", "b"])
    text = "abc " * 30_000
    whole = langid.windows(text.encode())
    p = net.predict(whole)
    held = np.full(len(whole), 256.0)
    held[-1] = len(text) % 256 or 256
    want = held @ p / held.sum()
    assert langid._told(net, [text])[0][1] == pytest.approx(want.max(), abs=1e-6)


def test_language_accuracy_on_held_out_documents(spark):
    docs = queries.table(spark, SF, "documents")
    got = queries.op8_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["a"] >= 0.97 and 0 <= r["lo"] and r["hi"] <= 1


def test_language_edge_cases(spark, docs):
    few = docs([(i, f"the cat {i} sat on the mat") for i in range(20)] + [(100, None), (101, "123 !?"), (102, ""), (None, "le chat"), (103, "the " * 50_000)])
    got = {r["doc_id"]: r for r in langid.identify(few).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (100, 101, 102))
    assert got[0]["lang_pred"] == got[103]["lang_pred"] == got[None]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert langid.identify(few.limit(0)).collect() == []
    untaught = docs([(1, "some words")], lang="x").withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(untaught).first()["lang_pred"] == "und"


def test_quality_on_held_out_documents(spark):
    got = queries.op9_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").filter("held_out")
    rows = got.select("quality", "predicted", "score").collect()
    good = [r["predicted"] == 1 for r in rows if r["quality"] == 1]
    bad = [r["predicted"] == 0 for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.85 and all(0 <= r["score"] <= 1 for r in rows)


def test_scores_equal_a_plain_vote():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abc XY.$!\n"), rng.integers(0, 200)).astype(np.uint8)) for _ in range(150)]
    model = quality.Model(texts[:100], [int(b"$" in t[:20]) for t in texts[:100]])
    got = model.scores(texts, neighbours=7)
    for t, s in zip(texts, got, strict=True):
        v = quality.terms(t)
        if not v.any():
            assert s == model.prior
            continue
        p = ((v * model.idf) @ model.axes).astype(float)
        cos = model.points.astype(float) @ (p / np.linalg.norm(p))
        best = np.argsort(-cos, kind="stable")[:8]
        if cos[best[6]] - cos[best[7]] < 1e-6:
            continue  # a tie at the edge
        w = np.maximum(cos[best[:7]], 0) ** 8
        assert s == pytest.approx((w * model.votes[best[:7]]).sum() / w.sum(), abs=1e-4)


def test_quality_edge_cases(spark, docs):
    df = docs([(i, "good prose, nicely put. " * 5 if i % 2 else "$$$ !!! ### " * 9) for i in range(40)] + [(100, None), (101, ""), (102, "x"), (None, "good prose, nicely put."), (103, "$$$ !!! ### " * 20_000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert got[1]["predicted"] == 1 and got[0]["predicted"] == 0 and got[103]["predicted"] == 0 and got[None]["predicted"] == 1
    assert got[100]["score"] == got[101]["score"] and len(got) == 45
    assert quality.classify(df.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
