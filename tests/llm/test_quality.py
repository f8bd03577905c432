import numpy as np

from labarr.llm import quality


def test_labelled_texts_are_learned_from_whole(spark, docs):
    head = "good prose, nicely put, with words of its own. " * 1_500  # more than 64 KiB
    junk, fine = head + "$$$ !!! ### " * 6_000, head + "more prose, quite as nicely put. " * 2_200
    df = docs([(i, (fine if i % 2 else junk) + " x" * (i % 7)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(38)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    assert list(model.scores([junk.encode(), fine.encode()], neighbours=5)) == [0, 1]
    length = slice(quality.TERMS - quality._STEPS, None)
    assert ((quality.terms(junk.encode())[length] > 0) <= (model.idf[length] > 0)).all()


def test_labelled_short_texts_vote_on_short_texts(spark, docs):
    df = docs([(i, "good prose, nicely put. " * (5 + i % 9)) for i in range(60)] + [(i, ["", "x", "?!", None][i % 4]) for i in range(60, 100)] + [(100, None), (101, ""), (102, "y"), (103, ".."), (104, "good prose, nicely put. " * 6)])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(df, labels).collect()}
    assert [got[k] for k in range(100, 105)] == [0, 0, 0, 0, 1]


def test_frequencies_are_of_all_texts_and_axes_of_all_terms(spark, docs):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(32, 127, 900))) for _ in range(60)] + [None]
    df = docs(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    x = np.stack([quality.terms((t or "").encode()) for t in texts])
    held = (x > 0).sum(axis=0)
    assert np.allclose(model.idf, np.where(held > 0, np.log((1 + len(x)) / (1 + held)) + 0.1, 0))
    full = quality.Model([t.encode() for t in texts[:60]], [i % 2 for i in range(60)])
    weighed = x[:60] * full.idf
    assert ((weighed > 0).any(axis=0)).sum() > 1536 and (np.abs(full.axes).max(axis=1)[(weighed > 0).any(axis=0)] > 0).all()
    want = np.linalg.svd(weighed, compute_uv=False)[: full.axes.shape[1]]
    assert np.allclose(np.linalg.norm(weighed @ full.axes, axis=0), want, rtol=1e-3)
