import random

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest

from labarr.llm import queries, simhash, similar


def shingle_set(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def survivors(rows):
    """Smallest key of each component of pairs whose brute-force Jaccard is 0.8 or more."""
    sets, root = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posts = {}
    for k in sorted(sets):
        for other in {o for s in sets[k] for o in posts.get(s, ())}:
            if len(sets[k] & sets[other]) * 5 >= len(sets[k] | sets[other]) * 4:
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            posts.setdefault(s, []).append(k)
    return sorted(k for k in root if find(k) == k)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_stage_equals_brute_force_jaccard(spark, docs):
    rng = random.Random(3)
    texts = []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.choice([4, 5, 6, 9, 40, 120, 300]))]
        texts += [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 20))) for _ in range(12)]
        texts += [" ".join(base[: len(base) - rng.randrange(1 + len(base) // 5)]).upper() for _ in range(4)]
    line = [f"shared{i}" for i in range(30)]  # common to unlike texts
    texts += [" ".join(line + [f"u{k}v{i}" for i in range(rng.choice([5, 20]))]) for k in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs(rows), "").collect())
    assert got == survivors(rows)


def test_stage_catches_what_three_bits_do_not(spark, docs):
    base = [f"w{i}" for i in range(120)]
    near = " ".join(base[:60] + ["changed"] + base[61:])
    assert (simhash.fingerprint(" ".join(base).encode()) ^ simhash.fingerprint(near.encode())).bit_count() > 3
    got = corpus_pipeline.one_of_each(spark, docs([(2, near), (1, " ".join(base))]), "").collect()
    assert [r["doc_id"] for r in got] == [1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_equal_brute_force_jaccard(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = sorted(r["doc_id"] for r in similar.deduplicate(queries.table(spark, f"/root/testdata/{sf}", "documents")).collect())
    assert got == survivors(rows)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    known = np.sort(rng.integers(0, 400, 50)).astype(np.int64)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 80)))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 400, rng.integers(0, 8)))))
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            assert set(similar.prefix(a, known, known % 7)) & set(similar.prefix(b, known, known % 7))


def test_sketches_never_reject_similar_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 63, 64, 65, 200, 3000):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        b = np.unique(np.concatenate((a[rng.random(n) > 0.05], rng.integers(-(1 << 63), 1 << 63, n // 20))))
        x, y = sorted((similar.sketch(a), similar.sketch(b)), key=len)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_sketches_tell_unlike_sets_apart(spark, docs):
    sets = {k: [f"common{k % 3}"] * 3 + [f"t{k}w{i}" for i in range(400)] for k in range(40)}
    rows = docs([(k, " ".join(w)) for k, w in sets.items()])
    assert similar.deduplicate(rows).count() == 40


def test_odd_rows(docs):
    df = docs([(5, "Some  words here"), (3, "some words HERE"), (3, "some words here"), (8, "some words"), (None, "first text alone"), (None, "second differs"), (9, None), (10, ""), (11, " \n")])
    kept = similar.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["doc_id"] != 9) == [(-1, "first text alone"), (-1, "second differs"), (3, "some words HERE"), (8, "some words")]
    assert similar.deduplicate(df.limit(0)).collect() == []


def test_copies_meet_through_their_centre(spark, docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(150):  # similar to the first, not to each other
        words = list(base)
        for at in (rng.randrange(10, 55), rng.randrange(65, 110)):
            words[at] = f"e{k}"
        texts.append(" ".join(words))
    left, verified = [], similar._verified

    def counted(rows, points, pairs):
        left.append(pairs.count())
        return verified(rows, points, pairs)

    monkeypatch.setattr(similar, "_verified", counted)
    assert [r["doc_id"] for r in similar.deduplicate(docs(list(enumerate(texts)))).collect()] == [0]
    assert left[1] == 0  # no pair of copies needs comparison
