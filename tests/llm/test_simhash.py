import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labarr.llm import simhash
from labarr.llm.components import components


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "A b c\x0bd  e", "É é  x y z", "w " * 5000, "the cat sat on the mat\x1c the cat"])
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint((text or "").encode()) == brute(text)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (60, 40), (60, 90), (300, 200)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        pairs += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2001 + i) for i in range(50)]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        want = union(pairs, {x for p in pairs for x in p})
        alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {k: v for k, v in want.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [2, 4096])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {0}
    for s in seeds:
        x = int(s)
        for _ in range(25):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
    for low in range(40):  # a crowded bucket: one high half, low halves few bits apart
        fps.add((7 << 32) | (1 << low % 32) | (low // 32))
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    points = spark.createDataFrame([(f, f) for f in signed], "id long, fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(points, block).collect()]
    by = dict(zip(signed, fps, strict=True))
    assert all((by[a] ^ by[b]).bit_count() <= 3 and a != b for a, b in edges)
    truth = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if (by[a] ^ by[b]).bit_count() <= 3]
    group = lambda pairs: sorted(map(tuple, _groups(union(pairs, signed))))
    assert group(edges) == group(truth)


def test_crowded_buckets_connect_what_all_pairs_connect(spark):
    """One half is the same in all fingerprints, or a bit off; the other is dense."""
    rng = np.random.default_rng(6)
    low = {int(x) & 0xFFFFFFFF for x in rng.integers(0, 1 << 12, 700)} | {int(x) << 20 for x in rng.integers(0, 1 << 11, 300)}
    fps = sorted({(9 << 32) | x for x in low} | {(11 << 32) | x ^ 3 for x in list(low)[::7]} | {(8 << 32) | x for x in list(low)[::5]})
    points = spark.createDataFrame([(f, f) for f in fps], "id long, fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(points, 16).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in edges)
    truth = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    group = lambda pairs: sorted(map(tuple, _groups(union(pairs, fps))))
    assert group(edges) == group(truth) and len(edges) < len(truth) / 4


def _groups(roots):
    out = {}
    for k, r in roots.items():
        out.setdefault(r, []).append(k)
    return [sorted(v) for v in out.values()]


def test_documents(docs):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base), (7, base.replace("w200 ", "changed ")), (1, "quite another text of its own"), (12, None), (10, ""), (11, " \n"), (None, base), (30, "x" * 200_000)]
    got = simhash.near_duplicates(docs(rows)).collect()
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert len(got) == 9 and by[9][1] == by[4][1] == by[7][1] == by[None][1] == 4 and by[1][1] == 1 and by[30][1] == 30
    assert by[12] == by[10] == by[11] == ("0" * 16, 10)
    for k, t in rows:
        assert by[k][0] == f"{brute(t):016x}"


def test_deduplicate_keeps_one_row_of_each(docs):
    base = " ".join(f"w{i}" for i in range(300))
    df = docs([(5, base), (3, base), (3, base), (8, "alone here now"), (None, "nobody knows"), (None, "nobody knows")])
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"][:5]) for r in kept.collect()) == [(-1, "nobod"), (3, "w0 w1"), (8, "alone")]
    assert simhash.deduplicate(df.limit(0)).collect() == [] and simhash.near_duplicates(df.limit(0)).collect() == []


def test_null_keys_of_different_texts_stay(docs):
    kept = simhash.deduplicate(docs([(None, "first text alone"), (None, "second one differs")]))
    assert kept.count() == 2
    assert kept.select(F.count("*")).first()[0] == 2
