import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labarr.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, body in items:
        b = words(body)
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


def check(automaton, text, items, window):
    spans, names, _ = automaton.scan(decontam.words(text.encode()))
    assert (len(words(text)), sum(b - a for a, b in decontam.merged(spans)), sorted(names)) == brute(text, items, window)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc ", max_size=30), max_size=6), st.lists(st.text("abcd ", max_size=60), min_size=1, max_size=4), st.integers(1, 6))
def test_automaton_equals_brute_force(bodies, texts, window):
    items = [(str(k % 4), b) for k, b in enumerate(bodies)]
    automaton = decontam.Automaton([(n, b.encode()) for n, b in items], window)
    for t in texts:
        check(automaton, t, items, window)


def test_longer_inputs():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(rng.choice([3, 9, 10, 11, 40, 200]))) for i in range(40)]
    automaton = decontam.Automaton([(n, b.encode()) for n, b in items])
    for _ in range(60):
        own = items[rng.randrange(40)][1].split()
        a = rng.randrange(len(own))
        check(automaton, f"{say(30)} {' '.join(own[a : a + 25])}, {say(10)} {items[rng.randrange(40)][1].upper()}", items, 10)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


ITEMS = [("b", "one two three four five six seven eight nine ten eleven"), ("a", "Short item"), ("c", ""), ("d", None), (None, "null id item"), ("b", "one two three four five six seven eight nine ten eleven")]


@pytest.mark.parametrize("shard", [1, 1 << 24])
def test_documents(spark, docs, shard):
    rows = [(1, "x ONE two, three four five six seven eight nine ten y"), (2, "a short item here"), (3, None), (4, ""), (None, "short. ITEM"), (5, "null id item and short item"), (5, "nothing"), (6, "pad " * 100_000 + "short item"), (7, "one two three four five six seven eight nine x ten eleven")]
    got = decontam.scan(docs(rows), bench(spark, ITEMS), shard=shard).withColumn("hit", decontam.hits(F.col("spans"))).collect()
    clean = [(n or "", t) for n, t in ITEMS if t]
    want = sorted((k or -1, *brute(t, clean)) for k, t in rows)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["hit"], r["items"]) for r in got) == want


def test_clean(spark, docs):
    rows = [(1, "Keep this. short ITEM! And this é"), (2, "all fine"), (3, None), (4, "short item")]
    df = docs(rows)
    got = decontam.clean(df, bench(spark, ITEMS))
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Keep this. ! And this é", 2: "all fine", 3: None, 4: ""}
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench(spark, ITEMS), max_coverage=0.5).collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench(spark, ITEMS), max_coverage=0.0).collect()) == [2, 3]
    assert {r["text"] for r in decontam.clean(df, bench(spark, ITEMS), max_span=2).collect()} == {t for _, t in rows}


def test_empty_tables(spark, docs):
    df = docs([(1, "some words")])
    got = decontam.scan(df, bench(spark, [])).first()
    assert got["n_words"] == 2 and got["spans"] == [] and got["items"] == []
    assert decontam.scan(df.limit(0), bench(spark, ITEMS)).collect() == []
