"""The pipeline held against plain versions of its stages."""

import re

import corpus_pipeline
import numpy as np
import tiktoken

from labarr.llm import quality, queries, secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def survivors(rows):
    """Smallest id of each component of pairs whose five-word shingles are 0.8 alike."""
    sets, root = {}, {k: k for k in rows}
    for k, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[k] = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in list(rows)[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [k for k in rows if find(k) == k]


def masked(rows, owner):
    """Texts without base secrets and without issued ones that few owners and documents hold."""
    found, held = {k: [] for k in rows}, {}
    for kind, pattern, least in [*secrets.BASE, *((k, p, 0) for k, p in secrets.ISSUED)]:
        group = int(kind == "assign")
        for k, t in rows.items():
            for m in re.finditer(pattern, t or "", re.ASCII):
                if len(m[group]) >= least:
                    found[k].append((*m.span(), kind, m[group]))
                    held.setdefault(m[group], []).append(k)
    base = {k for k, _, _ in secrets.BASE}
    out = {}
    for k, t in rows.items():
        text, at = "", 0
        for a, b, kind, key in sorted(found[k]):
            if kind in base or (len({owner[d] for d in held[key]}) <= 2 and len(set(held[key])) <= 8):
                text += t[at:a] + "[SECRET]" if a >= at else ""
                at = max(at, b)
        out[k] = text + (t or "")[at:]
    return out


def test_run_equals_plain_stages(spark):
    documents = queries.table(spark, SF, "documents").collect()
    rows, owner = {r["doc_id"]: r["text"] for r in documents}, {r["doc_id"]: r["source"] for r in documents}
    model = quality.fit(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    names = sorted(rows)
    scores = model.scores([rows[n].encode() for n in names])
    kept = survivors({n: rows[n] for n, s in zip(names, scores, strict=True) if s >= 0.3})
    grams = set()
    for r in queries.table(spark, SF, "benchmark").collect():
        w = WORD.findall(lower(r["text"]))
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    sizes = {len(g) for g in grams}

    def leaks(t):
        w = WORD.findall(lower(t))
        return any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))

    kept = [n for n in kept if not leaks(rows[n])]
    ranks, pattern = queries.tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == kept
    texts = masked({n: rows[n] for n in kept}, owner)
    for n in kept:
        assert got[n]["token_ids"] == encoding.encode_ordinary(texts[n]), n
        assert got[n]["n_tokens"] == len(got[n]["token_ids"])
    assert np.mean([s >= 0.3 for s in scores]) > 0.5


def test_stages_keep_the_columns_and_take_odd_rows(spark, docs):
    df = docs([(1, None), (2, ""), (2, ""), (None, "some text of no one"), (3, "plain words in a row, quite nicely put"), (4, "token=abcdefgh1234 and more words to read")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name != "encoding":
            assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), SF).collect() == [], name
        assert out.count() >= (3 if name == "near_duplicates" else 1)
