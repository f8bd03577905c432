import re

from labarr.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan(df):
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


TEXTS = [None, "", " \n\t", "Released under the MIT License.", "under THE MIT-license under/the/mit/license cc by nc", "Apache License, Version 2.0", "apache license version 20", "CC BY-NC-SA ccby nc", "under the mıt license", "under the M\u0130T license cc by n\u212ac", "Kelvin \u212a sign", "é under the mit license é\u0301", "x" * 100_000 + " under the mit license", "cc by nc " * 20_000]


def test_base_places_equal_brute_force(docs):
    got = scan(docs(list(enumerate(TEXTS))))
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_templates_are_found_in_place_and_only_with_their_key_phrase(docs):
    rows = [(k, f"Header words.\n{t.upper()}, and more") for k, (_, _, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "software notice person copy permission granted " * 5), (101, licenses.TEMPLATES[0][2].replace("charge", "fee")), (102, licenses.TEMPLATES[0][2].replace("files", "some files"))]
    got = scan(docs(rows))
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(","), label
        assert got[k]["score"] == 1.0
    assert got[100]["labels"] == "" and got[101]["labels"] == "" and got[102]["labels"] == "mit"


def test_nulls_repeats_and_empty_tables(docs):
    df = docs([(None, "under the mit license"), (1, "a"), (1, "a")])
    assert sorted(r["labels"] for r in licenses.scan(df).collect()) == ["", "", "mit"]
    assert licenses.scan(df.limit(0)).collect() == []


def test_stays_in_the_jvm(docs):
    plan = licenses.scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
