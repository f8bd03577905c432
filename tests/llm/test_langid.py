import random

from labarr.llm import langid


def test_learns_from_the_whole_length_of_a_text(docs):
    rng = random.Random(1)
    head = "all texts of this source begin with the same long notice. " * 30
    word = {"aa": ["ka", "moto", "lani", "hoku"], "bb": ["strz", "wczy", "gdzi", "przy"]}
    body = lambda lang, n: " ".join(rng.choice(word[lang]) for _ in range(n))
    taught = docs([(i, head + body("aa", 900)) for i in range(60)], lang="aa").unionByName(docs([(i, head + body("bb", 900)) for i in range(60, 120)], lang="bb"))
    net = langid.fit(taught)
    got = langid._told(net, [body(x, 200) for x in ("aa", "bb")])
    assert [g[0] for g in got] == ["aa", "bb"] and min(g[1] for g in got) > 0.9


def test_learns_from_whole_texts(docs):
    """What tells the languages apart stands in one window somewhere in the middle."""
    same = "notice of all texts, again and again. " * 200
    rows = lambda ids, x: docs([(i, same + x * 30 + same) for i in ids], lang=x[:2])
    net = langid.fit(rows(range(40), "aa kamoto ").unionByName(rows(range(40, 80), "bb strzwczy ")))
    assert [g[0] for g in langid._told(net, ["kamoto " * 40, "strzwczy " * 40])] == ["aa", "bb"]


def test_a_key_that_many_rows_share_is_one_text(spark, docs):
    many = docs([(1, f"some words {i}") for i in range(300)] + [(i, f"other words {i}") for i in range(2, 30)])
    net = langid.fit(many, sample=16)
    assert net is not None and net.labels == ["en"]
    assert langid.fit(many, room=4) is None  # no text fits


def test_texts_together_are_what_they_are_alone():
    net = langid.Network(["a", "b", "c"])
    texts = ["x" * n + "é" for n in (0, 255, 256, 5000)] + ["", "12"]
    assert langid._told(net, texts) == [langid._told(net, [t])[0] for t in texts]
