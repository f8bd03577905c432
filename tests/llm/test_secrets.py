import hashlib
import re

from labarr.llm import secrets
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(t):
    t = t or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(found)), [sum(x[2] == k for x in found) for k in ("assign", "access", "hex")]


HEX = "0123456789abcdef" * 3
TEXTS = [None, "", "password: hunter22", "password: short", "token=secret:password12", 'API_KEY = "abcdefgh"', "apikey:'x.y-z/+=_1'", "Secret =  abc\nTOKEN\t=abcdefgh1", "é🙂 token=12345678 é token=87654321", "AKIA" + "A" * 12 + " AKIAshort AKIAAKIA" + "B" * 9, "AKIA" * 9, HEX, HEX[:31] + " " + HEX[:32], "token=" + HEX, "x" * 60_000 + "passwd=12345678" + HEX, "token = token = token = abcdefgh", "passſword=12345678 toKen=12345678", "token= abcdefgh secret='abcdefgh' ", "a" * 40, f"token={HEX} " * 300]


def scan(df, **kw):
    return {r["doc_id"]: r for r in secrets.scan(df, **kw).collect()}


def test_base_spans_equal_brute_force(docs):
    got = scan(docs(list(enumerate(TEXTS))))
    for k, t in enumerate(TEXTS):
        spans, counts = brute(t)
        r = got[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts, t
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_ownership_tells_live_from_copied(spark):
    key = "ghp_" + "aB3" * 12
    mine = "ghp_" + "xY9" * 12
    rows = [(i, f"see {key} here", f"owner{i % 5}") for i in range(50)] + [(100, f"é {mine}", "owner1"), (101, f"{mine}!", "owner1"), (102, key, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = scan(df)
    assert "github:2:42" in got[100]["spans"] and got[100]["n_live"] == got[101]["n_live"] == 2  # as a token and as mixed characters
    assert "github" not in got[3]["spans"] and got[3]["n_example"] == 2 and got[3]["n_live"] == 0
    counts = {r["hash"]: (r["owners"], r["repos"]) for r in secrets.ownership(secrets.candidates(df, "text", ("doc_id",), "source", "doc_id")).collect()}
    assert sorted(counts.values()) == [(1, 2), (5, 51)]


def test_masking(spark, docs):
    rows = [(1, "é token=12345678 x"), (2, "nothing"), (3, None), (3, f"a {HEX} token={HEX}")]
    df = docs(rows)
    got = secrets.mask(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == [(1, "é [SECRET] x"), (2, "nothing"), (3, ""), (3, "a [SECRET] [SECRET]")]
    spans = F.expr("array(named_struct('start', 1L, 'end', 3L), named_struct('start', 2L, 'end', 5L), named_struct('start', 5L, 'end', 6L))")
    assert spark.range(1).select(secrets.redact(F.lit("0123456789"), spans, "#")).first()[0] == "0##6789"


def test_nulls_repeats_and_empty_tables(docs):
    df = docs([(None, "token=12345678"), (1, "a"), (1, "a")])
    assert sorted(r["n_assign"] for r in secrets.scan(df).collect()) == [0, 0, 1]
    assert secrets.scan(df.limit(0)).collect() == []
    assert secrets.scan(df, owner=None, repo=None).count() == 3


def test_very_many_secrets_in_one_text(docs):
    """Work grows in proportion to the matches of one text; places stay exact."""
    n = 10_000
    text = " ".join(f"é🙂 token={i:032x}" for i in range(n))
    got = scan(docs([(1, text)]))[1]
    spans, counts = brute(text)
    assert [got["n_assign"], got["n_access"], got["n_hex"]] == counts == [n, 0, n]
    assert got["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert secrets.mask(docs([(1, text)])).first()["text"] == " ".join(["é🙂 [SECRET]"] * n)


def test_masks_equal_brute_force(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r["text"] for r in secrets.mask(docs(rows)).collect()}
    found = {k: r["found"] for k, r in scan(docs(rows)).items()}
    for k, t in rows:
        out, at = "", 0
        for a, b in sorted((s["start"], s["end"]) for s in found[k]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[k] == ((out + t[at:]) if found[k] else t)


def test_an_example_that_one_owner_copies_widely_is_no_live_secret(spark):
    copied, mine = "ghp_" + "aB3" * 12, "ghp_" + "xY9" * 12
    rows = [(i, f"see {copied} here", "one") for i in range(20)] + [(100, mine, "one")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got[3]["n_live"] == 0 and got[3]["spans"] == "" and got[100]["n_live"] > 0 and "github" in got[100]["spans"]
