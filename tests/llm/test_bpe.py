import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from labarr.llm import bpe, queries

RANKS, PATTERN = queries.tokenizer()
WHOLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(df, **kw):
    return {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, RANKS, PATTERN, **kw).collect()}


def test_equals_the_library_on_every_character(spark, docs):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c != 0]
    rows = [(k, "".join(f"a{c} {c}{c}x" for c in every[k * 4000 : (k + 1) * 4000])) for k in range(-(-len(every) // 4000))]
    got = ids(docs(rows))
    for k, t in rows:
        assert got[k] == WHOLE.encode_ordinary(t), k


TEXTS = ["it's we'll  I'd \n\n\t x", "a" * 3000, " " * 700 + "\n" * 300 + "b", "1234567890" * 99, "".join(chr(0x4E00 + i % 500) for i in range(2000)), "ab'r" * 400, "x \n y\r\n " * 300, "!?" * 900, "é ñ ü " * 400, " \n" * 800, "we're" * 500]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 40), (257, 8), (50, 50)])
def test_chunks_are_stitched_to_the_same_pieces(spark, docs, chunk, overlap):
    rows = list(enumerate([*TEXTS, " ".join(TEXTS), ""]))
    got = ids(docs(rows), chunk=chunk, overlap=overlap)
    for k, t in rows:
        assert got[k] == WHOLE.encode_ordinary(t), (k, t[:30])


def test_nulls_repeats_empty_tables_and_decoding(spark, docs):
    df = docs([(1, None), (1, "same"), (1, "same"), (None, "x"), (2, "")])
    rows, n = bpe.encode(df, RANKS, PATTERN).collect(), len(WHOLE.encode_ordinary("same"))
    assert sorted((r["doc_id"] is None, len(r["token_ids"])) for r in rows) == sorted([(False, 0), (False, n), (False, n), (True, 1), (False, 0)])
    assert bpe.encode(df.limit(0), RANKS, PATTERN).collect() == []
    back = bpe.decode(bpe.encode(docs([(7, "Grüße \u0000 🙂"), (8, None)]), RANKS, PATTERN), RANKS, packed="packed")
    got = {r["doc_id"]: r for r in back.collect()}
    assert bytes(got[7]["decoded"]).decode() == "Grüße \u0000 🙂" and bytes(got[8]["decoded"]) == b"" == bytes(got[8]["packed"])
    assert np.frombuffer(got[7]["packed"], "<u4").tolist() == WHOLE.encode_ordinary("Grüße \u0000 🙂")
    assert public_tokenizers.PATTERN == PATTERN
