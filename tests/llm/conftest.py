import pytest


@pytest.fixture
def docs(spark):
    """Rows as (doc_id, text) with columns that clash with what operators make."""

    def make(rows, **more):
        extra = {"n_words": 1, "spans": "x", "score": 2.0, "fingerprint": "f", "predicted": 3, "found": 4, "items": 5, "token_ids": 6, "fp": 7, "component_id": 8, "lang": "en", "source": "s"} | more
        return spark.createDataFrame([(i, t, *extra.values()) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in extra.items()))

    return make
