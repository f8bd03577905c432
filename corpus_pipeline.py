"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
rows are written and read again before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labarr.llm import bpe, decontam, quality, queries, secrets, similar
from labarr.llm.common import T, materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=tuple(docs.columns), out=(f"{T}score", f"{T}predicted"))
    return scored.filter(F.col(f"{T}predicted") == 1).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that five-word shingles with
    a Jaccard similarity of 0.8 or more connect: SimHash candidates, completed and verified."""
    return similar.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; the others are withheld."""
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each document, with digests of both directions."""
    ranks, pattern = queries.tokenizer()
    ids = bpe.encode(docs, ranks, pattern).withColumn("n_tokens", F.size("token_ids").cast("long"))
    # written first, so that a task needs one Python worker at a time
    ids = materialize(ids, "token-ids")
    back = bpe.decode(ids, ranks, keep=("doc_id", "n_tokens", "token_ids"), packed=f"{T}packed")
    return back.select("doc_id", "n_tokens", "token_ids", F.sha2(f"{T}packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: A model's votes can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
