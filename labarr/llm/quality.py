"""Quality classification by nearest neighbours in a latent-semantic space.

Texts become counts of terms (words, triples of character classes and what the text
repeats), weighted by inverse document frequency and projected on the leading singular
vectors of a labelled sample. Cosines with every labelled vector are computed exactly, in
blocks; the nearest vote, weighted by similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, held_out, row_slices, sampled, small_batches

#: Labelled documents learned from, about; latent dimensions; neighbours that vote.
SAMPLE, LATENT, NEIGHBOURS = 4096, 48, 25
#: Characters that are classes of their own.
OWN = b" \n.,;:!?'\"|*$%&#@=-_/\\<>()[]{}+~^`"
_KINDS = len(OWN) + 6


def _classes() -> bytes:
    table = bytearray(256)
    for b in range(256):
        c = chr(b)
        table[b] = len(OWN) + (0 if c.islower() and b < 128 else 1 if c.isupper() and b < 128 else 2 if c.isdigit() and b < 128 else 3 if b in (9, 13) else 4 if b >= 128 else 5)
    for k, b in enumerate(OWN):
        table[b] = k
    return bytes(table)


_CLASS = _classes()
#: Terms: class triples and words, each folded to a prime number, then steps of how much is
#: repeated. WORD is what a text's words weigh together, its triples being 1.
_TRIPLES, _WORDS, _STEPS = 4093, 4093, 12
TERMS = _TRIPLES + _WORDS + 3 * _STEPS
WORD = 0.5


def terms(data: bytes) -> np.ndarray:
    """Term weights of one whole text: root of relative counts, length 1. Texts of fewer
    than three bytes have no triples, blank ones no words; all have the steps."""
    out = np.zeros(TERMS, np.float32)
    c = np.frombuffer(data.translate(_CLASS), np.uint8)
    if len(c) >= 3:
        for a in range(0, len(c) - 2, 1 << 20):
            part = c[a : a + (1 << 20) + 2].astype(np.int32)
            out[:_TRIPLES] += np.bincount((part[:-2] * (_KINDS * _KINDS) + part[1:-1] * _KINDS + part[2:]) % _TRIPLES, minlength=_TRIPLES)
        out /= out.sum()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if words:
        held = Counter(words)
        at = np.fromiter(map(crc32, held), np.int64, len(held)) % _WORDS
        out[_TRIPLES : _TRIPLES + _WORDS] = np.bincount(at, np.fromiter(held.values(), np.float64, len(held)), _WORDS) * (WORD / len(words))
    counts = (1 - len(held) / len(words) if words else 0, 1 - len(set(lines)) / len(lines) if lines else 0, min(1.0, np.log1p(len(data)) / 14))
    for k, share in enumerate(counts):
        out[_TRIPLES + _WORDS + k * _STEPS + min(_STEPS - 1, int(share * _STEPS))] = 0.02
    out = np.sqrt(out)
    out /= np.linalg.norm(out)
    return out


def _sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(x)
    return at.astype(np.int32), x[at]


class Model:
    """idf: weights of terms; axes: TERMS x latent; points, votes: the labelled vectors."""

    def __init__(self, sample: list, labels: list[int], latent: int = LATENT, held: np.ndarray | None = None, total: int = 0):
        """``sample`` has texts, or places and weights of their terms that are not zero.
        ``held`` says how many of ``total`` texts have each term; if left out, that is
        counted in the sample."""
        rows = [_sparse(terms(d)) if isinstance(d, bytes) else d for d in sample]
        if held is None:
            held, total = np.bincount(np.concatenate([at for at, _ in rows]), minlength=TERMS), len(rows)
        self.idf = np.where(held > 0, np.log((1 + total) / (1 + held)) + 0.1, 0).astype(np.float32)
        blocks = _Blocks([(at, w * self.idf[at]) for at, w in rows])
        self.axes = _leading(blocks, latent)
        self.points, self.votes = _unit(np.concatenate([x @ self.axes for x in blocks])), np.asarray(labels, np.float64)
        self.prior = float(self.votes.mean())

    def scores(self, texts: list[bytes], neighbours: int = NEIGHBOURS, sharp: int = 8) -> np.ndarray:
        """Votes of the nearest labelled vectors, weighted by the cosine's power ``sharp``.
        Cosines count to six decimals, and all that are as near as the last neighbour vote
        with it. Texts that are near to none get the share of label 1."""
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.points))
        for a in range(0, len(texts), 128):
            x = np.stack([terms(d) for d in texts[a : a + 128]])
            near = np.round(_unit((x * self.idf) @ self.axes) @ self.points.T, 6)
            last = np.partition(near, -k, axis=1)[:, -k]
            w = np.where(near >= last[:, None], np.maximum(near, 0), 0).astype(np.float64) ** sharp
            total = w.sum(axis=1)
            some = total > 1e-12
            out[a : a + len(x)][some] = (w @ self.votes)[some] / total[some]
        return np.clip(out, 0, 1)


class _Blocks:
    """Rows of (places, weights) as dense blocks, one at a time."""

    def __init__(self, rows: list, size: int = 256):
        self.rows, self.size = rows, size

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[np.ndarray]:
        for a in range(0, len(self.rows), self.size):
            part = self.rows[a : a + self.size]
            x = np.zeros((len(part), TERMS), np.float32)
            for row, (at, w) in zip(x, part, strict=True):
                row[at] = w
            yield x


def _leading(blocks: _Blocks, n: int, more: int = 32, steps: int = 12) -> np.ndarray:
    """The ``n`` leading right singular vectors of the blocks' rows, over all columns, by
    subspace iteration with ``more`` vectors than that."""
    width = min(n + more, len(blocks), TERMS)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, width)).astype(np.float32))[0]
    for _ in range(steps):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks))[0]
    _, _, turn = np.linalg.svd(np.concatenate([x @ q for x in blocks]), full_matrices=False)
    return (q @ turn.T)[:, :n].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from about ``sample`` labelled rows that are not held out, chosen by their
    key's hash. None without a labelled text. Of a key's labels the smallest counts, and of
    its texts the one whose terms sort first; labels that are null or not 0 or 1 are left
    out."""
    told = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    few = told.groupBy(F.col(key).alias(f"{T}key")).agg(F.min(F.col(label).cast("int")).alias("label"))
    some = sampled(few, few.count(), sample, f"{T}key")
    rows = df.select(F.col(key).alias(f"{T}key"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("data"))
    # the sample bounds the broadcast side; whole texts become vectors where they are read,
    # and only these, of a size that no text exceeds and one for each key, come to the driver
    got = _vectors(small_batches(rows).join(F.broadcast(some), f"{T}key")).groupBy("key").agg(F.min(F.struct("places", "weights", "label")).alias("x"))
    learned = sorted((bytes(r["places"]), bytes(r["weights"]), r["label"]) for r in got.select("x.*").toLocalIterator())
    if not learned:
        return None
    held, total = _frequencies(df, text)
    return Model([(np.frombuffer(p, "<u2").astype(np.int32), np.frombuffer(w, "<f4")) for p, w, _ in learned], [v for _, _, v in learned], held=held, total=total)


def _frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each term is, and the number of texts."""
    rows = small_batches(df).select(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1, np.int64)  # the last is the number of texts
        for batch in row_slices(batches, "data"):
            for data in batch.column("data").to_pylist():
                held[:TERMS] += terms(data) > 0
            held[TERMS] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in rows.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def _vectors(rows: DataFrame) -> DataFrame:
    """key, label, and the terms of data that are not zero: their places and weights."""
    rows = rows.select(F.col(f"{T}key").cast("string").alias("key"), "label", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "data"):
            found = [_sparse(terms(x)) for x in batch.column("data").to_pylist()]
            made = [[at.astype("<u2").tobytes() for at, _ in found], [w.astype("<f4").tobytes() for _, w in found]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), *(pa.array(m, pa.binary()) for m in made)], names=["key", "label", "places", "weights"])

    return rows.mapInArrow(run, "key string, label int, places binary, weights binary")


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.3, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 if score >= ``least``), named as in ``out``.

    Null texts are empty ones, on which labelled texts as short vote. Texts near to no
    labelled one get the learned share of label 1, all texts without a model 0.5. All that are
    as near as the last neighbour vote with it. Rows are independent; an empty table gives
    no rows.
    """
    rows = small_batches(df).select(*keep, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias(f"{T}text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # SAMPLE x LATENT and TERMS x LATENT
    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField(out[0], S.DoubleType()), S.StructField(out[1], S.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in row_slices(batches, f"{T}text"):
            got = own.scores(batch.column(f"{T}text").to_pylist()) if own else np.full(batch.num_rows, 0.5)
            made = [pa.array(got, pa.float64()), pa.array((got >= least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score, predicted; learns only from rows that are not held out."""
    model = fit(df, labels, key, text, label)
    rows = df.withColumn(f"{T}held", held_out(F.col(key)))
    return score(rows, model, text, (key, f"{T}held")).withColumnRenamed(f"{T}held", "held_out")
