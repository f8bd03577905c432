"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths over one-hot bytes, the maximum over each window, softmax. A
text is read whole, as consecutive windows of fixed length; their probabilities are
averaged by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, chosen, drop_tables, held_out, materialize, row_slices, sampled_whole, small_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled documents learned from, at most, and bytes of their whole texts together.
SAMPLE, ROOM = 2048, 8 << 20
_LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last is filled up with zeros, as is an empty text's."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """tables[w][j]: 256 x FILTERS, what byte j of a filter of width w adds."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for t in self.tables.values():
            t[:, 0] = 0  # fill
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)
        self.lookup = None

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima over each row and where they are."""
        out, at = [], {}
        for w, table in self.tables.items():
            span = WINDOW - w + 1
            z = sum(table[j][x[:, j : j + span]] for j in range(w))
            at[w] = z.argmax(axis=1)
            out.append(np.take_along_axis(z, at[w][:, None], axis=1)[:, 0])
        return np.concatenate(out, axis=1), at

    def train(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on weighted cross-entropy of windows ``x``; ``share`` is a window's part of
        its text. Texts weigh the same however long, labels however rare."""
        rng = np.random.default_rng(seed)
        texts = np.bincount(y, share, minlength=len(self.labels))
        weight = (share * (len(y) / len(self.labels) / np.maximum(texts, 1e-9))[y]).astype(np.float32)
        params = [*self.tables.values(), self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                xb, yb, n = x[rows], y[rows], len(rows)
                h, at = self._pooled(xb)
                act = np.tanh(h)
                d = _softmax(act @ self.dense + self.bias)
                d[np.arange(n), yb] -= 1
                d *= (weight[rows] / n)[:, None]
                back = (d @ self.dense.T) * (1 - act**2)
                grads = []
                for k, (w, table) in enumerate(self.tables.items()):
                    g, own = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, at[w] + j, axis=1), np.arange(FILTERS)[None].repeat(n, 0)), own)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [act.T @ d, d.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def freeze(self) -> None:
        """Sum tables over byte pairs, so that a position needs two rows of a table."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
        t2, t3, t4 = (self.tables[w] for w in WIDTHS)
        self.lookup = (np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], axis=1), np.concatenate([pair(t3[2], np.zeros_like(t3[2])), pair(t4[2], t4[3])], axis=1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each row of windows."""
        if self.lookup is None:
            self.freeze()
        out, (head, tail) = [], self.lookup
        for a in range(0, len(x), 64):
            b = x[a : a + 64]
            code = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            z = head[code]
            z[:, :-2, FILTERS:] += tail[code[:, 2:]]
            # width 3 has one place more, that ends with the last byte
            z[:, -2, FILTERS : 2 * FILTERS] += tail[b[:, -1].astype(np.int32) * 256][:, :FILTERS]
            h = np.concatenate([z[:, :, :FILTERS].max(axis=1), z[:, :-1, FILTERS : 2 * FILTERS].max(axis=1), z[:, :-2, 2 * FILTERS :].max(axis=1)], axis=1)
            out.append(_softmax(np.tanh(h) @ self.dense + self.bias))
        return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, room: int = ROOM) -> Network | None:
    """A network from the whole texts of up to ``sample`` labelled rows, chosen by their
    key's hash, of at most ``room`` bytes together; None without a labelled text.

    Of a key's labelled texts the one that sorts first (by label, then text) counts.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.encode(F.col(text).cast("string"), "UTF-8").alias("data")).filter((F.length("data") > 0) & F.col("lang").isNotNull())
    # a key that many rows share is reduced to one text where its rows are read
    some = rows.filter(chosen(rows.count(), 8 * sample, "key")).groupBy("key").agg(F.min(F.struct("lang", "data")).alias("x"))
    held = materialize(some.select("key", "x.*", F.length("x.data").alias("size")), "langid-sample")
    got = sorted((bytes(r["data"]), r["lang"]) for r in sampled_whole(held, sample, room, "size", "key").select("lang", "data").toLocalIterator())
    drop_tables(labelled.sparkSession, [held])
    if not got:
        return None
    labels = sorted({x for _, x in got})
    net = Network(labels)
    parts = [windows(d) for d, _ in got]
    sizes = np.array([len(p) for p in parts])
    net.train(np.concatenate(parts), np.repeat([labels.index(x) for _, x in got], sizes), np.repeat(1.0 / sizes, sizes))
    net.freeze()
    return net


def predict(df: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score, the averaged probability of that language.

    A text that is null or holds no letter, and any text without a network, is ``und``
    with score 0. Ties between languages go to the first in order. Rows are independent;
    further columns are not read; an empty table gives no rows.
    """
    rows = small_batches(df).select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(f"{T}text"))
    shared = df.sparkSession.sparkContext.broadcast(net)  # a fixed size
    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in row_slices(batches, f"{T}text", 1 << 20):
            got = _told(own, batch.column(f"{T}text").to_pylist())
            made = [pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def _told(net: Network | None, texts: list[str]) -> list[tuple[str, float]]:
    """Language and score of each text. The windows of all texts are predicted together."""
    out = [("und", 0.0)] * len(texts)
    at = [i for i, t in enumerate(texts) if net is not None and _LETTER.search(t)]
    if not at:
        return out
    parts, held = [], []
    for i in at:
        data = texts[i].encode("utf-8", "surrogatepass")
        parts.append(windows(data))
        size = np.full(len(parts[-1]), float(WINDOW))
        size[-1] = len(data) - WINDOW * (len(size) - 1)
        held.append(size)
    first = np.cumsum([0] + [len(p) for p in parts[:-1]])
    weight = np.concatenate(held)
    p = np.add.reduceat(net.predict(np.concatenate(parts)) * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
    for i, k, row in zip(at, p.argmax(axis=1), p, strict=True):
        out[i] = (net.labels[k], float(min(1.0, max(0.0, row[k]))))
    return out


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score; learns only from rows that are not held out."""
    net = fit(df.filter(~held_out(F.col(key))), text, lang, key)
    return predict(df.withColumn(f"{T}held", held_out(F.col(key))), net, text, (key, f"{T}held")).withColumnRenamed(f"{T}held", "held_out")
