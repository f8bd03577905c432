"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words is built on the driver from a checked size of text
(more text means more automata, one after the other) and broadcast. A document's words
are streamed through it; the longest match that ends at each word tells which windows of
items end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, materialize, row_slices, small_batches

#: Words of a window; characters of items in one automaton, at most.
WINDOW, SHARD = 10, 1 << 24
#: Bytes that are no part of a word become blanks, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``ends[v]`` lists (length, item ids) of windows that are words of state v; ``near[v]``
    is the closest state with such a list on the way of suffix links from v, or -1.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        told = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]) for name, text in items]
        told = [(name, seq) for name, seq in told if seq]
        for _, seq in told:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        held: dict[int, dict[int, set[str]]] = {}
        for name, seq in told:
            size, v = min(window, len(seq)), 0
            for i, c in enumerate(seq, 1):
                v = self.next[v][c]
                while self.length[self.link[v]] >= size and v:
                    v = self.link[v]
                # v now holds the last min(i, size) words or a longer sequence that always precedes them
                if i >= size:
                    held.setdefault(v, {}).setdefault(size, set()).add(name)
        self.ends = {v: [(n, sorted(names)) for n, names in by.items()] for v, by in held.items()}
        self.near = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[v] = v if v in self.ends else self.near[self.link[v]]
        self.least = min((n for e in self.ends.values() for n, _ in e), default=0)
        # which pairs of words follow each other in an item; pairs that share a bit only cost time
        self.bits = np.zeros(1 << 22, bool)
        for _, seq in told:
            self.bits[self._pairs(np.array(seq, np.int64))] = True

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 2654435761 + ids[1:] * 40503) & (len(self.bits) - 1)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged [start, end) words inside windows, items whose windows occur, and the
        longest match in words."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        longest = 0
        if not self.least or len(tokens) < self.least:
            return spans, names, longest
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
        for a, b in self._runs(ids):
            v = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    size = self.length[v]
                if c in self.next[v]:
                    v, size = self.next[v][c], size + 1
                longest = max(longest, size)
                u = self.near[v]
                while u > 0:
                    for n, owners in self.ends[u]:
                        if n <= size:
                            names.update(owners)
                            if spans and spans[-1][1] >= i + 1 - n:
                                # a longer window may reach back over earlier spans
                                start = i + 1 - n
                                while spans and spans[-1][1] >= start:
                                    start = min(start, spans.pop()[0])
                                spans.append((start, i + 1))
                            else:
                                spans.append((i + 1 - n, i + 1))
                    u = self.near[self.link[u]] if self.link[u] >= 0 else -1
        return spans, names, longest

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words outside of which no window can lie: each window is a chain
        of pairs that occur in items."""
        if self.least == 1:
            good = ids >= 0
        else:
            good = (ids[:-1] >= 0) & (ids[1:] >= 0)
            good &= self.bits[self._pairs(ids)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2] + (self.least > 1)
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def _shards(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in parts of at most ``most`` characters, or of one item."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).cast("string").alias("text")).filter("text is not null").orderBy("name", "text")
    part, held = [], 0
    for r in rows.toLocalIterator():
        if part and held + len(r["text"]) > most:
            yield part
            part, held = [], 0
        part.append((r["name"], r["text"].encode("utf-8", "surrogatepass")))
        held += len(r["text"])
    if part:
        yield part


def scan(df: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``keep``, n_words, spans (merged [start, end) words inside any window of an item),
    items (ids whose windows occur, sorted as strings) and longest (match, in words,
    within stretches that could hold a window).

    A window is ``window`` consecutive words of an item, or all of a shorter one; items
    without words have none. Null texts have no words; a null item id counts as an empty
    one; repeated items count once. Rows are independent; empty tables give no rows, and
    an empty benchmark no hits. With ``keep`` the text itself can be carried along.
    """
    found = _scan(df, items, text, keep, item_key, item_text, window, shard)
    return found.select(*keep, *(F.col(T + c).alias(c) for c in ("n_words", "spans", "items", "longest")))


def _scan(df: DataFrame, items: DataFrame, text: str, keep: tuple[str, ...], item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """As ``scan``, with names that no column of ``df`` has."""
    small_batches(df)
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    zero = F.lit(0).cast("long")
    made = {"text": F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), "n_words": zero, "spans": none("struct<start:bigint,end:bigint>"), "items": none("string"), "longest": zero}
    rows = df.select(*keep, *(c.alias(T + name) for name, c in made.items()))
    applied = False
    for part in _shards(items, item_key, item_text, shard):
        rows = _applied(materialize(rows, "decontam") if applied else rows, Automaton(part, window))
        applied = True
    rows = rows if applied else _applied(rows, Automaton([], window))
    return rows.withColumn(f"{T}items", F.array_sort(f"{T}items")).drop(f"{T}text")


def _applied(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """One automaton at a time is in an executor's memory; its size is bounded by a shard's."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    return rows.mapInArrow(_runner(shared, rows.columns), rows.schema)


def _runner(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = shared.value
        for batch in row_slices(batches, f"{T}text"):
            sizes, spans, items, longest = [], [], [], []
            before = zip(*(batch.column(names.index(T + c)).to_pylist() for c in ("spans", "items", "longest")), strict=True)
            for data, (s, i, n) in zip(batch.column(names.index(f"{T}text")).to_pylist(), before, strict=True):
                tokens = words(data)
                found, ids, most = own.scan(tokens)
                sizes.append(len(tokens))
                spans.append([{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s] + found)])
                items.append(sorted(ids.union(i)))
                longest.append(max(n, most))
            made = {f"{T}n_words": sizes, f"{T}spans": spans, f"{T}items": items, f"{T}longest": longest}
            yield pa.RecordBatch.from_arrays([pa.array(made[c], batch.schema.field(c).type) if c in made else batch.column(k) for k, c in enumerate(names)], schema=batch.schema)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(spans: Column) -> Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


@F.udf(S.StringType())
def _cut(text, spans):
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    ends = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    out, at = [], 0
    for s in spans:
        out.append(data[at : ends[s["start"]][0]])
        at = ends[s["end"] - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def clean(df: DataFrame, items: DataFrame, text: str = "text", max_span: int = 0, max_coverage: float = 1.0, **options) -> DataFrame:
    """The rows and columns of ``df`` without what the items leak into them.

    Spans of more than ``max_span`` words are cut out of the text, and rows of which
    more than ``max_coverage`` of all words lie in spans are left out.
    """
    found = _scan(df, items, text, tuple(df.columns), **options)
    covered, body = hits(F.col(f"{T}spans")), F.col(text)
    if max_coverage <= 0:  # rows with any span go, so none is left to cut
        return found.filter(covered == 0).select(*df.columns)
    kept = found.filter(covered <= F.col(f"{T}n_words") * max_coverage) if max_coverage < 1 else found
    cut = F.filter(f"{T}spans", lambda s: s["end"] - s["start"] > max_span)
    return kept.withColumn(text, F.when(F.size(cut) > 0, _cut(body, cut)).otherwise(body)).select(*df.columns)
