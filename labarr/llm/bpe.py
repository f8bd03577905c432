"""Byte-level BPE encoding and decoding.

Texts are cut into chunks that overlap; chunks are pre-tokenised independently of each
other, on any machine; neighbours are stitched at a boundary that both found in their
overlap; the pieces between boundaries are then encoded. Where an overlap has no common
boundary (one endless word), the left chunk's tokenisation is carried on, so results are
those of the whole text in every case. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, materialize, row_slices, small_batches

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary is sure if at least so many characters follow it within the chunk: the
#: pattern's longest look past a match (a contraction) plus one.
MARGIN = 4
#: Pieces that a worker remembers; its memory is emptied when full.
REMEMBERED = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Encoder:
    """Splits texts into pieces and encodes pieces; one lives in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        # a pattern that takes everything: the library then merges one whole piece
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}  # ids as packed integers

    def encode(self, pieces: Iterable[str], out: array) -> None:
        known = self.known
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = array("i", self.merge(piece)).tobytes()
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.frombytes(ids)

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Sure starts of matches in text[begin:end], as positions of ``text``."""
        found = [m.start() for m in self.pattern.finditer(text[begin:end])]
        sure = end - begin if end >= len(text) else end - begin - MARGIN
        return [begin + x for x in found if x <= sure]


def stitch(encoder: Encoder, text: str, starts: list[list[int]], step: int, overlap: int) -> list[int]:
    """All boundaries of ``text``, from the sure ones of each chunk (positions of text).

    Matching depends only on what follows, so from a common boundary on a later chunk's
    boundaries are those of the whole text.
    """
    out = list(starts[0])
    for k in range(1, len(starts)):
        own, begin = starts[k], k * step
        found = set(own[: bisect_left(own, begin + overlap + 1)])
        i = next((i for i in range(bisect_left(out, begin), len(out)) if out[i] in found), None)
        if i is None:
            # go on by ourselves through this chunk
            at = out[-1] if out else 0
            out[-1:] = encoder.starts(text, at, min(len(text), begin + step + overlap)) or [at]
        else:
            out[i:] = own[bisect_left(own, out[i]) :]
    return out


def _chunks(keep: list[str], text: str, step: int, overlap: int):
    """Rows of (keep, row, k, chunk) of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, text):
            for row in batch.to_pylist():
                whole = row[text]
                for k, at in enumerate(range(0, max(1, len(whole) - overlap), step)):
                    part = {c: [row[c]] for c in keep} | {f"{T}row": [row[f"{T}row"]], f"{T}k": [k], f"{T}chunk": [whole[at : at + step + overlap]]}
                    fields = [batch.schema.field(c) for c in (*keep, f"{T}row")] + [pa.field(f"{T}k", pa.int32()), pa.field(f"{T}chunk", pa.string())]
                    yield pa.RecordBatch.from_pydict(part, schema=pa.schema(fields))

    return run


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "token_ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns and ``out``, array<int>: the ids of each whole text.

    A null text counts as empty and has no ids. Rows are independent: repeated rows and
    null ids each give a row; other columns are not read. Texts of up to one chunk are
    encoded where they are; longer ones are spread over the cluster by chunk.
    """
    spark = small_batches(df).sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))  # the vocabulary: a fixed size
    column = F.coalesce(F.col(text).cast("string"), F.lit("")).alias(f"{T}text")
    rows = df.select(*keep, column)
    kept = list(keep)
    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField(out, S.ArrayType(S.IntegerType()))])
    worker: dict[str, Encoder] = {}

    def encoder() -> Encoder:
        if "it" not in worker:
            worker["it"] = Encoder(*shared.value)
        return worker["it"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in row_slices(batches, f"{T}text"):
            yield _with_ids(batch, kept, out, lambda ids, t: own.encode(own.pattern.findall(t), ids), batch.column(f"{T}text").to_pylist())

    limit = chunk + overlap
    short = rows.filter(F.length(f"{T}text") <= limit).mapInArrow(whole, schema)
    long = rows.filter(F.length(f"{T}text") > limit)
    keyed = S.StructType([rows.schema[c] for c in keep] + [S.StructField(f"{T}row", S.LongType()), S.StructField(f"{T}k", S.IntegerType()), S.StructField(f"{T}chunk", S.StringType())])
    parts = materialize(long.withColumn(f"{T}row", F.monotonically_increasing_id()).mapInArrow(_chunks(kept, f"{T}text", chunk, overlap), keyed), "bpe-chunks")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        for batch in row_slices(batches, f"{T}chunk"):
            # whether more text follows does not matter: a last chunk gets no margin in stitch()
            got = [[m.start() for m in own.pattern.finditer(t)] for t in batch.column(f"{T}chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], names=[*batch.schema.names, f"{T}starts"])

    spread = parts.repartition(F.col(f"{T}row"), F.col(f"{T}k"))
    found = spread.mapInArrow(pretokenise, S.StructType([*keyed, S.StructField(f"{T}starts", S.ArrayType(S.IntegerType()))]))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        """Blocks of one text that begin and end at boundaries of the whole text."""
        group = group.sort_values(f"{T}k")
        chunks = group[f"{T}chunk"].tolist()
        body = "".join(c[:chunk] for c in chunks[:-1]) + chunks[-1]
        ends = [min(len(body), k * chunk + chunk + overlap) for k in range(len(chunks))]
        sure = [e if e >= len(body) else e - MARGIN for e in ends]
        starts = [[int(x) + k * chunk for x in s if int(x) + k * chunk <= sure[k]] for k, s in enumerate(group[f"{T}starts"])]
        bounds = stitch(encoder(), body, starts, chunk, overlap)
        made = []
        for k in range(len(chunks)):
            i, j = bisect_left(bounds, k * chunk), bisect_left(bounds, (k + 1) * chunk)
            if k + 1 == len(chunks):
                j = len(bounds)
            if i < j:
                a, b = bounds[i], bounds[j] if j < len(bounds) else len(body)
                made.append((k, body[a:b], [x - a for x in bounds[i:j]]))
        got = pd.DataFrame(made, columns=[f"{T}k", f"{T}chunk", f"{T}starts"])
        for c in (*kept, f"{T}row"):
            got[c] = [group[c].iloc[0]] * len(got)
        return got[[*kept, f"{T}row", f"{T}k", f"{T}chunk", f"{T}starts"]]

    blocks = found.groupBy(f"{T}row").applyInPandas(join, found.schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()

        def put(ids: array, row: tuple[str, list[int]]) -> None:
            t, at = row
            own.encode([t[a:b] for a, b in zip(at, [*at[1:], len(t)], strict=True)], ids)

        for batch in row_slices(batches, f"{T}chunk"):
            both = list(zip(batch.column(f"{T}chunk").to_pylist(), batch.column(f"{T}starts").to_pylist(), strict=True))
            yield _with_ids(batch, [*kept, f"{T}row", f"{T}k"], out, put, both)

    encoded = blocks.repartition(F.col(f"{T}row"), F.col(f"{T}k")).mapInArrow(pieces, S.StructType([*keyed.fields[:-1], schema[out]]))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(f"{T}k", out))), lambda x: x[out]))
    # the kept columns are equal in all blocks of a row
    one = [F.first(c).alias(c) for c in keep]
    return short.unionByName(encoded.groupBy(f"{T}row").agg(*one, ordered.alias(out)).select(*keep, out))


def _with_ids(batch: pa.RecordBatch, keep: list[str], out: str, put, items: list) -> pa.RecordBatch:
    ids, ends = array("i"), [0]
    for item in items:
        put(ids, item)
        ends.append(len(ids))
    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], names=[*keep, out])


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded", packed: str | None = None) -> DataFrame:
    """``keep`` columns and ``out``, binary: the tokens' bytes one after the other.

    ``packed`` names a further column for the ids as little-endian unsigned 32-bit
    integers. Null or empty ids give empty bytes; an unknown id is an error.
    """
    shared = small_batches(df).sparkSession.sparkContext.broadcast(ranks)
    rows = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(f"{T}ids"))
    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField(c, S.BinaryType()) for c in (out, packed) if c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in shared.value.items()}
        for batch in batches:
            column = batch.column(f"{T}ids")
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            rows = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            made = [pa.array([b"".join(map(tokens.__getitem__, x.tolist())) for x in rows], pa.binary())]
            if packed:
                made.append(pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *(c for c in (out, packed) if c)])

    return rows.mapInArrow(run, schema)
