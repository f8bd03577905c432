"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two halves. Two that differ in at most 3 bits differ in at most
one bit of some half, so the values of the Hamming ball of radius 1 around a half meet the
other fingerprint in that half's table; complete distances verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, materialize, row_slices, small_batches
from .components import components

#: Bits of a half, and the distance up to which fingerprints link.
HALF, DISTANCE = 32, 3
#: Distinct fingerprints of a bucket beyond which it is a table of its own.
BLOCK = 4096


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``width`` words, repeats included, as an unsigned integer.

    Fewer words than that are one shingle; no words give 0.
    """
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, seed)
    begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(begins, begins[width:], strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, n >> 14)):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fp", width: int = 3) -> DataFrame:
    """``keep`` and ``out``, the fingerprint as a signed 64-bit integer; null text: 0."""
    rows = small_batches(df).select(*keep, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias(f"{T}text"))
    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField(out, S.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, f"{T}text"):
            got = np.array([fingerprint(x, width) for x in batch.column(f"{T}text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got)], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def _cleared(key: Column, bits: int) -> Column:
    """``key`` with one of its set bits cleared, for each of them. Of two keys that differ
    in one bit one has it set: its holder alone looks the other up."""
    flips = F.array(*(F.lit(1 << b) for b in range(bits)))
    return F.transform(F.filter(flips, lambda m: key.bitwiseAND(m) != 0), lambda m: key.bitwiseXOR(m))


def _entries(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table rows and looked-up rows (half, key, id, fp) of distinct fingerprints."""
    low = F.expr(f"fp & {(1 << HALF) - 1}L")
    high = F.shiftrightunsigned("fp", HALF)
    halves = points.select("id", "fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("key")), F.struct(F.lit(1).alias("half"), high.alias("key")))).alias("h"))
    table = halves.select("h.half", "h.key", "id", "fp")
    return table, table.select("half", F.explode(_cleared(F.col("key"), HALF)).alias("key"), "id", "fp")


def _bucketed(table: DataFrame, ball: DataFrame, block: int) -> DataFrame:
    """half, key, sub, id, fp, home: rows that stand in a bucket (home) or look it up.

    Buckets of more than ``block`` rows are tables of their own, of the two quarters of
    the other half: members that differ in 3 bits at most, and what is looked up with 2
    left, differ in at most one bit of some quarter. So 48 bits name such a sub-bucket,
    and it can not hold more than 2^16 fingerprints.
    """
    own, other = table.withColumn("home", F.lit(True)), ball.withColumn("home", F.lit(False))
    rows = own.unionByName(other)
    crowded = materialize(table.groupBy("half", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("half", "key", F.lit(True).alias("crowded")), "simhash-crowded")
    if crowded.isEmpty():
        return rows.withColumn("sub", F.lit(0))
    quarter, rest = HALF // 2, F.when(F.col("half") == 0, F.shiftrightunsigned("fp", HALF)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)))
    spot = lambda q, value, home: F.struct((value + ((1 + q) << quarter)).cast("int").alias("sub"), home.alias("home"))
    spots = []
    for q in (0, 1):
        value = F.shiftright(rest, q * quarter).bitwiseAND(F.lit((1 << quarter) - 1))
        flips = F.array(*(F.lit(1 << b).cast("long") for b in range(quarter)))
        around = F.when(F.col("home"), _cleared(value, quarter)).otherwise(F.transform(flips, lambda m: value.bitwiseXOR(m)))
        spots += [F.array(spot(q, value, F.col("home"))), F.transform(around, lambda v: spot(q, v, F.lit(False)))]
    told = rows.join(crowded, ["half", "key"], "left")
    at = F.when(F.col("crowded"), F.concat(*spots)).otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.col("home").alias("home"))))
    return told.select("half", "key", "id", "fp", F.explode(at).alias("x")).select("half", "key", "id", "fp", "x.home", "x.sub")


class _Bucket:
    """The home rows of one bucket and a spanning forest of their links."""

    def __init__(self, key: np.ndarray):
        self.key, self.n, self.roots = key, 0, []
        self.ids, self.fps = np.zeros(16, np.int64), np.zeros(16, np.uint64)

    def meet(self, own: int, fp: np.uint64, home: bool) -> list[tuple[int, int]]:
        near = np.flatnonzero(np.bitwise_count(self.fps[: self.n] ^ fp) <= DISTANCE)
        made = _attach(self.roots, self.ids, near, own) if len(near) else []
        if home:
            if self.n == len(self.ids):
                self.ids, self.fps = np.resize(self.ids, 2 * self.n), np.resize(self.fps, 2 * self.n)
            self.ids[self.n], self.fps[self.n] = own, fp
            self.roots.append(_root(self.roots, int(near[0])) if len(near) else self.n)
            self.n += 1
        return made


def links(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints within DISTANCE connect.

    ``points`` has distinct ``fp`` and an ``id`` each. Within a bucket only the links of
    a spanning forest are returned, never all pairs of a group.
    """
    rows = _bucketed(*_entries(points), block).select("half", "key", "sub", "id", "fp", "home")
    # a bucket's home rows come first, then what is looked up in it
    dealt = rows.repartition("half", "key", "sub").sortWithinPartitions("half", "key", "sub", F.desc("home"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = None
        for frame in batches:
            if not len(frame):
                continue
            keys = frame[["half", "key", "sub"]].to_numpy()
            home, fp, own = frame["home"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["id"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            ends = np.append(cuts[1:], len(frame))
            # buckets that begin and end in this batch with one row, or with no home row, hold no pair
            busy = (ends - cuts > 1) & home[cuts]
            busy[[0, -1]] = True
            made: list[tuple[int, int]] = []
            for a, b in zip(cuts[busy], ends[busy], strict=True):
                if bucket is None or (keys[a] != bucket.key).any():
                    bucket = _Bucket(keys[a].copy())
                for i in range(a, b):
                    made += bucket.meet(int(own[i]), fp[i], bool(home[i]))
            if made:
                yield pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    return dealt.mapInPandas(run, "a long, b long")


def _root(roots: list[int], i: int) -> int:
    while roots[i] != i:
        roots[i] = roots[roots[i]]
        i = roots[i]
    return i


def _attach(roots: list[int], ids: np.ndarray, near, own: int) -> list[tuple[int, int]]:
    """Edges from ``own`` to one member of each tree among ``near``, which become one tree."""
    trees = {}
    for i in near:
        trees.setdefault(_root(roots, int(i)), int(i))
    if not trees:
        return []
    first, *others = sorted(trees)
    for t in others:
        roots[t] = first
    return [(own, int(ids[i])) for i in trees.values() if ids[i] != own]


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), width: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row: ``key``, ``keep``, fingerprint (16 hexadecimal digits) and component_id,
    the smallest key reachable over links of at most 3 differing bits.

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal
    fingerprints are one point, so groups of copies cost one row; rows that repeat a key
    are judged each by its own text. Rows with a null key take part (component_id is the
    smallest key that is not null, null if none). An empty table gives no rows.
    """
    prints = materialize(fingerprints(df, text, (key, *keep), f"{T}fp", width), "simhash-prints")
    points = materialize(prints.groupBy(f"{T}fp").agg(F.min(F.col(key).cast("long")).alias("least")), "simhash-points")
    of = points.join(_roots(points, block), f"{T}fp")
    least = of.groupBy(f"{T}root").agg(F.min("least").alias(f"{T}least"))
    named = of.join(least, f"{T}root").select(f"{T}fp", f"{T}least")
    # a fingerprint that a third of all rows share is on the left, which can be split
    rows = prints.join(named, f"{T}fp", "left")
    return rows.select(key, *keep, F.lower(F.lpad(F.hex(f"{T}fp"), 16, "0")).alias("fingerprint"), F.col(f"{T}least").alias("component_id"))


def _roots(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Fingerprint and root (one fingerprint of its component) of distinct fingerprints."""
    fp = F.col(f"{T}fp")
    found = components(links(points.select(fp.alias("id"), fp.alias("fp")), block)).select(F.col("node").alias(f"{T}fp"), F.col("root").alias(f"{T}root"))
    return points.select(fp).join(found, f"{T}fp", "left").select(f"{T}fp", F.coalesce(f"{T}root", f"{T}fp").alias(f"{T}root"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """One row of each component, its smallest key (null keys last), with the columns of
    ``df``. Texts are moved once, to meet the few bytes that decide about each row."""
    rows = df.withColumn(f"{T}row", F.monotonically_increasing_id())
    rows = materialize(rows, "dedup-rows")  # fixes the numbers
    told = rows.select(F.col(key).cast("long").alias(f"{T}key"), f"{T}row", F.col(text).alias(f"{T}text"))
    prints = fingerprints(told, f"{T}text", (f"{T}key", f"{T}row"), f"{T}fp", width)
    # of the rows that share the smallest key the first stays. Copies are reduced to one row
    # where they are read, so that nothing after this knows how large their group is
    first = F.min(F.struct(F.col(f"{T}key").isNull().alias("n"), F.col(f"{T}key").alias("k"), F.col(f"{T}row").alias("r"))).alias("first")
    points = materialize(prints.groupBy(f"{T}fp").agg(first), "simhash-points")
    kept = points.join(_roots(points), f"{T}fp").groupBy(f"{T}root").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.r").alias(f"{T}row")), f"{T}row", "left_semi").select(*df.columns)
