"""SimHash near-duplicates of documents, made complete for similar shingle sets.

Two texts link if the Jaccard similarity of their sets of five-word shingles is at least
4/5. Multi-index hashing of the sets' SimHash fingerprints gives first candidates, which
complete sets verify. But most such pairs differ in more bits than any table can look up,
so the candidates that are still missing come from an exact rule: similar sets share a
shingle among the first fifth of either, in any order that is the same for all sets.
Sketches of a bit or two a shingle reject nearly all candidates that are not similar, and
never one that is; complete sets verify the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import T, drop_tables, materialize, row_slices, sampled, small_batches
from .components import components
from .simhash import links as near_links

#: Words of a shingle.
WIDTH = 5
#: The share of all sets (one in so many, and so many at least) from which frequent shingles
#: are learned, and how many of these are remembered. They only order the shingles, so that
#: prefixes hold rare ones; any order is exact. A share and not a number, so that what stays
#: unknown is as rare in a large table as in a small one.
SHARE, SAMPLE, FREQUENT = 4, 1024, 1 << 19
#: Neighbours of a set, and central sets that it meets, that are verified before all others
#: are looked for.
FIRST = 4
#: Bits of a fingerprint up to which sets are first candidates.
NEAR = 3
#: Rows of numbers that are broadcast, so that texts need not be moved to meet them.
MOST = 1 << 20
#: Names of sets a task remembers.
_SEEN = 1 << 16


def shingles(text: bytes, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words are one shingle, as are none."""
    words = text.lower().split()  # on bytes both know ASCII only
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64).view(np.int64)
    begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], seed) for a, b in zip(begins, begins[width:], strict=False)), np.uint64, n)
    return np.unique(hashes.view(np.int64))


def prefix(own: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles of which every similar set has one, rarest first. ``known`` are
    frequent shingles in order, ``ranks`` how frequent."""
    n = len(own) - (4 * len(own) + 4) // 5 + 1
    if not len(known):
        return own[:n]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    rank = np.where(known[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))[:n]]


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the hashes that fall on each of 2^k >= len(own) bits (64 at least), as
    words. A hash that only one of two sets holds changes one bit, so two sketches differ
    in no more bits than the sets have different shingles."""
    n = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount(own & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 14):
        part = own[a : a + (1 << 14)]
        ones += np.unpackbits(part.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(">i8")[0])


def _map(rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``schema`` from each (row, text as bytes) of ``rows``; ``make`` gives the
    columns of one text."""
    rows = small_batches(rows).select(f"{T}row", F.encode(F.coalesce(F.col(f"{T}text").cast("string"), F.lit("")), "UTF-8").alias(f"{T}text"))
    fields = S.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: set = set()
        parts: list[tuple] = []
        for batch in row_slices(batches, f"{T}text"):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = make(row, text, state)
                if got is not None:
                    parts.append(got)
                if len(parts) >= 128:
                    yield flush(parts)
            if parts:
                yield flush(parts)

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*parts, strict=True)]
        parts.clear()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}  # of sets and sketches
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, fields, strict=True)], names=fields.names)

    return rows.mapInArrow(run, fields)


def _id(own: np.ndarray) -> int:
    """What names a set: equal sets, and as for shingles none but equal ones, share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 43)).view(np.int64))


def _print(row, text, state):
    own = shingles(text)
    return [row["r"]], [row["k"]], [_id(own)], [fingerprint(own)], [len(own)], [sketch(own)]


def _frequent(rows: DataFrame, points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets of a sample hold, in order, and in how many."""
    total = points.count()
    some = materialize(sampled(points.select(F.col("first.r").alias(f"{T}row"), "id"), total, max(SAMPLE, total // SHARE), "id").select(f"{T}row"), "similar-sample")
    each = _map(rows.join(_few(some), f"{T}row", "left_semi"), lambda row, text, state: (shingles(text),), "shingle bigint")
    found = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    known, n = found.column("shingle").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(known)
    drop_tables(rows.sparkSession, [some])
    return known[order], n[order].astype(np.int32)


def _near(a: str, b: str) -> Column:
    """Whether sets can be similar whose first common shingle has these places: their
    sizes, and what is left behind these places, allow it."""
    least, most = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    left = F.least(F.col(f"{a}size") - F.col(f"{a}pos"), F.col(f"{b}size") - F.col(f"{b}pos"))
    return (5 * least >= 4 * most) & (9 * left >= 4 * (F.col(f"{a}size") + F.col(f"{b}size")))


def _shared(rows: DataFrame, points: DataFrame) -> DataFrame:
    """shingle, id, size, pos of what stands in the prefixes of several distinct sets, the
    same (_id, _size, _pos) of the next smaller set there, and in how many sets it stands."""
    order = rows.sparkSession.sparkContext.broadcast(_frequent(rows, points))

    def make(row, text, seen):
        own = shingles(text)
        known = _id(own)
        if known in seen:  # copies are reduced where they are read
            return None
        if len(seen) >= _SEEN:
            seen.clear()
        seen.add(known)
        first = prefix(own, *order.value)
        return first, np.full(len(first), known), np.full(len(first), len(own), np.int32), np.arange(len(first), dtype=np.int32)

    each = _map(rows, make, "shingle bigint, id bigint, size int, pos int")
    # one shuffle serves the distinct rows and the windows
    dealt = each.repartition("shingle").dropDuplicates(["shingle", "id"])
    by = Window.partitionBy("shingle").orderBy("size", "id")
    beside = dealt.select("*", *(F.lag(c).over(by).alias(f"_{c}") for c in ("id", "size", "pos")), F.lead("id").over(by).alias("after"), F.count("*").over(Window.partitionBy("shingle")).alias("n"))
    return materialize(beside.filter(F.coalesce("_id", "after").isNotNull()).drop("after"), "similar-shared")


def _scores(shared: DataFrame) -> DataFrame:
    """id and how much its prefix is shared: the mean number of sets of a shingle."""
    return shared.groupBy("id", "size").agg((F.sum("n") / (F.floor(F.col("size") / 5) + 1)).alias("score")).select("id", "score")


def _central(shared: DataFrame, scores: DataFrame) -> DataFrame:
    """id, size, pos of each row of ``shared``, and the same (_id, _size, _pos) of the set
    there whose prefix is shared most: what a group of near copies has in common is whole in
    its centre, so that copies which are not similar to each other are similar to it."""
    place = ("id", "size", "pos")
    scored = shared.join(_few(scores), "id")
    most = scored.groupBy("shingle").agg(F.max(F.struct("score", *place)).alias("most")).select("shingle", *(F.col(f"most.{c}").alias(f"_{c}") for c in place))
    return shared.select("shingle", *place).join(most, "shingle").filter("id != _id").drop("shingle")


def _few(df: DataFrame) -> DataFrame:
    """``df``, a written table of few bytes a row, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST else df


def _folded(words: Column, n: Column) -> Column:
    """A sketch folded to ``n`` words, which is one of as many bits."""
    parts = F.call_function("div", F.size(words), n).cast("int")
    return F.when(parts <= 1, words).otherwise(F.transform(F.slice(words, 1, n), lambda w, i: F.aggregate(F.sequence(F.lit(1), parts - 1), w, lambda x, k: x.bitwiseXOR(F.get(words, i + k * n)))))


def _likely(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow similar sets. Sets are
    similar if no more than a ninth of their sizes' sum is different."""
    of = points.select("id", "size", "sketch")
    both = pairs.join(of.toDF("a", "m", "x"), "a").join(of.toDF("b", "n", "y"), "b")
    both = both.filter(5 * F.least("m", "n") >= 4 * F.greatest("m", "n"))
    words = F.least(F.size("x"), F.size("y"))
    apart = F.aggregate(F.zip_with(_folded(F.col("x"), words), _folded(F.col("y"), words), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return both.filter(9 * apart <= F.col("m") + F.col("n")).select("a", "b")


def _verified(rows: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose complete sets are similar."""
    pairs = materialize(_likely(pairs, points), "similar-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    few = materialize(points.join(ids, "id").select(F.col("first.r").alias(f"{T}row")), "similar-ids")

    def make(row, text, state):
        own = shingles(text)
        return [_id(own)], [own]

    sets = materialize(_map(rows.join(_few(few), f"{T}row", "left_semi"), make, "id bigint, own array<bigint>"), "similar-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    alike = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    found = materialize(both.filter(alike).select("a", "b"), "similar-links")
    drop_tables(rows.sparkSession, (pairs, few, sets))
    return found


def links(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Edges (a, b) that connect whatever sets of similarity 4/5 or more connect.

    Candidates of near fingerprints, a few neighbours of each set and a few central sets
    that it meets are verified first.
    Pairs that these links connect need no more comparison, so a large group of similar
    texts never costs all its pairs; all others that share a shingle of their prefixes are
    compared.
    """
    shared = _shared(rows, points)
    # sets of one fingerprint are a chain; of different ones the smallest stand for them
    same = Window.partitionBy("print").orderBy("id")
    chain = points.select("id", F.lag("id").over(same).alias("b")).filter("b is not null").select(F.col("id").alias("a"), "b")
    least = points.groupBy("print").agg(F.min("id").alias("id"))
    near = near_links(least.select("id", F.col("print").alias("fp"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    scores = materialize(_scores(shared), "similar-scores")
    beside, central = shared.select("id", "size", "pos", "_id", "_size", "_pos"), _central(shared, scores)
    often = beside.withColumn("kind", F.lit(0)).unionByName(central.withColumn("kind", F.lit(1))).filter(_near("", "_")).groupBy("kind", "id", "_id").agg(F.count("*").alias("n"))
    best = often.withColumn("k", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("n"), "_id"))).filter(F.col("k") <= FIRST)
    best = best.select(F.greatest("id", "_id").alias("a"), F.least("id", "_id").alias("b"))
    first = _verified(rows, points, best.unionByName(near).unionByName(chain).distinct())
    found = components(first)
    roots = materialize(found.select(F.col("node").alias("id"), "root"), "similar-roots")
    named = shared.select("shingle", "id", "size", "pos").join(_few(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    every = Window.partitionBy("shingle")
    mixed = materialize(named.withColumn("lo", F.min("root").over(every)).withColumn("hi", F.max("root").over(every)).filter("lo != hi").drop("lo", "hi"), "similar-mixed")
    other = mixed.select("shingle", *(F.col(c).alias(f"_{c}") for c in ("id", "size", "pos", "root")))
    rest = mixed.join(other, "shingle").filter((F.col("id") > F.col("_id")) & (F.col("root") != F.col("_root"))).filter(_near("", "_"))
    more = _verified(rows, points, rest.select(F.col("id").alias("a"), F.col("_id").alias("b")).distinct())
    drop_tables(rows.sparkSession, (shared, scores, roots, mixed))
    return first.unionByName(more)


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group that links connect, its smallest key (null keys last), with
    the columns of ``df``.

    Null, empty and blank texts are alike; texts of fewer than five words are alike if
    equal up to case and blanks. Up to MOST rows texts are not moved but read anew, beyond
    that they are shuffled to what decides about them. An empty table gives no rows.
    """
    rows = materialize(df.withColumn(f"{T}row", F.monotonically_increasing_id()), "similar-rows")  # fixes the numbers
    told = rows.select(f"{T}row", F.col(text).alias(f"{T}text"))
    prints = _map(rows.select(F.struct(F.col(f"{T}row").alias("r"), F.col(key).cast("long").alias("k")).alias(f"{T}row"), F.col(text).alias(f"{T}text")), _print, "r bigint, k bigint, id bigint, print bigint, size int, sketch array<bigint>")
    first = F.min(F.struct(F.col("k").isNull().alias("n"), F.col("k").alias("k"), F.col("r").alias("r"))).alias("first")
    # what else belongs to an id is equal in all its rows
    points = materialize(prints.groupBy("id").agg(first, *(F.min(c).alias(c) for c in ("print", "size", "sketch"))), "similar-points")
    found = components(links(told, points)).select(F.col("node").alias("id"), "root")
    of = points.join(found, "id", "left").select("first", F.coalesce("root", "id").alias("root"))
    kept = materialize(of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.r").alias(f"{T}row")), "similar-kept")
    return rows.join(_few(kept), f"{T}row", "left_semi").select(*df.columns)
