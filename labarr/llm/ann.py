"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is filed in one leaf of each tree. A
query walks all trees through one shared priority queue, nearest side of every split
first, until the leaves it took hold a given share of all vectors. Queries and vectors
then meet leaf by leaf, in blocks, and candidates are ranked by exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sampled, small_batches

#: Rows the trees are fitted on, about; rows of that sample in a leaf, at least; depth.
SAMPLE, LEAF, DEPTH = 1 << 14, 8, 7
#: Vectors that a query looks at, at least, counted with repetition over trees.
LEAST = 1 << 11
#: Vectors and queries of one leaf that meet in one step, at most.
ROWS, QUERIES = 1 << 14, 1 << 11


class Forest:
    """Balanced trees; node i has children 2i + 1 and 2i + 2, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf)))))
        self.inner = (1 << self.depth) - 1
        self.trees = [self._fit(sample, rng) for _ in range(trees)]

    def _fit(self, sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        normals = rng.standard_normal((self.inner, sample.shape[1] if sample.ndim > 1 else 0))
        cuts, node = np.zeros(self.inner), np.zeros(len(sample), int)
        for i in range(self.inner):
            rows = np.flatnonzero(node == i)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if (a != b).any():
                    normals[i] = a - b
            normals[i] /= np.linalg.norm(normals[i]) or 1.0
            side = sample[rows] @ normals[i]
            cuts[i] = np.median(side) if len(rows) else 0.0
            node[rows] = 2 * i + 1 + (side > cuts[i])
        return normals, cuts

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, (normals, cuts) in enumerate(self.trees):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[:, t] = node - self.inner
        return out

    def probe(self, q: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until they hold ``enough`` rows."""
        margins = [normals @ q - cuts for normals, cuts in self.trees]
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        out, held = [], 0
        while queue and held < enough:
            far, t, i = heapq.heappop(queue)
            while i < self.inner:
                m = margins[t][i]
                heapq.heappush(queue, (max(far, abs(m)), t, 2 * i + 1 + (m <= 0)))
                i = 2 * i + 1 + int(m > 0)
            if sizes[t, i - self.inner]:
                out.append((t, i - self.inner))
                held += sizes[t, i - self.inner]
        return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vec of usable rows, one for each key; floats stay floats, all else is double."""
    kind = df.schema[vector].dataType.simpleString()
    v = F.col(vector).cast(kind if kind == "array<float>" else "array<double>")
    usable = F.col(key).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = df.filter(usable).select(F.col(key).cast("long").alias("key"), F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("vec"))
    return rows.groupBy("key").agg(F.min("vec").alias("vec"))


def search(df: DataFrame, modulus: int | None = None, key: str = "vec_id", vector: str = "embedding", k: int = 10, trees: int = 16, share: float = 0.75, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is
    divisible by ``modulus`` (None: each row), by Euclidean distance in double precision.

    ``share`` is how much of all vectors a query looks at, counted with repetition over
    trees; a structureless set needs a large one for high recall. Ties go to the smaller
    id. Rows with a null id, and vectors null, zero, or with null or non-finite
    components, take no part, nor do vectors of a length other than the commonest (ties:
    the shortest). Of rows that repeat an id the smallest vector counts. Equal vectors
    are searched once and filed once, with their k + 1 smallest ids: more can not be in
    any answer. Other columns are not read; an empty table gives no rows.
    """
    spark = small_batches(df).sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialize(_vectors(df, key, vector), "ann-rows")
    kind = rows.schema["vec"].dataType.simpleString()
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vec") == sizes["d"])

    # distinct vectors with their smallest ids; the rank filter is applied before the shuffle too
    first = Window.partitionBy("vec").orderBy("key")
    kept = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    points = materialize(kept.groupBy("vec").agg(F.array_sort(F.collect_list("key")).alias("ids")), "ann-points")
    asked = rows if modulus is None else rows.filter(F.col("key") % modulus == 0)
    group = asked.groupBy("vec").agg(F.min("key").alias("q"))
    names = asked.join(group, "vec").select(F.col("key").alias("query_id"), "q")

    sample = sampled(points, points.count(), SAMPLE, "ids").toPandas()
    sample = sample.iloc[np.argsort([x[0] for x in sample["ids"]], kind="stable")]
    forest = Forest(_stack(sample["vec"]), trees, seed=seed)
    shared = spark.sparkContext.broadcast(forest)  # trees x leaves, bounded by SAMPLE

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield frame.assign(leaves=list(shared.value.file(_stack(frame["vec"]))))

    filed = materialize(points.mapInPandas(file, f"vec {kind}, ids array<long>, leaves array<int>"), "ann-filed")
    spots = filed.select("vec", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    counts = np.zeros((trees, forest.inner + 1), np.int64)
    for r in spots.groupBy("tree", "leaf").count().collect():  # one row a leaf
        counts[r["tree"], r["leaf"]] = r["count"]
    enough = max(share * counts[0].sum(), LEAST)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for q, v in zip(frame["q"], frame["vec"], strict=True):
                found = shared.value.probe(np.asarray(v, np.float64), counts, enough)
                yield pd.DataFrame({"q": q, "vec": [v] * len(found), "tree": [t for t, _ in found], "leaf": [x for _, x in found]})

    probes = materialize(group.select("q", "vec").mapInPandas(probe, f"q long, vec {kind}, tree int, leaf int"), "ann-probes")
    load = {(r["tree"], r["leaf"]): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}

    # a leaf's vectors and its queries are cut into blocks; each block of one meets each of the other
    parts = [[t, x, int(-(-counts[t, x] // ROWS)), -(-n // QUERIES)] for (t, x), n in load.items()]
    blocks = F.broadcast(spark.createDataFrame(parts or [[-1, -1, 1, 1]], "tree int, leaf int, rparts int, qparts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spots.join(blocks, ["tree", "leaf"]).withColumn("rpart", F.pmod(F.xxhash64("ids"), F.col("rparts")).cast("int")).select("tree", "leaf", "rpart", every("qparts").alias("qpart"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("q"), "ids", "vec")
    right = probes.join(blocks, ["tree", "leaf"]).withColumn("qpart", F.pmod(F.xxhash64("q"), F.col("qparts")).cast("int")).select("tree", "leaf", every("rparts").alias("rpart"), "qpart", F.lit(1).alias("side"), "q", F.lit(None).cast("array<long>").alias("ids"), "vec")
    cell = ["tree", "leaf", "rpart", "qpart"]
    dealt = left.unionByName(right.select(left.columns)).repartition(*cell).sortWithinPartitions(*cell, "side")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}
        now, vecs, ids, held = None, np.zeros((0, 0)), [], []
        for frame in batches:
            for at, part in frame.groupby(cell, sort=False):
                if at != now:
                    now, held = at, []
                mine = part[part["side"] == 0]
                if len(mine):
                    held.append(mine[["vec", "ids"]])
                ask = part[part["side"] == 1]
                if not len(ask) or not held:
                    continue
                both = pd.concat(held)
                held = [both]
                vecs, ids = _stack(both["vec"]), both["ids"].tolist()
                _rank(best, ask["q"].tolist(), _stack(ask["vec"]), vecs, ids, k + 1)
            if len(best) > 1 << 17:
                yield _rows(best)
                best = {}
        yield _rows(best)

    found = dealt.mapInPandas(meet, "q long, score double, vec_id long")
    merged = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    answers = names.join(merged, "q").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("i", "x"))
    return answers.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _rows(best: dict[int, list[tuple[float, int]]]) -> pd.DataFrame:
    flat = [(q, s, i) for q, found in best.items() for s, i in found]
    return pd.DataFrame(flat, columns=["q", "score", "vec_id"]).astype({"q": "int64", "score": "float64", "vec_id": "int64"})


def _rank(best: dict, names: list[int], asked: np.ndarray, vecs: np.ndarray, ids: list, most: int) -> None:
    """Merge each query's ``most`` nearest of one block into ``best``.

    A matrix product preselects, with a margin far above its rounding error; what is left
    is measured as the root of the sum of squared differences.
    """
    norms = (vecs**2).sum(axis=1)
    for a in range(0, len(asked), 256):
        block = asked[a : a + 256]
        own = (block**2).sum(axis=1)[:, None]
        rough = own + norms[None] - 2 * (block @ vecs.T)
        slack = 1e-9 * (own[:, 0] + norms.max())
        n = min(most, len(vecs))
        limit = np.partition(rough, n - 1, axis=1)[:, n - 1] + slack
        for r, q in enumerate(names[a : a + 256]):
            near = np.flatnonzero(rough[r] <= limit[r])
            exact = np.sqrt(((vecs[near] - block[r]) ** 2).sum(axis=1))
            got = {(float(s), int(i)) for s, x in zip(exact, near, strict=True) for i in ids[x]}
            best[q] = sorted(got.union(best.get(q, ())))[:most]
