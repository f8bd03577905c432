"""Helpers shared by the text operators: scratch tables, row keys, batch walking."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column, so that extra columns of the input never clash.
T = "__llm_"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset in local mode (tests) a temporary folder is set, and removed at
    exit. On a cluster a machine's own folder would not do, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="labarr-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of rows that go to a Python worker at once, unless the session says otherwise. The
#: buffers of such a batch, which double as they fill, stay well below the 4 MiB that the
#: JVM's allocator keeps and hands out again; larger ones are taken from the system each
#: time, and what these leave in fragments counts against an executor's memory.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes and not only in rows:
    ten thousand long texts at once would not fit a worker. A session's own setting stays."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read and never a recomputation,
    and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/labarr-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


#: Paths of the tables that this process has written and not deleted.
_WRITTEN: list[str] = []


def drop_tables(spark: SparkSession, tables: Iterable[DataFrame] | None = None) -> int:
    """Delete the given scratch tables, or all that this process has written, and say how
    many. To be called when no DataFrame that was made from them is needed any more."""
    paths = list(_WRITTEN) if tables is None else [t.table_path for t in tables]
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(conf).delete(path, True)
        _WRITTEN.remove(name)
    return n


def ascii_lower(text: Column) -> Column:
    """Lower-case for matching ASCII words, in the JVM.

    ``lower`` folds all of Unicode; the only other code point that it turns into a
    single ASCII letter is U+212A, which is moved aside first. Words holding other
    non-ASCII letters may differ from A-Z folding, but never equal an ASCII word.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in column)]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def chosen(total: int, most: int, *key: str) -> Column:
    """True for about ``most`` of ``total`` rows, by the hash of ``key``: the same ones
    however the rows are spread."""
    share = 1 << 30 if total <= most else (most << 30) // total
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < share


def sampled(df: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """About ``most`` of ``total`` rows, those ``chosen``. Rows must differ in ``key``, so
    that no more than about ``most`` can be gathered."""
    return df.filter(chosen(total, most, *key))


def sampled_whole(df: DataFrame, most: int, room: int, size: str, *key: str) -> DataFrame:
    """Up to ``most`` rows (which differ in ``key``) whose ``size`` sums up to ``room`` at
    most: about twice as many as wanted are dealt into small groups by hash, and groups are
    taken in order, all of a group or, where that would not fit any more, nothing of it."""
    rows = sampled(df, df.count(), 2 * most, *key)
    group = F.pmod(F.xxhash64(F.lit("group"), *key), F.lit(_GROUPS))
    taken, n, held = [], 0, 0
    for g in sorted(rows.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()):
        if n + g["n"] <= most and held + g["size"] <= room:
            taken, n, held = [*taken, g["g"]], n + g["n"], held + g["size"]
    return rows.filter(group.isin(taken))


#: Groups that ``sampled_whole`` deals rows into.
_GROUPS = 1 << 10


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)``, with ``x`` computed once however often the body uses it, also within
    lambdas."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def running(a: Column, step: Callable[[Column, Column], Column], width: int = 256, levels: int = 2) -> Column:
    """Running results of ``step`` over an array of longs, itself included: of sums with
    ``lambda s, x: s + x``, of maxima with ``F.greatest``.

    An array grows by copying, so only pieces of ``width`` values are folded, then their
    last values: 200,000 values cost about 130 copies each and not 100,000.
    """
    last = lambda c: F.get(c, F.size(c) - 1)
    add = lambda s, x: F.coalesce(step(s, x), x)

    def fold(c: Column) -> Column:
        return F.aggregate(c, F.expr("cast(array() as array<bigint>)"), lambda out, x: F.concat(out, F.array(add(last(out), x))))

    def over(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(width)).cast("int")), lambda k: fold(F.slice(v, k * width + 1, width)))
        return let(pieces, lambda p: let(running(F.transform(p, last), step, width, levels - 1), lambda base: F.flatten(F.transform(p, lambda c, k: F.transform(c, lambda x: add(F.get(base, k - 1), x))))))

    return fold(a) if levels == 1 else let(a, over)


#: Characters of the pieces in which long texts are cut, so that a place is found in one step.
PIECE = 1024


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, for ``between``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text cut into ``pieces``, a bound variable."""
    first, some = F.call_function("div", start, F.lit(PIECE)), F.greatest(end - start, F.lit(0))
    own = F.slice(cut, (first + 1).cast("int"), (F.call_function("div", end + (PIECE - 1), F.lit(PIECE)) - first).cast("int"))

    def part(p: Column, k: Column) -> Column:
        at = (first + k) * PIECE
        low = F.greatest(start - at, F.lit(0))
        return F.substring(p, (low + 1).cast("int"), F.least(end - at - low, F.lit(PIECE)).cast("int"))

    return F.when(some > 0, F.array_join(F.transform(own, part), "")).otherwise("")
