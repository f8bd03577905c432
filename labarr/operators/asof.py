"""As-of joins: lookup of labels that are data, by the same rules as ``Index.find``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges the order is cut into where no column groups the rows.
BLOCKS = 256


def asof_join(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str] | None = None, method: str = "ffill", tolerance: float | None = None) -> DataFrame:
    """Each left row with ``values`` and ``<on>_right`` of the right row that its ``on``
    finds: the last one at or before (``ffill``), the first at or after (``bfill``) or the
    nearest (a tie goes to the earlier). Nulls where none is found or it is farther than
    ``tolerance``. Of right rows that share a place, the smallest values count; rows with
    a null ``on`` find nothing and are not found.

    Both sides meet in one sorted stream per group. Without groups the order is cut into
    ranges, and the last (first) right row of earlier (later) ranges is carried into each,
    so no single task sees all rows.
    """
    by = list(by or [])
    packed = F.struct(F.col(on).alias("at"), *(F.col(v).alias(v) for v in values))
    far = right.filter(F.col(on).isNotNull()).groupBy(*by, on).agg(F.min(packed).alias("__v"))
    near = left.filter(F.col(on).isNotNull())
    lost = left.filter(F.col(on).isNull())
    kind, time = far.schema["__v"].dataType, right.schema[on].dataType.simpleString().startswith(("timestamp", "date"))
    rows = near.select(*by, F.col(on).alias("__k"), F.lit(None).cast(kind).alias("__v"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__l"))
    cut = _cuts(far, on) if not by else []
    stream = rows.unionByName(far.select(*by, F.col(on).alias("__k"), "__v", F.lit(None).cast(rows.schema["__l"].dataType).alias("__l")))
    block = sum((F.when(F.col("__k") >= c, 1).otherwise(0) for c in cut), F.lit(0)) if cut else F.lit(0)
    stream = stream.withColumn("__b", block)
    group = [*by, "__b"]
    found = {}
    for way, wanted in (("ffill", method in ("ffill", "pad", "nearest")), ("bfill", method in ("bfill", "backfill", "nearest"))):
        if wanted:
            # at one place right rows come first, whichever way is looked
            order = [F.col("__k"), F.col("__l").isNotNull()] if way == "ffill" else [F.col("__k").desc(), F.col("__l").isNotNull()]
            seen = F.last("__v", ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            stream = stream.withColumn(f"__{way}", seen)
            found[way] = F.col(f"__{way}")
    if not found:
        raise ValueError(f"unknown method {method}")
    if cut:
        # one row per range: its last and first right rows, carried on
        ends = stream.filter("__v is not null").groupBy("__b").agg(F.max("__v").alias("hi"), F.min("__v").alias("lo"))
        ranges = left.sparkSession.range(len(cut) + 1).select(F.col("id").cast("int").alias("__b")).join(ends, "__b", "left")
        whole = Window.partitionBy(F.lit(0)).orderBy("__b")
        carried = ranges.select("__b", F.last("hi", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("__hi"), F.first("lo", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("__lo"))
        stream = stream.join(F.broadcast(carried), "__b", "left")
        found = {w: F.coalesce(c, F.col("__hi" if w == "ffill" else "__lo")) for w, c in found.items()}
    hit = _nearer(found["ffill"], found["bfill"], time) if len(found) == 2 else next(iter(found.values()))
    if tolerance is not None:
        hit = F.when(_distance(F.col("__k"), hit["at"], time) <= tolerance, hit)
    done = stream.filter("__l is not null").select(F.col("__l.*"), hit.alias("__hit"))
    done = done.unionByName(lost.withColumn("__hit", F.lit(None).cast(kind)))
    return done.select(*(F.col(f"`{c}`") for c in left.columns), F.col("__hit.at").alias(f"{on}_right"), *(F.col(f"__hit.`{v}`").alias(v) for v in values))


def _cuts(right: DataFrame, on: str) -> list:
    """Ends of about equally large ranges, at most BLOCKS - 1."""
    n = right.agg(F.count("*")).first()[0]
    parts = min(BLOCKS, n >> 14)
    if parts < 2:
        return []
    c = F.col(on)
    kind = right.schema[on].dataType.simpleString()
    time = kind.startswith(("timestamp", "date"))
    number = F.unix_micros(c.cast("timestamp")) if time else c.cast("double")
    found = right.select(F.percentile_approx(number, [k / parts for k in range(1, parts)], 1000)).first()[0]
    back = (lambda x: F.timestamp_micros(F.lit(int(x))).cast(kind)) if time else (lambda x: F.lit(x).cast(kind))
    return [back(x) for x in sorted(set(found))]


def _distance(a: Column, b: Column, time: bool) -> Column:
    """In the labels' units; of timestamps in milliseconds."""
    number = lambda c: F.unix_micros(c.cast("timestamp")) / 1000 if time else c.cast("double")
    return F.abs(number(a) - number(b))


def _nearer(before: Column, after: Column, time: bool) -> Column:
    gap = lambda x: _distance(F.col("__k"), x["at"], time)
    return F.when(before.isNull(), after).when(after.isNull(), before).when(gap(after) < gap(before), after).otherwise(before)
