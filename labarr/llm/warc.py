"""WARC records and a Merkle fixity audit of their replicas.

Records are hashed; the digests of an archive's ordered offset ranges are hashed into the
leaves of a tree, and each level groups ``fanout`` neighbours of the one below. Two
replicas are compared at their roots, and only below nodes that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from .common import T, materialize, small_batches


def record(url: Column, record_id: Column, body: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The bytes of one uncompressed WARC/1.1 resource record; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    payload = F.encode(text(body), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), text(record_id), F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(text(url), r"[\r\n]", " "), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), payload, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def parse(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Records of whole WARC files: ``keep``, offset, length, headers, body.

    A header without a length, or a file that ends early, gives a record up to the end of
    the file; bytes that are not a record are skipped to the next one.
    """
    schema = S.StructType([df.schema[c] for c in keep] + [S.StructField("offset", S.LongType()), S.StructField("length", S.LongType()), S.StructField("headers", S.MapType(S.StringType(), S.StringType())), S.StructField("body", S.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got, data, at = [], bytes(row[content] or b""), 0
                while (at := data.find(b"WARC/", at)) >= 0:
                    end = data.find(b"\r\n\r\n", at)
                    end = len(data) if end < 0 else end
                    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
                    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    size = headers.get("Content-Length", "")
                    upto = min(len(data), end + 4 + int(size)) if size.isdigit() else len(data)
                    stop = upto + 4 if data[upto : upto + 4] == b"\r\n\r\n" else upto
                    got.append({c: row[c] for c in keep} | {"offset": at, "length": stop - at, "headers": list(headers.items()), "body": data[end + 4 : upto]})
                    at = max(stop, at + 1)
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=to_arrow_schema(schema))

    return small_batches(df).select(*keep, content).mapInArrow(run, schema)


def manifest(df: DataFrame, archive: str, offset: str, content: str) -> DataFrame:
    """archive, offset, length and digest of each record; null content has a null digest."""
    return df.select(F.col(archive).alias("archive"), F.col(offset).cast("long").alias("offset"), F.octet_length(content).cast("long").alias("length"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def _hashed(children: DataFrame, key: str) -> DataFrame:
    """Nodes one level up: a hash of the ordered (key, digest) of at most ``fanout`` keys.

    Several records at one offset are ordered by their digests. A node gathers what lies
    in its own range of offsets only, which the range's length bounds.
    """
    row = F.concat_ws(":", F.col(key).cast("string"), F.coalesce("digest", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("row"))))
    return children.groupBy("archive", F.col("parent").alias("node")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n"), 256).alias("digest"))


def tree(records: DataFrame, span: int, fanout: int, top: int) -> list[DataFrame]:
    """Levels of the tree: ranges of ``span`` bytes, then groups of ``fanout`` nodes."""
    spot = F.concat_ws("+", F.col("offset").cast("string"), F.col("length").cast("string"))
    leaves = records.select("archive", F.floor(F.col("offset") / span).alias("parent"), F.concat_ws("#", spot, "digest").alias("digest"), F.coalesce("offset", F.lit(-1)).alias("k"))
    levels = [materialize(_hashed(leaves, "k"), "merkle-0")]
    for height in range(1, top + 1):
        below = levels[-1].withColumn("parent", F.floor(F.col("node") / fanout))
        levels.append(materialize(_hashed(below, "node"), f"merkle-{height}"))
    return levels


def audit(left: DataFrame, right: DataFrame, span: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """Records in which two manifests (see ``manifest``) differ.

    Returns archive, offset, left_length, left_digest, right_length, right_digest and
    status: corrupt (one record a side, other bytes), missing (not at right), extra (not
    at left). Where several records share an offset they are matched by length and
    digest, repeats counted, and unmatched ones reported as missing or extra. Records of
    a null archive form an archive of their own; a null offset has its own leaf. Equal or
    empty manifests give no rows.
    """
    left, right = (m.select("archive", "offset", "length", "digest") for m in (left, right))
    far = left.unionByName(right).agg(F.max("offset")).first()[0] or 0
    top, nodes = 0, far // span
    while nodes:
        top, nodes = top + 1, nodes // fanout
    trees = [tree(m, span, fanout, top) for m in (left, right)]
    bad = None
    for height in range(top, -1, -1):
        a, b = (t[height].alias(side) for t, side in zip(trees, "ab", strict=True))
        if bad is not None:
            a, b = (_under(x, bad, fanout).alias(side) for x, side in ((a, "a"), (b, "b")))
        on = F.col("a.archive").eqNullSafe(F.col("b.archive")) & F.col("a.node").eqNullSafe(F.col("b.node"))
        differ = a.join(b, on, "full_outer").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        # a node that one side lacks is compared by the side that has it
        side = lambda c: F.when(F.col("a.digest").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        bad = materialize(differ.select(side("archive"), side("node")), f"merkle-bad-{height}")
    both = []
    for m, name in ((left, "left"), (right, "right")):
        own = m.withColumn("node", F.floor(F.col("offset") / span)).alias("m")
        own = own.join(bad.alias("bad"), F.col("m.archive").eqNullSafe(F.col("bad.archive")) & F.col("m.node").eqNullSafe(F.col("bad.node")), "left_semi")
        both.append(own.withColumn("side", F.lit(name)))
    rows = both[0].unionByName(both[1])
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    odd = rows.groupBy("archive", "offset", "length", "digest").agg((count("left") - count("right")).alias("more")).filter("more != 0")
    gone, new = odd.filter("more > 0"), odd.filter("more < 0")
    lone = odd.groupBy("archive", "offset").agg(F.sum(F.greatest("more", F.lit(0))).alias("l"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("r"), *(F.max(F.when(F.col("more") * s > 0, F.struct("length", "digest"))).alias(n) for s, n in ((1, "a"), (-1, "b"))))
    pairs = lone.filter("l = 1 and r = 1").select("archive", "offset", F.col("a.length").alias("left_length"), F.col("a.digest").alias("left_digest"), F.col("b.length").alias("right_length"), F.col("b.digest").alias("right_digest"), F.lit("corrupt").alias("status"))
    rest = lone.filter("not (l = 1 and r = 1)").select("archive", "offset").alias("o")
    none = [F.lit(None).cast("long"), F.lit(None).cast("string")]

    def alone(x: DataFrame, status: str) -> DataFrame:
        x = x.alias("x").join(rest, F.col("x.archive").eqNullSafe(F.col("o.archive")) & F.col("x.offset").eqNullSafe(F.col("o.offset")), "left_semi")
        x = x.select("archive", "offset", "length", "digest", F.explode(F.sequence(F.lit(1), F.abs("more").cast("int"))).alias(f"{T}i"))
        own, other = ["length", "digest"], none
        first, second = (own, other) if status == "missing" else (other, own)
        cols = [F.col(c) if isinstance(c, str) else c for c in (*first, *second)]
        return x.select("archive", "offset", *(c.alias(n) for c, n in zip(cols, ("left_length", "left_digest", "right_length", "right_digest"), strict=True)), F.lit(status).alias("status"))

    return pairs.unionByName(alone(gone, "missing")).unionByName(alone(new, "extra"))


def _under(nodes: DataFrame, bad: DataFrame, fanout: int) -> DataFrame:
    """Children of differing nodes only."""
    n, up = nodes.select("archive", "node", "digest").alias("n"), bad.alias("up")
    return n.join(up, F.col("n.archive").eqNullSafe(F.col("up.archive")) & F.floor(F.col("n.node") / fanout).eqNullSafe(F.col("up.node")), "left_semi")
