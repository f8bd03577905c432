"""Secret scans with DataFrame functions only.

Candidates are found in whole texts by pattern, with their places. Every candidate's
hash is counted over the corpus by distinct repositories and distinct owners: what many
owners or many repositories carry is a copied example, what few of both carry looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import T, between, let, materialize, pieces, running

#: Base kinds in their order, pattern, and the least length of the match or
#: (assign) of its second group. Runs that are too short are dropped after matching.
BASE = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
)
#: Formats of public token issuers, reported where their owners are few.
ISSUED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"AIza[A-Za-z0-9_-]{35}"),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,128}(?![A-Za-z0-9+/_-])"),
)
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,rank:int,hash:bigint>>"


def _found(text: Column, kinds: list[tuple[str, str, int]]) -> Column:
    """For each kind an array of its spans, leftmost and not overlapping: what lies between
    matches (split) and the matches themselves (extract) take turns, so running sums of
    their lengths are where matches end. What is too short is dropped after matching."""
    size = lambda x: F.length(x).cast("long")
    none = F.expr("cast(array() as array<string>)")
    given = []
    for rank, (kind, pattern, least) in enumerate(kinds):
        held = F.rlike(text, F.lit(pattern))
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else none
        cols = {"gaps": F.split(text, pattern, -1), "found": matches, "keys": keys}
        given.append(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(least).alias("least"), *(F.when(held, c).otherwise(none).alias(n) for n, c in cols.items())))

    def over(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda m, k: size(F.get(x["gaps"], k)) + size(m))

        def spans(ends: Column) -> Column:
            key = lambda m, k: F.when(x["kind"] == "assign", F.get(x["keys"], k)).otherwise(m)
            made = F.transform(x["found"], lambda m, k: F.struct((F.get(ends, k) - size(m)).alias("start"), F.get(ends, k).alias("end"), x["kind"].alias("kind"), x["rank"].alias("rank"), F.xxhash64(key(m, k)).alias("hash"), F.length(key(m, k)).alias("size")))
            return F.transform(F.filter(made, lambda s: s["size"] >= x["least"]), lambda s: s.dropFields("size"))

        return F.when(F.size(x["found"]) > 0, let(running(lengths, lambda s, n: s + n), spans)).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    return F.transform(F.array(*given), over)


def candidates(df: DataFrame, text: str, keep: tuple[str, ...], owner: str | None, repo: str | None) -> DataFrame:
    """Per row ``keep``, its key, owner, repository, base spans and issued candidates.

    Written out: the texts are scanned once and the small result is used three times.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = lambda c, n: (F.lit(None) if c is None else F.col(c)).cast("string").alias(n)
    rows = df.select(*keep, name(owner, f"{T}owner"), name(repo, f"{T}repo"), body.alias(f"{T}text"))
    kinds = [*BASE, *((kind, pattern, 0) for kind, pattern in ISSUED)]
    rows = rows.select(*keep, f"{T}owner", f"{T}repo", _found(F.col(f"{T}text"), kinds).alias(f"{T}kinds"))
    each = [F.get(f"{T}kinds", F.lit(k)).alias(f"{T}{kind}") for k, (kind, _, _) in enumerate(BASE)]
    rows = rows.select(*keep, f"{T}owner", f"{T}repo", *each, F.flatten(F.slice(f"{T}kinds", len(BASE) + 1, len(ISSUED))).alias(f"{T}more"))
    return materialize(rows.withColumn(f"{T}row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: over all documents, in how many distinct ones a candidate is.

    Distinct pairs are formed before counting, so a candidate that a third of all
    documents copy is reduced in the tasks that read it.
    """
    every = found.select(f"{T}owner", f"{T}repo", F.explode(F.concat(*(F.col(f"{T}{k}") for k in (*(b[0] for b in BASE), "more")))).alias("s")).select(F.col("s.hash").alias("hash"), f"{T}owner", f"{T}repo")
    count = lambda c, name: every.select("hash", c).distinct().groupBy("hash").agg(F.count(c).alias(name))
    return count(f"{T}owner", "owners").join(count(f"{T}repo", "repos"), "hash")


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _told(df: DataFrame, text: str, keep: tuple[str, ...], owner: str | None, repo: str | None, few: int, copies: int) -> DataFrame:
    """Rows of ``candidates`` with own (structs of the method's spans), live and example."""
    found = candidates(df, text, keep, owner, repo)
    every = F.concat(*(F.col(f"{T}{kind}") for kind, _, _ in BASE), F.col(f"{T}more"))
    held = found.filter(F.size(every) > 0).select(f"{T}row", F.explode(every).alias("s"))
    seen = held.withColumn("hash", F.col("s.hash")).join(ownership(found), "hash", "left")
    # few owners and few repositories: what is copied widely, also by one owner, is an example
    live = (F.col("owners") <= few) & (F.col("repos") <= copies)
    told = seen.groupBy(f"{T}row").agg(F.collect_list(F.when(live & (F.col("s.rank") >= len(BASE)), F.col("s"))).alias(f"{T}own"), F.count(F.when(live, 1)).alias(f"{T}live"), F.count(F.when(~live, 1)).alias(f"{T}example"))
    # rows without candidates need no join; their texts, if kept, are not moved
    none = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in (f"{T}own", f"{T}live", f"{T}example")]
    return found.filter(F.size(every) == 0).select("*", *none).unionByName(found.filter(F.size(every) > 0).join(told, f"{T}row", "left"))


def _all() -> Column:
    return F.concat(*(F.col(f"{T}{kind}") for kind, _, _ in BASE), F.coalesce(F.col(f"{T}own"), F.expr(f"cast(array() as {_SPAN})")))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), owner: str | None = "source", repo: str | None = "doc_id", few: int = 2, copies: int = 8) -> DataFrame:
    """Per row: ``keep``, counts and digest of base spans, ``spans`` with the method's own
    (base spans, and issued formats whose candidate is live), ``found`` (all of them as
    structs), n_live and n_example: how many of the row's candidates are in at most ``few``
    owners' and at most ``copies`` repositories, or in more.

    Null and empty texts have no spans; a null owner or repository is not counted as one
    (nobody is known to hold the candidate, so it counts as live). Repeated rows each
    give a row; further columns are not read; an empty table gives no rows.
    """
    rows = _told(df, text, keep, owner, repo, few, copies)
    base = [F.col(f"{T}{kind}") for kind, _, _ in BASE]
    return rows.select(
        *keep,
        *(F.size(c).cast("long").alias(f"n_{kind}") for c, (kind, _, _) in zip(base, BASE, strict=True)),
        F.sha2(_joined(F.concat(*base)), 256).alias("base_sha256"),
        _joined(_all()).alias("spans"),
        F.coalesce(f"{T}live", F.lit(0)).alias("n_live"),
        F.coalesce(f"{T}example", F.lit(0)).alias("n_example"),
        _all().alias("found"),
    )


def mask(df: DataFrame, text: str = "text", owner: str | None = "source", repo: str | None = "doc_id", few: int = 2, copies: int = 8, mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of ``df`` with every span of ``scan`` masked in the text."""
    rows = _told(df, text, tuple(df.columns), owner, repo, few, copies)
    return rows.withColumn(text, redact(F.col(text), _all(), mark)).select(*df.columns)


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every found span (overlapping ones together) replaced by ``mark``."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def over(spans: Column, upto: Column, cut: Column) -> Column:
        before = lambda k: F.coalesce(F.get(upto, k - 1), F.lit(0).cast("long"))
        # a span that begins inside of earlier ones has no mark of its own
        kept = F.transform(spans, lambda s, k: F.when(s["start"] >= before(k), F.concat(between(cut, before(k), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), between(cut, before(F.size(spans)), F.length(text).cast("long")))

    done = let(ordered, lambda spans: let(running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda upto: let(pieces(text), lambda cut: over(spans, upto, cut))))
    return F.when(F.size(found) > 0, done).otherwise(text)
