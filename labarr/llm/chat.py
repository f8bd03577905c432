"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, neighbours of one role merged,
and everything concatenated to one string under a template whose control strings can not
occur inside a text: each occurrence there is broken by a backslash, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import T, between, let, pieces, running

#: The template's own marks.
OPEN, BODY, NEXT, CLOSE = "<|open|>", "<|body|>", "<|next|>", "<|close|>"
#: Marks of other templates that texts must not smuggle in either.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = "|".join(f"\\Q{x}\\E" for x in (OPEN, BODY, NEXT, CLOSE, *FOREIGN))


def escape(text: Column) -> Column:
    """Double backslashes, then put one after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    # every control string starts with < or [; the match is looked at without being consumed
    return F.regexp_replace(doubled, f"(?=(?:{_CONTROL}))([<\\[])", "$1\\\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``: a backslash stands for whatever follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merge(turns: Column) -> Column:
    """Array of {role, texts} with neighbours of one role made one."""
    item = lambda t, i: F.get(t, i)

    def over(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (item(t, i)["role"] != item(t, i - 1)["role"]))

        def run(s: Column, upto: Column) -> Column:
            return F.struct(item(t, s)["role"].alias("role"), F.flatten(F.transform(F.slice(t, s + 1, upto - s), lambda x: x["texts"])).alias("texts"))

        return let(starts, lambda at: F.transform(at, lambda s, k: run(s, F.coalesce(F.get(at, k + 1), n))))

    return let(turns, over)


def runs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bucket: int = 64) -> DataFrame:
    """One row per conversation: ``runs``, its merged turns in order.

    Turns are first gathered by (conversation, block of ``bucket`` turns) and merged
    there, so a conversation that holds a third of all rows is spread over tasks and only
    its merged blocks meet. Rows are ordered by turn, then role, then text; a null turn
    comes first, null role and text count as empty, repeated rows all count.
    """
    r, x = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias(conv), F.floor(F.col(turn) / bucket).alias(f"{T}b"), F.struct(F.col(turn).alias("turn"), escape(r).alias("role"), escape(x).alias("text"), r.alias("raw_role"), x.alias("raw")).alias(f"{T}t"))
    fields = [F.col(f"{T}t.{c}") for c in ("turn", "raw_role", "raw", "role", "text")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    blocks = rows.groupBy(conv, f"{T}b").agg(_merge(ordered).alias(f"{T}runs"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(f"{T}b", f"{T}runs"))), lambda b: b[f"{T}runs"]))
    return blocks.groupBy(conv).agg(_merge(whole).alias("runs"))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` text and ``loss_spans``.

    ``loss_spans`` are [start, end) code points of ``formatted``, one for each text of a
    role in ``learn``. Empty tables give no rows; a null conversation id is a group of
    its own; see ``runs`` for order, nulls and repeated rows.
    """
    merged = runs(df, conv, turn, role, text)
    block = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(BODY), F.array_join(b["texts"], NEXT), F.lit(CLOSE))
    size = lambda x: F.length(x).cast("long")

    def places(b: Column) -> Column:
        """Of each text of a block what comes before it, its length, and what follows it."""
        head, last = size(b["role"]) + len(OPEN) + len(BODY), F.size(b["texts"]) - 1
        learned = F.coalesce(b["role"].isin(*learn), F.lit(False))
        return F.transform(b["texts"], lambda x, k: F.struct(F.when(k == 0, head).otherwise(len(NEXT)).alias("lead"), size(x).alias("n"), F.when(k == last, len(CLOSE)).otherwise(0).alias("tail"), learned.alias("learned")))

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["lead"] + x["n"] + x["tail"]), lambda s, x: s + x)
        every = F.zip_with(p, ends, lambda x, e: F.struct((e - x["tail"] - x["n"]).alias("start"), (e - x["tail"]).alias("end"), x["learned"].alias("learned")))
        return F.transform(F.filter(every, lambda x: x["learned"]), lambda x: x.dropFields("learned"))

    return merged.select(conv, F.array_join(F.transform("runs", block), "").alias("formatted"), let(F.flatten(F.transform("runs", places)), spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, f"\\Q{OPEN}\\E", -1), lambda x: x != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.replace(b, F.lit(CLOSE), F.lit("")), f"\\Q{BODY}\\E", -1)
        return F.transform(F.split(parts[1], f"\\Q{NEXT}\\E", -1), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return let(pieces(formatted), lambda cut: F.array_join(F.transform(spans, lambda s: unescape(between(cut, s["start"], s["end"]))), ""))
