"""Chat formatting by perspective rotation.

For every participant of a dialogue the turns are rendered once with that speaker as the
assistant and everybody else as named users; the mask covers what the assistant says. Turns of
``CONTEXT`` roles are instructions: rendered as they are in every perspective, never a target.

``perspectives`` renders whole dialogues: each participant gets every segment of ``SEGMENT`` turns
in order, also those in which they are silent. The segments' texts put together are the full
rendering, ``start`` and the mask count from its beginning, and ``context`` repeats the instructions
that came before a segment.

Shapes at scale: no rendered row holds more than ``SEGMENT`` turns and the instructions before
them, which are put together once per segment, for all participants. Turns are numbered by ``ordered_scan``. While all
dialogues are small, one shuffle by dialogue serves every step; else offsets are summed over one row
without text per segment and participant and joined back, so that a dialogue with a third of all
turns is spread over tasks. Built-in columns only.

Defined cases: a null text is an empty turn; a null turn number comes last; turns of a null role are an
unnamed user's; rows that repeat in all columns count once; rows of no dialogue (null conv_id) are left
out; a dialogue without any participant gives no row. Texts are rendered as they are, also where they hold the
template's marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.operators.scan import Running, has_large_group, ordered_scan

CONTEXT = ("system",)
SEGMENT = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _named(role: Column) -> Column:
    return F.regexp_replace(role, r"[^A-Za-z0-9_-]", "_")


def _head(role: Column, context: Sequence[str], speaker: Column) -> Column:
    return F.concat(
        F.lit(OPEN),
        F.when(role == speaker, F.lit("assistant"))
        .when(role.isin(*context), _named(role))
        .when(role.isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), _named(role))),
        F.lit("\n"),
    )


def _view(seen: DataFrame, context: Sequence[str], *columns: str) -> DataFrame:
    """The turns of each row from its speaker's side; the mask counts from ``start``."""

    def head(turn: Column) -> Column:
        return _head(turn["role"], context, F.col("speaker"))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("target"),
        ),
    )
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    none = F.array().cast("array<struct<start:long,length:int>>")
    spans = F.aggregate(
        "pieces",
        F.struct(F.col("start").alias("at"), none.alias("mask")),
        lambda state, p: F.struct(
            (state["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + 1).alias("at"),
            F.when(
                p["target"],
                F.array_append(
                    state["mask"],
                    F.struct(
                        (state["at"] + F.char_length(p["head"])).alias("start"),
                        F.char_length(p["body"]).alias("length"),
                    ),
                ),
            )
            .otherwise(state["mask"])
            .alias("mask"),
        ),
    )["mask"]
    return seen.withColumn("pieces", pieces).select(
        "conv_id",
        "segment",
        "speaker",
        *columns,
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["target"])).cast("long").alias("n_targets"),
        rendered.alias("rendered"),
        spans.alias("mask"),
    )


def perspectives(turns: DataFrame, *, context: Sequence[str] = CONTEXT, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment (0, 1, ...), speaker, start, context, n_turns, n_targets, rendered, mask.

    Every participant of a dialogue gets all its segments. ``start`` is the place of ``rendered`` in
    the full rendering and ``context`` the instructions of earlier segments, not counted by any place;
    ``mask`` is an array of (start, length) in code points of the full rendering.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").isNull().alias("last"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    large = has_large_group(rows, ["conv_id"])
    # dealt by dialogue first, small ones need no other exchange of their texts
    rows = (rows if large else rows.repartition("conv_id")).distinct()
    placed = ordered_scan(
        rows, ["conv_id"], ["last", "turn", "role", "text"], {"place": Running("ordinal")}, large=large
    ).withColumn("segment", F.expr(f"place div {segment}"))
    said = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    parts = placed.groupBy("conv_id", "segment").agg(said.alias("turns"))

    instructs = F.col("role").isin(*context)
    people = rows.where(F.col("role").isNotNull() & ~instructs).select("conv_id", F.col("role").alias("speaker")).distinct()
    chars = F.aggregate(
        "turns",
        F.lit(0).cast("long"),
        lambda n, t: n + F.char_length(_head(t["role"], context, F.col("speaker"))) + F.char_length(t["text"]) + len(CLOSE) + 1,
    )
    views = parts.join(people, "conv_id").withColumn("chars", chars)
    before = {"start": Running("sum_before", "chars")}
    if large:
        # one row without text per segment and participant is put in order
        starts = ordered_scan(views.drop("turns"), ["conv_id", "speaker"], ["segment"], before, large=True)
        views = parts.join(starts, ["conv_id", "segment"])
    else:
        views = ordered_scan(views, ["conv_id", "speaker"], ["segment"], before, large=False)

    rule = F.concat(F.lit(OPEN), _named(F.col("role")), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))
    own = placed.where(instructs).groupBy("conv_id", "segment").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", rule.alias("text"))))["text"], "").alias("rules")
    )
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "segment").join(own, ["conv_id", "segment"], "left").select(
        "conv_id", "segment", F.array_join(F.collect_list("rules").over(earlier), "").alias("context")
    )
    return _view(views.join(carried, ["conv_id", "segment"]), context, "start", "context")
