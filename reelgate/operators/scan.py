"""Ordered scans, halos and folds that stay distributed when one key holds most rows.

A Spark window sorts each of its groups in one task. That is the best plan while every
group is small, so each operator here either knows a bound on its groups (a chunk of
``CHUNK_FRAMES`` frames) or counts them first. Where a group is too large, the rows are
cut into chunks: the window runs inside the chunks, one summary row per chunk is scanned
in order, and the summary of everything before a chunk is joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.session import pinned, spread

#: Rows of one group that a single window task may sort. Setting: reelgate.groupRows
GROUP_ROWS = 500_000
#: Frames of one series kept together (about 22 minutes at 50 frames a second).
#: Setting: reelgate.chunkFrames
CHUNK_FRAMES = 65_536


def group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("reelgate.groupRows", str(GROUP_ROWS)))


def chunk_frames(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("reelgate.chunkFrames", str(CHUNK_FRAMES)))


def has_large_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether any group exceeds the rows one task may hold (one map-combined count)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return not counts.where(F.col("__n") > group_rows(df)).isEmpty()


def by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into as many parts as their rows need, so that a task's share stays the
    same size as a table grows; what groups by these keys afterwards needs no further exchange."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // group_rows(df))), *keys)


@dataclass(frozen=True)
class Running:
    """One column computed over the rows before and including the current one.

    ``kind`` is ``ordinal`` (0, 1, ...), ``sum``, ``max``, ``last`` (last non-null),
    or one of ``sum_before``, ``max_before``, ``last_before``, ``lag``, which leave the
    current row out.
    """

    kind: str
    value: str | None = None


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    *,
    descending: bool = False,
    chunk: Column | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Add running columns per key. The order must be total within a key.

    ``chunk`` names the chunk of each row where the data knows one: it must rise with the
    order and hold a bounded number of rows. Without it the group sizes decide: small
    groups use one window, others are range-partitioned by (keys, order), pinned, and
    their partitions serve as chunks.
    """
    if chunk is not None:
        return _chunk_scan(df.withColumn("__chunk", chunk), keys, order, outputs, descending)
    if large is None:
        large = has_large_group(df, keys)
    if not large:
        window = Window.partitionBy(*keys).orderBy(*_sorted(order, descending))
        for name, running in outputs.items():
            df = df.withColumn(name, _local(running, window))
        return df
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    ranged = pinned(ranged.withColumn("__chunk", F.spark_partition_id().cast("long")))
    return _chunk_scan(ranged, keys, order, outputs, descending)


def _sorted(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _local(running: Running, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    kind, value = running.kind, running.value
    if kind == "ordinal":
        return (F.row_number().over(window) - 1).cast("long")
    if kind == "sum":
        return F.sum(value).over(upto)
    if kind == "sum_before":
        return F.coalesce(F.sum(value).over(before), F.lit(0))
    if kind == "max":
        return F.max(value).over(upto)
    if kind == "max_before":
        return F.max(value).over(before)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(before)
    if kind == "lag":
        return F.lag(value).over(window)
    raise ValueError(f"Unknown running column: {kind}")


def _chunk_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    descending: bool,
) -> DataFrame:
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*_sorted(order, descending))
    across = (
        Window.partitionBy(*keys)
        .orderBy(*_sorted(["__chunk"], descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    position = F.struct(*order)
    latest = F.min_by if descending else F.max_by
    summaries, carries = [], []
    rows = df
    if any(running.kind == "lag" for running in outputs.values()):
        rows = rows.withColumn("__first", F.row_number().over(inside) == 1)
    for name, running in outputs.items():
        kind, value = running.kind, running.value
        rows = rows.withColumn(name, _local(running, inside))
        tag, carry = f"__s_{name}", f"__c_{name}"
        if kind == "ordinal":
            summaries.append(F.count(F.lit(1)).alias(tag))
            carries.append(F.sum(tag).over(across).alias(carry))
        elif kind.startswith("sum"):
            summaries.append(F.sum(value).alias(tag))
            carries.append(F.sum(tag).over(across).alias(carry))
        elif kind.startswith("max"):
            summaries.append(F.max(value).alias(tag))
            carries.append(F.max(tag).over(across).alias(carry))
        elif kind.startswith("last"):
            # max_by and min_by skip rows whose order is null, hence the last non-null value
            seen = F.when(F.col(value).isNotNull(), position)
            summaries.append(latest(F.col(value), seen).alias(tag))
            carries.append(F.last(tag, ignorenulls=True).over(across).alias(carry))
        else:
            summaries.append(latest(F.struct(value), position).alias(tag))
            carries.append(F.last(tag).over(across).alias(carry))
    summary = df.groupBy(*keys, "__chunk").agg(*summaries)
    ahead = summary.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__chunk").alias("__kc"),
        *carries,
    )
    match = F.col("__chunk") == F.col("__kc")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(ahead, match, "left")
    for name, running in outputs.items():
        kind, carry = running.kind, F.col(f"__c_{name}")
        if kind == "ordinal" or kind == "sum_before":
            value = F.col(name) + F.coalesce(carry, F.lit(0))
        elif kind == "sum":
            value = F.when(
                F.col(name).isNull() & carry.isNull(), F.lit(None)
            ).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(carry, F.lit(0)))
        elif kind.startswith("max"):
            value = F.greatest(F.col(name), carry)
        elif kind.startswith("last"):
            value = F.coalesce(F.col(name), carry)
        else:
            value = F.when(F.col("__first"), carry.getField(running.value)).otherwise(F.col(name))
        joined = joined.withColumn(name, value)
    drop = ["__chunk", "__kc", "__first", *[f"__k{i}" for i in range(len(keys))]]
    return joined.drop(*drop, *[f"__c_{name}" for name in outputs])


def home_chunk(df: DataFrame, index: str = "frame_idx") -> Column:
    return F.expr(f"{index} div {chunk_frames(df)}")


def with_halo(df: DataFrame, before: int, after: int, index: str = "frame_idx") -> DataFrame:
    """Copy the rows near a chunk's edge into the chunks that need to look at them.

    Afterwards a window over (keys, ``__chunk``) sees ``before`` rows ahead of and ``after``
    rows behind each of its own rows; ``drop_halo`` keeps only the rows at home.
    """
    size = chunk_frames(df)
    first = F.greatest(F.expr(f"({index} - {after}) div {size}"), F.lit(0).cast("long"))
    last = F.expr(f"({index} + {before}) div {size}")
    return df.withColumn("__home", home_chunk(df, index)).withColumn(
        "__chunk", F.explode(F.sequence(first, last))
    )


def halo_window(keys: Sequence[str], index: str = "frame_idx"):
    return Window.partitionBy(*keys, "__chunk").orderBy(index)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk")


def map_sorted_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply a function to each group in order, many small groups per batch.

    Does what a grouped map does, without a Python call and an Arrow batch per group: the
    partitions are sorted by group, and groups are sliced out of the batches as they pass.
    A group must fit a task.
    """
    group = list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            codes = pdf.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
            done = [function(pdf.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if done:
                yield pd.concat(done, ignore_index=True)
            held = pdf.iloc[edges[-1] :]
        if held is not None:
            yield function(held)

    return spread(df, *group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


Fold = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str | None]]


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    fold: Fold,
    schema: str,
    *,
    one_chunk: bool | None = None,
) -> DataFrame:
    """Run a sequential ``fold(rows, state) -> (rows, state)`` over each key in order.

    Keys that fit one chunk take one pass. For longer ones every chunk is first folded
    from an empty state; the chunks then take the state their predecessor ended with, until
    no state changes. That is exact whatever the fold does, and ends after a pass or two
    when the fold forgets its past, as spaced peak picking does.

    ``one_chunk`` tells that no key reaches past its first chunk, where the caller knows it
    from cheaper rows than these.
    """
    rows = df.withColumn("__chunk", chunk)
    group = [*keys, "__chunk"]
    order = list(order)
    if one_chunk is None:
        one_chunk = rows.where(F.col("__chunk") > 0).isEmpty()
    if one_chunk:
        return map_sorted_groups(rows, group, order, lambda pdf: fold(pdf, None)[0], schema)

    key_schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in group)
    columns = [c.split()[0].strip("`") for c in schema.split(",")]

    def state_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in [*group, "state"]})
        given = right["state"].iloc[0] if len(right) else None
        _, state = fold(left.sort_values(order), given)
        out = left[group].head(1).copy()
        out["state"] = state
        return out

    def rows_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in columns})
        given = right["state"].iloc[0] if len(right) else None
        return fold(left.sort_values(order), given)[0]

    grouped = rows.groupBy(*group)
    across = Window.partitionBy(*keys).orderBy("__chunk")
    given = df.sparkSession.createDataFrame([], f"{key_schema}, state string")
    while True:
        ended = grouped.cogroup(given.groupBy(*group)).applyInPandas(
            state_of, f"{key_schema}, state string"
        )
        new = pinned(ended.select(*group, F.lag("state").over(across).alias("state")))
        changed = new.alias("n").join(given.alias("g"), group, "left").where(
            ~F.col("n.state").eqNullSafe(F.col("g.state"))
        )
        if changed.isEmpty():
            break
        given = new
    return grouped.cogroup(given.groupBy(*group)).applyInPandas(rows_of, schema)


def composed_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    summary: Callable[[pd.DataFrame], str],
    advance: Callable[[str, str | None], str],
    follow: Callable[[pd.DataFrame, str | None], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """A sequential walk whose steps compose, as a parallel scan: two passes for any length.

    ``summary(rows)`` says what a chunk does to any state it may be entered with, and
    ``advance(summary, state)`` applies that; the summaries of a key, one row per chunk, are followed
    in order, and ``follow(rows, state)`` gives the rows of each chunk from the state it is entered with.
    A state is text, None at the beginning of a key.
    """
    rows = df.withColumn("__chunk", chunk)
    group = [*keys, "__chunk"]
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in group)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[group].head(1).assign(summary=summary(pdf))

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        states, state = [], None
        for text in pdf["summary"]:
            states.append(state)
            state = advance(text, state)
        return pdf[group].assign(__state=states)

    def given(pdf: pd.DataFrame) -> pd.DataFrame:
        state = pdf["__state"].iloc[0]
        return follow(pdf, state if isinstance(state, str) else None)

    summaries = map_sorted_groups(rows, group, order, summed, f"{key_schema}, summary string")
    states = pinned(map_sorted_groups(summaries, keys, ["__chunk"], entered, f"{key_schema}, __state string"))
    match = rows["__chunk"] == states["__chunk"]
    for k in keys:
        match = match & rows[k].eqNullSafe(states[k])
    joined = rows.join(states, match, "left").select(rows["*"], states["__state"])
    return map_sorted_groups(joined, group, order, given, schema)
