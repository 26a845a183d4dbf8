"""Operators along one series: windows, phrases, gaps, runs, smoothing, stitching.

Series are tables of dense frames (series_id, frame_idx, ...). Work is cut into chunks of
frames (see ``scan``), so a single recording of any length spreads over many tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles
from reelgate.functions.scalars import clip
from reelgate.operators.scan import (
    Running,
    chunk_frames,
    chunked_fold,
    composed_scan,
    drop_halo,
    has_large_group,
    halo_window,
    home_chunk,
    ordered_scan,
    with_halo,
)

FRAME_RATE = 50
SERIES = ("series_id",)


def _spread(df: DataFrame, keys: Sequence[str], first: Column, last: Column, name: str) -> DataFrame:
    """Explode ``first..last`` in two steps, so that no row ever holds a long sequence."""
    block = 10_000
    blocks = df.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - first) / block)))
    ).withColumn("__from", first + F.col("__block") * block)
    blocks = blocks.where(last >= first)
    blocks = blocks.repartition(*keys, "__block")
    upto = F.least(F.col("__from") + (block - 1), last)
    return blocks.withColumn(name, F.explode(F.sequence("__from", upto))).drop("__block", "__from")


def sliding_windows(
    lengths: DataFrame, size: int, hop: int, *, keys: Sequence[str] = SERIES, n: str = "n_frames"
) -> DataFrame:
    """(keys, window_idx, start, end) of every full window; none when a series is short."""
    fits = lengths.where(F.col(n) >= size).select(*keys, F.col(n).cast("long").alias("__n"))
    last = F.expr(f"(__n - {size}) div {hop}")
    windows = _spread(fits, keys, F.lit(0).cast("long"), last, "window_idx")
    return windows.select(
        *keys,
        "window_idx",
        (F.col("window_idx") * hop).alias("start"),
        (F.col("window_idx") * hop + size).alias("end"),
    )


def covering_windows(
    lengths: DataFrame, size: int, hop: int, *, keys: Sequence[str] = SERIES, n: str = "n_frames"
) -> DataFrame:
    """Sliding windows plus a last one aligned with the end; one window for a short series."""
    sized = lengths.select(*keys, F.col(n).cast("long").alias("__n")).where(F.col("__n") > 0)
    steps = F.expr(f"greatest(__n - {size} + {hop} - 1, 0) div {hop}")
    windows = _spread(sized, keys, F.lit(0).cast("long"), steps, "window_idx")
    start = F.greatest(
        F.least(F.col("window_idx") * hop, F.col("__n") - size), F.lit(0).cast("long")
    )
    return windows.select(
        *keys, "window_idx", start.alias("start"), F.least(start + size, F.col("__n")).alias("end")
    )


def active_windows(
    windows: DataFrame,
    lengths: DataFrame,
    *,
    minimum_voiced: float = 0.25,
    minimum_rms: float = 1e-5,
    keys: Sequence[str] = SERIES,
    n: str = "n_frames",
) -> DataFrame:
    """Drop windows that are too quiet or unvoiced; the whole item where none is left.

    ``windows``: keys, start, end, voiced_fraction, rms.
    """
    kept = windows.where(
        (F.col("voiced_fraction") >= minimum_voiced) & (F.col("rms") >= minimum_rms)
    ).select(*keys, "start", "end")
    rest = lengths.join(kept.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(0).cast("long").alias("start"), F.col(n).cast("long").alias("end")
    )
    return kept.unionByName(rest)


def plan_phrases(
    lengths: DataFrame,
    minimum_s: float = 12.0,
    maximum_s: float = 20.0,
    overlap_s: float = 1.0,
    *,
    rate: int = FRAME_RATE,
    keys: Sequence[str] = SERIES,
    n: str = "n_frames",
) -> tuple[DataFrame, DataFrame]:
    """Uniform overlapping phrases that cover each series, and the series that cannot be cut."""
    if not 0 < overlap_s < minimum_s <= maximum_s:
        raise ValueError("Phrase lengths and overlap are inconsistent.")
    d = F.col("__n") / F.lit(float(rate))
    overlap = F.lit(float(overlap_s))
    most = F.ceil((d - overlap) / (maximum_s - overlap_s))
    fewest = F.greatest(F.floor((d - overlap) / (minimum_s - overlap_s)), F.lit(1).cast("long"))

    def length_of(count: str) -> Column:
        return (d + (F.col(count) - 1) * overlap) / F.col(count)

    whole = d <= maximum_s
    plan = (
        lengths.select(*keys, F.col(n).cast("long").alias("__n"))
        .withColumn("__c0", F.when(whole, F.lit(1).cast("long")).otherwise(most))
        .withColumn("__l0", length_of("__c0"))
        .withColumn(
            "__count", F.when(whole | (F.col("__l0") >= minimum_s), F.col("__c0")).otherwise(fewest)
        )
        .withColumn("__len", length_of("__count"))
        .withColumn(
            "__bad",
            (F.col("__n") <= 0) | (~whole & ~F.col("__len").between(minimum_s, maximum_s)),
        )
    )
    bad = plan.where("__bad").select(*keys, F.lit("phrase bounds cannot be met").alias("violation"))
    good = _spread(
        plan.where("not __bad"), keys, F.lit(0).cast("long"), F.col("__count") - 1, "phrase_idx"
    )
    start = F.when(F.col("phrase_idx") == 0, F.lit(0.0)).otherwise(
        F.rint(F.col("phrase_idx") * ((F.col("__len") - overlap) * rate))
    )
    good = good.withColumn("__start", start)
    end = F.when(F.col("phrase_idx") == F.col("__count") - 1, F.col("__n").cast("double")).otherwise(
        F.rint(F.col("__start") + F.col("__len") * rate)
    )
    phrases = good.select(
        *keys,
        "phrase_idx",
        F.col("__start").cast("long").alias("start_frame"),
        end.cast("long").alias("end_frame"),
    )
    return phrases, bad


def clean_value(value: str = "f0") -> Column:
    """Missing, non-finite and negative pitch counts as unvoiced."""
    v = F.col(value).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")), F.lit(0.0)).otherwise(v)


def gap_fill(
    frames: DataFrame,
    max_gap: int = 6,
    *,
    keys: Sequence[str] = SERIES,
    value: str = "f0",
    limit_cents: float = 700.0,
) -> DataFrame:
    """Fill short inner gaps geometrically where their ends lie close in pitch."""
    w = halo_window(keys)
    near = with_halo(frames.withColumn(value, clean_value(value)), max_gap + 1, max_gap + 1)
    voiced = F.when(F.col(value) > 0, F.struct("frame_idx", value))
    filled = (
        near.withColumn(
            "__p", F.last(voiced, ignorenulls=True).over(w.rowsBetween(-max_gap - 1, -1))
        )
        .withColumn(
            "__q", F.first(voiced, ignorenulls=True).over(w.rowsBetween(1, max_gap + 1))
        )
        .withColumn("__gap", F.col("__q.frame_idx") - F.col("__p.frame_idx") - 1)
    )
    ratio = F.col(f"__q.{value}") / F.col(f"__p.{value}")
    close = (F.col("__gap") <= max_gap) & (F.abs(1200 * F.log2(ratio)) <= limit_cents)
    step = (F.col("frame_idx") - F.col("__p.frame_idx")) / (F.col("__gap") + 1)
    repaired = F.when((F.col(value) <= 0) & close, F.col(f"__p.{value}") * F.pow(ratio, step))
    return drop_halo(
        filled.withColumn(value, F.coalesce(repaired, F.col(value))).drop("__p", "__q", "__gap")
    )


def spike_repair(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    value: str = "f0",
    neighbour_cents: float = 100.0,
    spike_cents: float = 700.0,
) -> DataFrame:
    """Replace isolated octave errors by the geometric mean of their neighbours, in order.

    Walking a series, a frame sees its left neighbour as already repaired. A repaired frame
    lies within half of ``neighbour_cents`` of its successor, which can therefore not be a
    spike itself; and where the left neighbour was left alone it still has its own value. So
    of each run of frames that look like spikes on the raw values, exactly the first, third,
    fifth, ... are repaired, and no sequential pass is needed.
    """
    w = halo_window(keys)
    near = (
        with_halo(frames, 1, 1)
        .withColumn("__prev", F.lag(value).over(w))
        .withColumn("__next", F.lead(value).over(w))
    )
    a, b, c = F.col("__prev"), F.col(value), F.col("__next")

    def apart(x: Column, y: Column) -> Column:
        return F.abs(1200 * F.log2(x / y))

    spike = F.when(
        (a > 0) & (b > 0) & (c > 0),
        (apart(c, a) <= neighbour_cents)
        & (F.least(apart(b, a), apart(b, c)) >= spike_cents),
    )
    marked = drop_halo(near.withColumn("__spike", F.coalesce(spike, F.lit(False))))
    marked = marked.withColumn("__calm", F.when(~F.col("__spike"), F.col("frame_idx")))
    scanned = ordered_scan(
        marked,
        keys,
        ["frame_idx"],
        {"__since": Running("max_before", "__calm")},
        chunk=home_chunk(frames),
    )
    place = F.col("frame_idx") - F.coalesce("__since", F.lit(-1).cast("long"))
    repaired = F.when(
        F.col("__spike") & (place % 2 == 1), F.sqrt(F.col("__prev") * F.col("__next"))
    )
    return scanned.withColumn(value, F.coalesce(repaired, F.col(value))).drop(
        "__prev", "__next", "__spike", "__calm", "__since"
    )


def clean_contour(frames: DataFrame, max_gap: int = 6, *, keys: Sequence[str] = SERIES) -> DataFrame:
    return spike_repair(gap_fill(frames, max_gap, keys=keys), keys=keys)


def runs(
    frames: DataFrame,
    flag: Column,
    *,
    keys: Sequence[str] = SERIES,
    sums: Sequence[str] = (),
) -> DataFrame:
    """Maximal runs of flagged frames: (keys, start, end, length, sums...), end exclusive.

    Runs are formed inside chunks; only those that touch a chunk's edge, at most two per
    chunk, are then merged across chunks.
    """
    size = chunk_frames(frames)
    inside = Window.partitionBy(*keys, "__chunk").orderBy("frame_idx")
    flagged = (
        frames.where(flag)
        .select(*keys, "frame_idx", *sums)
        .withColumn("__chunk", home_chunk(frames))
        .withColumn("__run", F.col("frame_idx") - F.row_number().over(inside))
    )
    pieces = flagged.groupBy(*keys, "__chunk", "__run").agg(
        F.min("frame_idx").alias("start"),
        (F.max("frame_idx") + 1).alias("end"),
        *[F.sum(c).alias(c) for c in sums],
    )
    columns = [*keys, "start", "end", *sums]
    touches = (F.col("start") % size == 0) | (F.col("end") % size == 0)
    inner = pieces.where(~touches).select(*columns)
    edge = pieces.where(touches).select(*columns)
    order = Window.partitionBy(*keys).orderBy("start")
    joined = (
        edge.withColumn("__new", (F.lag("end").over(order).eqNullSafe(F.col("start"))).cast("int"))
        .withColumn("__id", F.sum(1 - F.col("__new")).over(order))
        .groupBy(*keys, "__id")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .select(*columns)
    )
    return inner.unionByName(joined).withColumn("length", F.col("end") - F.col("start"))


def longest_run(
    frames: DataFrame, flag: Column, *, keys: Sequence[str] = SERIES, rate: float = FRAME_RATE
) -> DataFrame:
    """Length in seconds of the longest flagged run of every series, zero without any."""
    longest = runs(frames, flag, keys=keys).groupBy(*keys).agg(F.max("length").alias("__n"))
    series = frames.select(*keys).distinct()
    return series.join(longest, list(keys), "left").select(
        *keys, (F.coalesce("__n", F.lit(0)) / rate).alias("longest_seconds")
    )


def dropout_thresholds(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rms: str = "rms",
    factor: float = 0.03,
    floor: float = 1e-6,
) -> DataFrame:
    """Per series, the level under which a voiced frame counts as dropped out."""
    medians = exact_quantiles(
        frames.where(F.col("f0") > 0), keys, rms, {"median_rms": 0.5}
    )
    return medians.withColumn(
        "threshold", F.greatest(F.col("median_rms") * factor, F.lit(float(floor)))
    )


# Fixed values: (factor on the median level, floor) of the two dropout definitions.
DROPOUT_STRICT = (0.03, 1e-6)
DROPOUT_LOOSE = (10 ** (-35 / 20), 10 ** (-60 / 20))


def with_dropouts(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rms: str = "rms",
    factor: float = DROPOUT_STRICT[0],
    floor: float = DROPOUT_STRICT[1],
) -> DataFrame:
    """Add ``threshold`` and ``dropout`` (voiced and below the series' threshold)."""
    levels = dropout_thresholds(frames, keys=keys, rms=rms, factor=factor, floor=floor)
    return frames.join(levels.select(*keys, "threshold"), list(keys), "left").withColumn(
        "dropout",
        F.coalesce((F.col("f0") > 0) & (F.col(rms) < F.col("threshold")), F.lit(False)),
    )


def sustained_runs(
    flagged: DataFrame,
    minimum: int = 6,
    *,
    keys: Sequence[str] = SERIES,
    flag: str = "dropout",
) -> DataFrame:
    """Per series the number of flagged runs of at least ``minimum`` frames."""
    found = (
        runs(flagged, F.col(flag), keys=keys)
        .where(F.col("length") >= minimum)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    series = flagged.select(*keys).distinct()
    return series.join(found, list(keys), "left").select(
        *keys, F.coalesce("__n", F.lit(0)).cast("long").alias("sustained_runs")
    )


def classify_runs(
    flagged: DataFrame,
    *,
    minimum: int = 6,
    maximum_ms: int = 120,
    maximum_gain_db: float = 12.0,
    keys: Sequence[str] = SERIES,
    flag: str = "dropout",
    sum_sq: str = "sum_sq",
    n: str = "n",
) -> DataFrame:
    """Each dropout run as none, repairable (with its gain) or failing.

    ``flagged`` carries the threshold of its series and per-frame energy sums.
    """
    longest = max(1, round(maximum_ms * FRAME_RATE / 1000))
    cap = 10 ** (maximum_gain_db / 20)
    levels = flagged.groupBy(*keys).agg(F.max("threshold").alias("threshold"))
    found = runs(flagged, F.col(flag), keys=keys, sums=[sum_sq, n]).join(
        levels, list(keys), "left"
    )
    rms = F.sqrt(F.try_divide(F.col(sum_sq), F.col(n)))
    gain = F.when(
        rms > 1e-8, F.least(F.lit(cap), F.try_divide(F.col("threshold") * 1.05, rms))
    )
    sized = F.col("length").between(minimum, longest)
    return (
        found.withColumn("rms", rms)
        .withColumn("gain", F.when(sized & (gain > 1), gain))
        .withColumn(
            "class",
            F.when(F.col("length") < minimum, "none")
            .when(F.col("gain").isNotNull(), "repairable")
            .otherwise("failing"),
        )
        .select(*keys, "start", "end", "length", "rms", "gain", "class")
    )


def positive_log_flux(
    frames: DataFrame, value: str, *, keys: Sequence[str] = SERIES, name: str = "flux"
) -> DataFrame:
    """Rise of the log level from frame to frame; zero at the start and on falls."""
    log = F.ln(F.col(value) + F.lit(1e-7))
    near = with_halo(frames.withColumn("__log", log), 1, 0)
    rise = F.col("__log") - F.lag("__log").over(halo_window(keys))
    flux = F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0))
    return drop_halo(near.withColumn(name, flux)).drop("__log")


def robust_scale(
    frames: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = SERIES,
    upper: float = 2.0,
    large: bool | None = None,
) -> DataFrame:
    """Divide each column by its series' 95th percentile and clip to 0..upper."""
    if large is None:
        large = has_large_group(frames, keys)
    for c in columns:
        tops = exact_quantiles(frames, keys, c, {f"__top_{c}": 0.95}, large=large)
        frames = frames.join(tops, list(keys), "left").withColumn(
            c, clip(F.col(c) / F.greatest(F.col(f"__top_{c}"), F.lit(1e-12)), 0.0, upper)
        )
        frames = frames.drop(f"__top_{c}")
    return frames


def coverage_check(
    phrases: DataFrame,
    duration: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    order: str = "phrase_idx",
    large: bool | None = None,
) -> DataFrame:
    """Whether the phrases of a series, in order, cover it without a gap.

    ``phrases``: keys, order, start_seconds, end_seconds; ``duration``: keys, duration_seconds.
    """
    scanned = ordered_scan(
        phrases,
        keys,
        [order],
        {"__place": Running("ordinal"), "__reached": Running("max_before", "end_seconds")},
        large=large,
    )
    reached = F.greatest(F.coalesce("__reached", F.lit(0.0)), F.lit(0.0))
    good = (
        (F.col("start_seconds") <= reached + 0.001)
        & (F.col("end_seconds") > F.col("start_seconds"))
        & ((F.col("__place") > 0) | (F.abs("start_seconds") <= 0.001))
    )
    per = scanned.groupBy(*keys).agg(
        F.min(good).alias("__good"), F.max("end_seconds").alias("__until")
    )
    return duration.join(per, list(keys), "left").select(
        *keys,
        F.coalesce(
            F.col("__good") & (F.col("__until") >= F.col("duration_seconds") - 0.02), F.lit(False)
        ).alias("covered"),
    )


def join_jump(
    joins: DataFrame, frames: DataFrame, *, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Largest level jump per series over the joins that fall inside voicing.

    ``joins``: keys, frame_idx (last frame at most), before_rms, after_rms, null where the
    5 ms windows leave the recording.
    """
    voiced = frames.where(F.col("f0") > 0).select(*keys, "frame_idx")
    left = voiced.withColumn("frame_idx", F.col("frame_idx") + 1)
    inside = joins.join(voiced, [*keys, "frame_idx"], "left_semi").join(
        left, [*keys, "frame_idx"], "left_semi"
    )
    floor = F.lit(1e-12)
    jump = F.abs(
        20
        * F.log10(F.greatest(F.col("after_rms"), floor) / F.greatest(F.col("before_rms"), floor))
    )
    known = F.col("after_rms").isNotNull() & F.col("before_rms").isNotNull()
    worst = inside.groupBy(*keys).agg(F.max(F.when(known, jump)).alias("__worst"))
    series = joins.select(*keys).distinct()
    return series.join(worst, list(keys), "left").select(
        *keys, F.coalesce("__worst", F.lit(0.0)).alias("max_join_jump_db")
    )


def smooth_gain(
    frames: DataFrame,
    value: str,
    valid: Column,
    *,
    taps: int = 21,
    keys: Sequence[str] = SERIES,
    name: str = "smoothed",
) -> DataFrame:
    """Hann-weighted moving average, zero outside the series and on invalid frames."""
    weights = np.hanning(taps)
    weights = weights / weights.sum()
    reach = taps // 2
    w = halo_window(keys)
    clean = frames.withColumn(
        "__x", F.when(F.coalesce(valid, F.lit(False)), F.col(value)).otherwise(F.lit(0.0))
    )
    near = with_halo(clean, reach, reach)
    total = F.lit(0.0)
    for offset in range(-reach, reach + 1):
        weight = float(weights[offset + reach])
        if weight == 0.0:
            continue
        if offset < 0:
            x = F.lag("__x", -offset).over(w)
        elif offset > 0:
            x = F.lead("__x", offset).over(w)
        else:
            x = F.col("__x")
        total = total + F.coalesce(x, F.lit(0.0)) * weight
    return drop_halo(near.withColumn(name, total)).drop("__x")


def grid_interpolate(
    frames: DataFrame,
    lengths: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    n: str = "n_frames",
    m: str = "n_out",
) -> DataFrame:
    """Resample each series linearly from n frames to m points.

    Every frame emits the output points between itself and its successor, so no output is
    joined back to its two inputs. ``lengths``: keys, n, m.
    """
    near = with_halo(frames.select(*keys, "frame_idx", value), 0, 1)
    pairs = drop_halo(near.withColumn("__next", F.lead(value).over(halo_window(keys))))
    sized = lengths.select(
        *keys, F.col(n).cast("long").alias("__n"), F.col(m).cast("long").alias("__m")
    )
    pairs = pairs.join(sized, list(keys))
    first = F.expr("(frame_idx * (__m - 1) + __n - 2) div (__n - 1)")
    until = F.expr("((frame_idx + 1) * (__m - 1) + __n - 2) div (__n - 1) - 1")
    last = F.when(F.col("frame_idx") == F.col("__n") - 1, F.col("__m") - 1).otherwise(until)
    only = (F.col("__n") == 1) | (F.col("__m") == 1)
    lo = F.when(only, F.when(F.col("frame_idx") == 0, F.lit(0).cast("long"))).otherwise(first)
    hi = F.when(F.col("__m") == 1, F.lit(0).cast("long")).when(
        F.col("__n") == 1, F.col("__m") - 1
    ).otherwise(last)
    ranged = pairs.withColumn("__lo", lo).withColumn("__hi", hi).where(
        F.col("__lo").isNotNull() & (F.col("__hi") >= F.col("__lo"))
    )
    points = ranged.withColumn("out_idx", F.explode(F.sequence("__lo", "__hi")))
    part = F.when(
        F.col("__m") > 1,
        F.expr("(out_idx * (__n - 1) - frame_idx * (__m - 1))") / (F.col("__m") - 1),
    ).otherwise(F.lit(0.0))
    mixed = F.col(value) + part * F.coalesce(F.col("__next") - F.col(value), F.lit(0.0))
    return points.select(*keys, "out_idx", mixed.alias(value))


def relative_level(
    candidates: DataFrame,
    *,
    key: str = "song_id",
    level: str = "active_rms_dbfs",
    level_range: str = "one_second_level_range_db",
    voiced: str = "voiced_fraction",
    max_deficit: float = 6.0,
    max_range: float = 8.0,
    large: bool | None = None,
) -> DataFrame:
    """Drop candidates far below their song's upper level and rate the others 0..1."""
    tops = exact_quantiles(candidates, [key], level, {"__top": 0.75}, large=large)
    deficit = F.greatest(F.col("__top") - F.col(level), F.lit(0.0))
    confidence = clip(
        1.0
        - deficit / max(max_deficit, 1e-6) * 0.35
        - F.col(level_range) / max(max_range, 1e-6) * 0.25
        - F.abs(F.col(voiced) - 0.84) * 0.5,
        0.0,
        1.0,
    )
    return (
        candidates.join(tops, key)
        .withColumn("relative_level_deficit_db", deficit)
        .where(F.col("relative_level_deficit_db") <= max_deficit)
        .withColumn("confidence", confidence)
        .drop("__top")
    )


def peak_pick(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    minimum_gap: int = 10,
    floor: float = 0.08,
    large: bool | None = None,
) -> DataFrame:
    """Separated local maxima above median + max(1.5 MAD, floor): (keys, frame_idx, value).

    Inside the gap a higher peak takes the place of the last one, which is a walk along the
    series; it runs over the candidate peaks only, chunk by chunk.
    """
    if large is None:
        large = has_large_group(frames, keys)
    levels = exact_quantiles(frames, keys, value, {"__median": 0.5}, large=large)
    off = frames.join(levels, list(keys)).withColumn("__dev", F.abs(F.col(value) - F.col("__median")))
    spread = exact_quantiles(off, keys, "__dev", {"__mad": 0.5}, large=large)
    bars = levels.join(spread, list(keys)).select(
        *keys,
        (F.col("__median") + F.greatest(1.5 * F.col("__mad"), F.lit(floor))).alias("__bar"),
    )
    w = halo_window(keys)
    near = (
        with_halo(frames.select(*keys, "frame_idx", F.col(value).cast("double").alias("value")), 1, 1)
        .withColumn("__l", F.lag("value").over(w))
        .withColumn("__r", F.lead("value").over(w))
    )
    peaks = (
        drop_halo(near)
        .where((F.col("value") > F.col("__l")) & (F.col("value") >= F.col("__r")))
        .drop("__l", "__r")
        .join(bars, list(keys))
        .where(F.col("value") >= F.col("__bar"))
        .drop("__bar")
    )
    columns = [*keys, "frame_idx", "value"]
    types = dict(peaks.dtypes)

    def walk(pdf: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
        held = tuple(json.loads(state)) if state else None
        keep: list[tuple[int, float]] = []
        # the peak a chunk ends with stays open and is emitted by the chunk that follows
        for at, height in zip(pdf["frame_idx"].tolist(), pdf["value"].tolist(), strict=True):
            if held is None:
                held = (at, height)
            elif at - held[0] >= minimum_gap:
                keep.append(held)
                held = (at, height)
            elif height > held[1]:
                held = (at, height)
        out = pd.DataFrame(keep, columns=["frame_idx", "value"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[columns], json.dumps(held) if held else None

    # a closing row per series, beyond every gap, releases the last open peak
    ends = frames.groupBy(*keys).agg((F.max("frame_idx") + minimum_gap + 1).alias("frame_idx"))
    closed = peaks.select(*columns).unionByName(
        ends.select(*keys, "frame_idx", F.lit(float("-inf")).alias("value"))
    )
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    reach = chunk_frames(frames) - minimum_gap - 1
    brief = frames.where(F.col("frame_idx") >= reach).isEmpty()
    return chunked_fold(
        closed, keys, home_chunk(frames), ["frame_idx"], walk, schema, one_chunk=brief
    )


_LIMIT_DB = 6.0
_SILENT = 1e-8


@dataclass(frozen=True)
class GainMap:
    """What a run of pieces makes of the gain in front of it: clip(gain + shift, low, high), by ranges.

    ``parts`` are (from, shift, low, high), each for gains above ``from`` up to the next part's. Steps
    compose exactly: adding to a clipped sum and clipping again is one clipped sum, and a
    piece that starts anew is one with low = high = 0.
    """

    parts: tuple[tuple[float, float, float, float], ...] = ((-math.inf, 0.0, -math.inf, math.inf),)

    def __call__(self, gain: float) -> float:
        _, shift, low, high = next(p for p in reversed(self.parts) if gain > p[0] or p[0] == -math.inf)
        return min(high, max(low, gain + shift))

    def then(self, shift: float | None, above: float) -> GainMap:
        """Followed by a piece that adds ``shift`` to gains over ``above`` and is 0 otherwise (or always)."""
        if shift is None:
            return GainMap(((-math.inf, 0.0, 0.0, 0.0),))
        out: list[tuple[float, float, float, float]] = []

        def put(begin: float, moved: float, low: float, high: float) -> None:
            if not out or out[-1][1:] != (moved, low, high):
                out.append((begin, moved, low, high))

        for number, (begin, moved, low, high) in enumerate(self.parts):
            end = self.parts[number + 1][0] if number + 1 < len(self.parts) else math.inf
            # this part gives more than ``above`` for gains over ``split``
            split = math.inf if high <= above else -math.inf if low > above else above - moved
            if split > begin:
                put(begin, 0.0, 0.0, 0.0)
            if split < end:
                limits = [min(_LIMIT_DB, max(-_LIMIT_DB, x + shift)) for x in (low, high)]
                put(max(begin, split), moved + shift, *limits)
        return GainMap(tuple(out))


def _join_gains(levels: DataFrame, keys: Sequence[str], key_schema: str, chunk: int) -> DataFrame:
    """The gain of every piece, from the level behind it and its own, as a scan over chunks of pieces.

    A piece takes up the gain before it where both meet above silence; how loud the tail before it is
    after its gain decides that, so the threshold is one on the gain.
    """
    around = ordered_scan(
        levels, keys, ["__place"], {"__before": Running("lag", "__tail_rms")}, chunk=F.expr(f"__place div {chunk}")
    )

    def decibels(over: Column, under: Column) -> Column:
        return 20 * F.log10(over / under)

    meets = (F.col("__head") > 0) & (F.col("__before") > 0) & (F.col("__head_rms") > _SILENT)
    steps = around.select(
        *keys,
        "piece_idx",
        "__place",
        F.when(meets, decibels(F.col("__before"), F.col("__head_rms"))).alias("__shift"),
        F.when(meets, decibels(F.lit(_SILENT), F.col("__before"))).alias("__above"),
    )

    def each(pdf: pd.DataFrame) -> Iterator[tuple[float | None, float]]:
        for shift, above in zip(pdf["__shift"].tolist(), pdf["__above"].tolist(), strict=True):
            yield (None if shift is None or math.isnan(shift) else shift), above

    def summary(pdf: pd.DataFrame) -> str:
        done = GainMap()
        for shift, above in each(pdf):
            done = done.then(shift, above)
        return json.dumps(done.parts)

    def advance(text: str, state: str | None) -> str:
        parts = tuple(tuple(p) for p in json.loads(text))
        return repr(GainMap(parts)(float(state or 0.0)))

    def follow(pdf: pd.DataFrame, state: str | None) -> pd.DataFrame:
        gain, gains = float(state or 0.0), []
        for shift, above in each(pdf):
            gain = min(_LIMIT_DB, max(-_LIMIT_DB, gain + shift)) if shift is not None and gain > above else 0.0
            gains.append(gain)
        return pdf[[*keys, "piece_idx"]].assign(join_gain_db=gains)

    return composed_scan(
        steps, keys, F.expr(f"__place div {chunk}"), ["__place"], summary, advance, follow, f"{key_schema}, join_gain_db double"
    )


def overlap_stitch(
    pieces: DataFrame,
    lengths: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    zero_fill: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Join overlapping pieces with matched gain and equal-power fades.

    ``pieces``: keys, piece_idx, start, end, values; ``lengths``: keys, total. Returns the
    joined points (keys, idx, value), the gain of every piece in decibels, and violations.
    Each piece may overlap its two neighbours only. Its gain depends on the gain before it; as such
    steps compose, gains of any number of pieces follow from one scan over chunks of them (one
    pair of levels per piece). The audio itself is only weighted and summed per point. A piece
    of any length takes part; one that its neighbour covers is faded in whole.
    """
    sized = lengths.select(*keys, F.col("total").cast("long").alias("__total"))
    cut = pieces.join(sized, list(keys)).withColumn("end", F.least("end", F.col("__total")))
    around = ordered_scan(
        cut,
        keys,
        ["start", "piece_idx"],
        {
            "__prev_end": Running("lag", "end"),
            "__until": Running("max_before", "end"),
            "__place": Running("ordinal"),
        },
    )
    around = ordered_scan(
        around, keys, ["start", "piece_idx"], {"__next_start": Running("lag", "start")},
        descending=True,
    )
    last_end = around.groupBy(*keys).agg(F.max("end").alias("__reach"))
    bad_range = (F.col("start") < 0) | (F.col("end") <= F.col("start"))
    gap = F.col("start") > F.coalesce("__until", F.lit(0))
    triple = F.coalesce(F.col("__next_start") < F.col("__prev_end"), F.lit(False))
    kind = F.when(bad_range, "invalid range").when(triple, "three pieces overlap")
    if not zero_fill:
        kind = kind.when(gap, "gap")
    violations = around.withColumn("violation", kind).where(F.col("violation").isNotNull()).select(
        *keys, "piece_idx", "violation"
    )
    if not zero_fill:
        short = sized.join(last_end, list(keys), "left").where(
            ~F.col("__reach").eqNullSafe(F.col("__total"))
        )
        violations = violations.unionByName(
            short.select(
                *keys,
                F.lit(None).cast(dict(pieces.dtypes)["piece_idx"]).alias("piece_idx"),
                F.lit("end not reached").alias("violation"),
            )
        )

    size = F.col("end") - F.col("start")
    head = F.greatest(
        F.least(F.coalesce("__prev_end", F.lit(0)), F.col("end")) - F.col("start"),
        F.lit(0).cast("long"),
    )
    tail = F.greatest(
        F.col("end") - F.greatest(F.coalesce("__next_start", F.col("end")), F.col("start")),
        F.lit(0).cast("long"),
    )
    fitted = F.slice(
        F.concat("values", F.array_repeat(F.lit(0.0), size.cast("int"))), 1, size.cast("int")
    )
    body = (
        around.withColumn("__head", head)
        .withColumn("__tail", tail)
        .withColumn("values", fitted)
    )

    def level(part: Column, count: Column) -> Column:
        energy = F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)
        return F.when(count > 0, F.sqrt(energy / count)).otherwise(F.lit(0.0))

    body = body.withColumn(
        "__head_rms",
        level(F.slice("values", 1, F.col("__head").cast("int")), F.col("__head")),
    ).withColumn(
        "__tail_rms",
        level(
            F.slice("values", (size - F.col("__tail") + 1).cast("int"), F.col("__tail").cast("int")),
            F.col("__tail"),
        ),
    )
    types = dict(pieces.dtypes)
    gains = _join_gains(
        body.select(*keys, "piece_idx", "__place", "__head", "__head_rms", "__tail_rms"),
        keys,
        ", ".join(f"`{c}` {types[c]}" for c in [*keys, "piece_idx"]),
        chunk_frames(pieces),
    )
    placed = body.join(gains, [*keys, "piece_idx"]).select(
        *keys,
        "start",
        "__head",
        "__tail",
        size.alias("__size"),
        F.pow(F.lit(10.0), F.col("join_gain_db") / 20).alias("__gain"),
        F.posexplode("values").alias("__pos", "__x"),
    )
    # equal-power weights: sine over the head, cosine over the tail
    half = math.pi / 2
    head_phase = F.when(
        F.col("__head") > 1, F.col("__pos") / (F.col("__head") - 1) * half
    ).otherwise(F.lit(0.0))
    into = F.col("__pos") - (F.col("__size") - F.col("__tail"))
    tail_phase = F.when(F.col("__tail") > 1, into / (F.col("__tail") - 1) * half).otherwise(
        F.lit(0.0)
    )
    weight = F.when(F.col("__pos") < F.col("__head"), F.sin(head_phase)).otherwise(F.lit(1.0))
    weight = weight * F.when(into >= 0, F.cos(tail_phase)).otherwise(F.lit(1.0))
    joined = (
        placed.select(
            *keys,
            (F.col("start") + F.col("__pos")).alias("idx"),
            (F.col("__x") * F.col("__gain") * weight).alias("__y"),
        )
        .groupBy(*keys, "idx")
        .agg(F.sum("__y").alias("value"))
    )
    return joined, gains, violations
