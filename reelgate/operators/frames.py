"""Measurements over frame tables: per series, per second, per sliding window, per pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles
from reelgate.functions.scalars import amplitude_db, cents, clip
from reelgate.operators.scan import Running, chunk_frames, has_large_group, ordered_scan
from reelgate.operators.sequence import FRAME_RATE, SERIES, with_dropouts


def number_frames(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, large: bool | None = None
) -> DataFrame:
    """Give the rows of each series a dense ``frame_idx`` in the given total order."""
    return ordered_scan(rows, keys, order, {"frame_idx": Running("ordinal")}, large=large)


def series_lengths(frames: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))


def second_levels(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rate: int = FRAME_RATE,
    minimum_voiced: float = 0.2,
) -> DataFrame:
    """Level of every whole second with enough voicing: (keys, second, rms)."""
    per = (
        frames.withColumn("second", F.expr(f"frame_idx div {rate}"))
        .groupBy(*keys, "second")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.avg((F.col("f0") > 0).cast("double")).alias("__voiced"),
            F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"),
        )
    )
    return per.where((F.col("__n") == rate) & (F.col("__voiced") >= minimum_voiced)).drop(
        "__n", "__voiced"
    )


def one_second_level_range(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rate: int = FRAME_RATE,
    large: bool | None = None,
) -> DataFrame:
    """(keys, one_second_level_range_db); series without a sustained second are absent."""
    levels = second_levels(frames, keys=keys, rate=rate).withColumn("__db", amplitude_db("rms"))
    spread = exact_quantiles(
        levels, keys, "__db", {"__lo": 0.05, "__hi": 0.95}, large=large
    ).select(
        *keys,
        F.least(F.col("__hi") - F.col("__lo"), F.lit(120.0)).alias("one_second_level_range_db"),
    )
    brief = (
        frames.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("f0") > 0).alias("__voiced"))
        .where((F.col("__n") < rate) & F.col("__voiced"))
        .select(*keys, F.lit(0.0).alias("one_second_level_range_db"))
    )
    return spread.unionByName(brief)


def series_metrics(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rate: int = FRAME_RATE,
    sample_rate: int | None = None,
) -> DataFrame:
    """Acoustic metrics per series; ``rejected`` tells why a series has none.

    ``frames``: keys, frame_idx, f0, rms and, from decoded audio, peak, clipped_n, n.
    """
    large = has_large_group(frames, keys)
    voiced = F.col("f0") > 0
    energy = F.col("rms") * F.col("rms")
    aggregates = {
        "n_frames": F.count(F.lit(1)),
        "voiced_fraction": F.avg(voiced.cast("double")),
        "__active": F.sqrt(F.avg(F.when(voiced, energy))),
    }
    if "peak" in frames.columns:
        aggregates["__peak"] = F.max("peak")
        aggregates["clipping_fraction"] = F.try_divide(F.sum("clipped_n"), F.sum("n"))
        aggregates["__samples"] = F.sum("n")
    base = exact_quantiles(
        frames,
        keys,
        F.when(voiced, F.col("f0")),
        {"median_f0_hz": 0.5, "f0_p05_hz": 0.05, "f0_p95_hz": 0.95},
        extras=aggregates,
        large=large,
    )
    levels = one_second_level_range(frames, keys=keys, rate=rate, large=large)
    joined = base.join(levels, list(keys), "left")
    duration = F.col("n_frames") / F.lit(float(rate))
    if sample_rate is not None and "peak" in frames.columns:
        duration = F.least(F.col("__samples") / F.lit(float(sample_rate)), duration)
    columns = [
        duration.alias("duration_seconds"),
        "voiced_fraction",
        "median_f0_hz",
        "f0_p05_hz",
        "f0_p95_hz",
        F.when(F.col("__active").isNotNull(), amplitude_db("__active")).alias("active_rms_dbfs"),
        "one_second_level_range_db",
    ]
    if "peak" in frames.columns:
        columns += [amplitude_db("__peak").alias("peak_dbfs"), "clipping_fraction"]
    rejected = F.when(F.col("median_f0_hz").isNull(), "no voiced frame").when(
        F.col("one_second_level_range_db").isNull(), "no sustained voiced second"
    )
    return joined.select(*keys, *columns, rejected.alias("rejected"))


def _element_quantile(ordered: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array."""
    rank = (F.size(ordered) - 1) * F.lit(p)
    low = F.get(ordered, F.floor(rank).cast("int"))
    high = F.get(ordered, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def window_metrics(
    frames: DataFrame,
    size: int,
    hop: int,
    *,
    keys: Sequence[str] = SERIES,
    rate: int = FRAME_RATE,
    minimum_voiced: float = 0.2,
) -> DataFrame:
    """Metrics of every full sliding window, with one shuffle of the frames.

    Frames are first packed into blocks that divide window, hop and second. A window is a
    few consecutive blocks, so frames are not multiplied by the number of windows they lie
    in; only the blocks at a chunk's edge are copied into the chunk before.

    ``frames``: keys, frame_idx, f0, rms and optionally peak, clipped_n, n, mid_sq, side_sq, channels.
    Mono counts as fully centred (60 dB), as in ``centre_dominance``.
    """
    block = math.gcd(math.gcd(size, hop), rate)
    per_window, per_hop, per_second = size // block, hop // block, rate // block
    chunk_blocks = max(chunk_frames(frames) // block, per_window)
    sampled = "peak" in frames.columns
    stereo = "mid_sq" in frames.columns
    told = stereo and "channels" in frames.columns
    extra = (["peak", "clipped_n", "n"] if sampled else []) + (
        ["mid_sq", "side_sq"] if stereo else []
    )
    extra += ["channels"] if told else []
    placed = frames.select(*keys, "frame_idx", "f0", "rms", *extra).withColumn(
        "__block", F.expr(f"frame_idx div {block}")
    )
    first = F.greatest(
        F.expr(f"(__block - {per_window - 1}) div {chunk_blocks}"), F.lit(0).cast("long")
    )
    placed = placed.withColumn(
        "__chunk", F.explode(F.sequence(first, F.expr(f"__block div {chunk_blocks}")))
    ).repartition(*keys, "__chunk")
    voiced = F.col("f0") > 0
    energy = F.col("rms") * F.col("rms")
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.sum(voiced.cast("long")).alias("voiced_n"),
        F.sum(energy).alias("energy"),
        F.coalesce(F.sum(F.when(voiced, energy)), F.lit(0.0)).alias("voiced_energy"),
        F.sort_array(F.collect_list(F.struct("frame_idx", "f0"))).alias("contour"),
    ]
    if sampled:
        aggregates += [
            F.max("peak").alias("peak"),
            F.sum("clipped_n").alias("clipped"),
            F.sum("n").alias("samples"),
        ]
    if stereo:
        aggregates += [F.sum("mid_sq").alias("mid"), F.sum("side_sq").alias("side")]
    if told:
        aggregates.append(F.max("channels").alias("channels"))
    blocks = placed.groupBy(*keys, "__chunk", "__block").agg(*aggregates)
    fields = [c for c in blocks.columns if c not in (*keys, "__chunk", "__block")]
    ahead = (
        Window.partitionBy(*keys, "__chunk").orderBy("__block").rowsBetween(0, per_window - 1)
    )
    opened = (
        blocks.withColumn("__blocks", F.collect_list(F.struct(*fields)).over(ahead))
        .where(F.expr(f"__block % {per_hop} = 0 AND __block div {chunk_blocks} = __chunk"))
        .where(F.size("__blocks") == per_window)
        .select(*keys, (F.col("__block") * block).alias("start_frame"), "__blocks")
    )

    def total(field: str) -> Column:
        return F.aggregate(
            F.transform("__blocks", lambda b: b[field].cast("double")),
            F.lit(0.0),
            lambda a, x: a + x,
        )

    contour = F.flatten(F.transform("__blocks", lambda b: b["contour"]["f0"]))
    opened = opened.where(total("n") == size).withColumn("__f0", contour)
    opened = opened.withColumn("__pitch", F.sort_array(F.filter("__f0", lambda x: x > 0)))
    whole = size // rate

    def second(s: Column) -> Column:
        part = F.slice("__blocks", s * per_second + 1, per_second)
        n = F.aggregate(part, F.lit(0.0), lambda a, b: a + b["n"])
        v = F.aggregate(part, F.lit(0.0), lambda a, b: a + b["voiced_n"])
        e = F.aggregate(part, F.lit(0.0), lambda a, b: a + b["energy"])
        return F.when(v / n >= minimum_voiced, amplitude_db(F.sqrt(e / n)))

    if whole:
        levels = F.sort_array(
            F.array_compact(
                F.transform(F.sequence(F.lit(0), F.lit(whole - 1)), lambda s: second(s))
            )
        )
    else:
        levels = F.when(F.size("__pitch") > 0, F.array(F.lit(0.0))).otherwise(
            F.array().cast("array<double>")
        )
    opened = opened.withColumn("__levels", levels)
    longest = F.aggregate(
        "__f0",
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            F.when(x > 0, a["run"] + 1).otherwise(0).alias("run"),
            F.greatest(a["best"], F.when(x > 0, a["run"] + 1).otherwise(0)).alias("best"),
        ),
        lambda a: a["best"],
    )
    heard = F.size("__pitch") > 0
    active = F.sqrt(F.try_divide(total("voiced_energy"), total("voiced_n")))
    columns = [
        F.lit(size / rate).alias("duration_seconds"),
        (total("voiced_n") / size).alias("voiced_fraction"),
        F.when(heard, _element_quantile(F.col("__pitch"), 0.5)).alias("median_f0_hz"),
        F.when(heard, _element_quantile(F.col("__pitch"), 0.05)).alias("f0_p05_hz"),
        F.when(heard, _element_quantile(F.col("__pitch"), 0.95)).alias("f0_p95_hz"),
        F.when(heard, amplitude_db(active)).alias("active_rms_dbfs"),
        F.when(
            F.size("__levels") > 0,
            F.least(
                _element_quantile(F.col("__levels"), 0.95)
                - _element_quantile(F.col("__levels"), 0.05),
                F.lit(120.0),
            ),
        ).alias("one_second_level_range_db"),
        (longest / F.lit(float(rate))).alias("longest_voicing_seconds"),
    ]
    if sampled:
        peak = F.array_max(F.transform("__blocks", lambda b: b["peak"]))
        columns += [
            amplitude_db(peak).alias("peak_dbfs"),
            F.try_divide(total("clipped"), total("samples")).alias("clipping_fraction"),
        ]
    if stereo:
        centred = _dominance(total("mid"), total("side"))
        if told:
            widest = F.array_max(F.transform("__blocks", lambda b: b["channels"]))
            centred = F.when(widest < 2, F.lit(MONO_DOMINANCE_DB)).otherwise(centred)
        columns.append(centred.alias("centre_dominance_db"))
    rejected = F.when(~heard, "no voiced frame").when(
        F.size("__levels") == 0, "no sustained voiced second"
    )
    return opened.select(
        *keys,
        "start_frame",
        (F.col("start_frame") + size).alias("end_frame"),
        *columns,
        rejected.alias("rejected"),
    )


#: Centre dominance of mono audio (fixed value).
MONO_DOMINANCE_DB = 60.0


def _dominance(mid_sq: Column, side_sq: Column) -> Column:
    # the numbers of samples cancel in the ratio
    floor = F.lit(1e-12)
    ratio = F.greatest(F.sqrt(mid_sq), floor) / F.greatest(F.sqrt(side_sq), floor)
    return clip(20 * F.log10(ratio), -120.0, 120.0)


def centre_dominance(
    frames: DataFrame, *, keys: Sequence[str] = SERIES, channels: str = "channels"
) -> DataFrame:
    """Centred against side level per series; mono counts as fully centred (60 dB)."""
    mid = F.sqrt(F.sum("mid_sq") / F.sum("n"))
    side = F.sqrt(F.sum("side_sq") / F.sum("n"))
    floor = F.lit(1e-12)
    ratio = 20 * F.log10(F.greatest(mid, floor) / F.greatest(side, floor))
    return frames.groupBy(*keys).agg(
        F.when(F.max(channels) < 2, F.lit(MONO_DOMINANCE_DB))
        .otherwise(clip(ratio, -120.0, 120.0))
        .alias("centre_dominance_db")
    )


def active_rms(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    frame_length: int = 2048,
    threshold_dbfs: float = -45.0,
) -> DataFrame:
    """Level over the loud full frames, over everything where no frame is loud.

    ``frames``: keys, sum_sq, n (the last frame of a series may be partial).
    """
    loud = (F.col("n") == frame_length) & (
        F.sqrt(F.col("sum_sq") / F.col("n")) >= 10 ** (threshold_dbfs / 20)
    )
    return frames.groupBy(*keys).agg(
        F.sqrt(
            F.coalesce(
                F.try_divide(F.sum(F.when(loud, F.col("sum_sq"))), F.sum(F.when(loud, F.col("n")))),
                F.try_divide(F.sum("sum_sq"), F.sum("n")),
            )
        ).alias("active_rms")
    )


def balance_db(
    a_frames: DataFrame, b_frames: DataFrame, *, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Median level difference on the active frames of a; null without any.

    Both have keys, frame_idx, rms at ten frames a second. Levels that equal the bar to 12
    digits are active, however the quantile was rounded.
    """
    large = has_large_group(a_frames, keys)
    heard = a_frames.where(F.col("rms") > 10 ** (-60 / 20))
    bars = exact_quantiles(heard, keys, "rms", {"__p60": 0.6}, large=large).select(
        *keys, F.greatest(F.lit(10 ** (-45 / 20)), F.col("__p60") * 0.1).alias("__bar")
    )
    pairs = (
        a_frames.select(*keys, "frame_idx", F.col("rms").alias("__a"))
        .join(b_frames.select(*keys, "frame_idx", F.col("rms").alias("__b")), [*keys, "frame_idx"])
        .join(bars, list(keys))
        .where((F.round("__a", 12) >= F.round("__bar", 12)) & (F.col("__b") > 1e-8))
    )
    difference = amplitude_db("__a") - amplitude_db("__b")
    found = exact_quantiles(pairs, keys, difference, {"balance_db": 0.5}, large=large)
    return a_frames.select(*keys).distinct().join(found, list(keys), "left")


def dropout_fraction(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    factor: float = 0.03,
    floor: float = 1e-6,
) -> DataFrame:
    """Share of voiced frames that drop out, per series with voicing."""
    flagged = with_dropouts(frames, keys=keys, factor=factor, floor=floor)
    return (
        flagged.where(F.col("f0") > 0)
        .groupBy(*keys)
        .agg(F.avg(F.col("dropout").cast("double")).alias("dropout_fraction"))
    )


def compare_series(
    target: DataFrame, other: DataFrame, *, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Pair two contours frame by frame, up to the shorter one: adds ``cents_error``."""
    right = other.select(*keys, "frame_idx", F.col("f0").alias("other_f0"))
    joined = target.select(*keys, "frame_idx", "f0").join(right, [*keys, "frame_idx"])
    return joined.withColumn("cents_error", F.abs(cents("other_f0", "f0")))


def pitch_error(
    pairs: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    gross_cents: float = 200.0,
    unmatched: float = float("inf"),
    large: bool | None = None,
) -> DataFrame:
    """Median error over frames voiced in both, and the share of target-voiced frames that
    are off by more than ``gross_cents`` or unvoiced in the other series."""
    off = F.col("cents_error").isNull() | (F.col("cents_error") > gross_cents)
    found = exact_quantiles(
        pairs.where(F.col("f0") > 0),
        keys,
        "cents_error",
        {"__median": 0.5},
        extras={"f0_gross_error_fraction": F.avg(off.cast("double"))},
        large=large,
    )
    return found.select(
        *keys,
        F.coalesce("__median", F.lit(unmatched)).alias("f0_median_error_cents"),
        "f0_gross_error_fraction",
    )


def level_match(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    limit_db: float = 6.0,
) -> tuple[DataFrame, DataFrame]:
    """Global gain per series and the clipped residual per frame.

    ``frames``: keys, frame_idx, f0, guide_rms, other_rms. Series without a valid frame are
    absent from the first result.
    """
    valid = (F.col("f0") > 0) & (F.col("guide_rms") > 1e-8) & (F.col("other_rms") > 1e-8)
    compared = frames.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "__diff", amplitude_db("guide_rms") - amplitude_db("other_rms")
    )
    gains = exact_quantiles(compared.where("valid"), keys, "__diff", {"global_gain_db": 0.5})
    residual = F.when(
        F.col("valid"), clip(F.col("__diff") - F.col("global_gain_db"), -limit_db, limit_db)
    ).otherwise(F.lit(0.0))
    rows = (
        compared.join(gains, list(keys))
        .withColumn("residual_db", residual)
        .drop("__diff", "global_gain_db")
    )
    return gains, rows


def frame_count_matches(
    frames: DataFrame,
    durations: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rate: int = FRAME_RATE,
    tolerance: float = 0.05,
) -> DataFrame:
    """Whether a contour lasts as long as its audio."""
    return durations.join(series_lengths(frames, keys), list(keys), "left").select(
        *keys,
        F.coalesce(
            F.abs(F.col("n_frames") / F.lit(float(rate)) - F.col("duration_seconds")) <= tolerance,
            F.lit(False),
        ).alias("timing_ok"),
    )

