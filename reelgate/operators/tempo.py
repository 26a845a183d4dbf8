"""Rhythm: transient envelopes, onset statistics, tempo candidates, robust ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles, medians
from reelgate.operators.scan import has_large_group, map_sorted_groups, with_halo
from reelgate.operators.select import non_overlapping_topk
from reelgate.operators.sequence import (
    SERIES,
    peak_pick,
    positive_log_flux,
    robust_scale,
)

# Weights of the upbeat score.
UPBEAT_WEIGHTS = {
    "pulse_bpm": 0.45,
    "onset_density_per_second": 0.25,
    "pulse_confidence": 0.15,
    "transient_activity": 0.15,
}
# Lowest and highest tempo, number of steps, spacing, candidates kept.
TEMPO_RANGE = (55.0, 190.0)
TEMPO_STEPS = 541
TEMPO_SPACING = 4.0
TEMPO_KEPT = 5


def transient_envelope(
    frames: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    rms: str = "rms",
    detail: str = "detail_rms",
    large: bool | None = None,
) -> DataFrame:
    """Frames (keys, frame_idx, rms, value) with 0.6 energy and 0.4 detail flux, scaled."""
    if large is None:
        large = has_large_group(frames, keys)
    flux = positive_log_flux(frames, rms, keys=keys, name="__energy")
    flux = positive_log_flux(flux, detail, keys=keys, name="__detail")
    scaled = robust_scale(flux, ["__energy", "__detail"], keys=keys, large=large)
    mixed = 0.6 * F.col("__energy") + 0.4 * F.col("__detail")
    return scaled.select(*keys, "frame_idx", F.col(rms).alias("rms"), mixed.alias("value"))


def onset_stats(
    envelope: DataFrame,
    durations: DataFrame,
    frame_rate: float,
    *,
    keys: Sequence[str] = SERIES,
    large: bool | None = None,
) -> DataFrame:
    """Onsets per second, mean transient level and active share per series."""
    gap = max(int(round(frame_rate * 0.12)), 1)
    if large is None:
        large = has_large_group(envelope, keys)
    onsets = peak_pick(envelope, keys=keys, minimum_gap=gap, large=large).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__onsets")
    )
    quiet = exact_quantiles(envelope, keys, "rms", {"__p20": 0.2}, large=large)
    active = (
        envelope.join(quiet, list(keys))
        .groupBy(*keys)
        .agg(
            F.avg("value").alias("transient_activity"),
            F.avg(
                (F.col("rms") > F.greatest(F.col("__p20"), F.lit(1e-7))).cast("double")
            ).alias("active_fraction"),
        )
    )
    return (
        durations.join(active, list(keys))
        .join(onsets, list(keys), "left")
        .select(
            *keys,
            "duration_seconds",
            (
                F.coalesce("__onsets", F.lit(0)) / F.greatest("duration_seconds", F.lit(1.0))
            ).alias("onset_density_per_second"),
            "transient_activity",
            "active_fraction",
        )
    )


def tempo_correlations(
    envelope: DataFrame,
    frame_rate: float,
    *,
    keys: Sequence[str] = SERIES,
    tempo_range: tuple[float, float] = TEMPO_RANGE,
    steps: int = TEMPO_STEPS,
) -> DataFrame:
    """Normalised autocorrelation at every tempo of the grid: (keys, bpm, correlation).

    A chunk of frames, with the longest lag as halo, contributes one partial sum per lag;
    the sums add up over the chunks of a series.
    """
    grid = np.linspace(tempo_range[0], tempo_range[1], steps)
    lag_of = np.maximum(np.rint(frame_rate * 60.0 / grid).astype(int), 1)
    lags = sorted(set(lag_of.tolist()))
    reach = max(lags)
    size = envelope.groupBy(*keys).agg(F.avg("value").alias("__mean"))
    centred = envelope.join(size, list(keys)).select(
        *keys, "frame_idx", (F.col("value") - F.col("__mean")).alias("x")
    )
    near = with_halo(centred, 0, reach)
    group = [*keys, "__chunk"]
    types = dict(near.dtypes)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy()
        own = int((pdf["__home"] == pdf["__chunk"]).sum())
        parts = []
        for lag in lags:
            n = max(min(own, len(x) - lag), 0)
            parts.append((x[:n], x[lag : lag + n]))
        return pd.DataFrame(
            {
                **{k: np.repeat(pdf[k].to_numpy()[:1], len(lags)) for k in keys},
                "lag": lags,
                "dot": [float(left @ right) for left, right in parts],
                "left_sq": [float(left @ left) for left, _ in parts],
                "right_sq": [float(right @ right) for _, right in parts],
            }
        )

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{schema}, lag long, dot double, left_sq double, right_sq double"
    sums = (
        map_sorted_groups(near, group, ["frame_idx"], partial, schema)
        .groupBy(*keys, "lag")
        .agg(*[F.sum(c).alias(c) for c in ("dot", "left_sq", "right_sq")])
    )
    scale = F.sqrt("left_sq") * F.sqrt("right_sq")
    value = F.when(scale > 1e-12, F.col("dot") / scale).otherwise(F.lit(0.0))
    by_lag: dict[int, list[float]] = {}
    for bpm, lag in zip(grid.tolist(), lag_of.tolist(), strict=True):
        by_lag.setdefault(lag, []).append(bpm)
    tempos = F.create_map(
        *[
            part
            for lag, bpms in by_lag.items()
            for part in (F.lit(lag), F.array(*[F.lit(b) for b in bpms]))
        ]
    )
    return sums.select(*keys, "lag", value.alias("correlation")).select(
        *keys, F.explode(tempos[F.col("lag").cast("int")]).alias("bpm"), "correlation"
    )


def tempo_candidates(
    envelope: DataFrame, frame_rate: float, *, keys: Sequence[str] = SERIES
) -> DataFrame:
    """The strongest tempos of each series, at least 4 BPM apart: adds ``rank``."""
    grid = tempo_correlations(envelope, frame_rate, keys=keys)
    scored = grid.withColumn("score", -F.col("correlation"))
    step = (TEMPO_RANGE[1] - TEMPO_RANGE[0]) / (TEMPO_STEPS - 1)
    # tempos lie on a grid: distances are whole numbers of its steps
    numbered = scored.withColumn(
        "__step", F.round((F.col("bpm") - TEMPO_RANGE[0]) / step).cast("long")
    )
    apart = math.ceil(TEMPO_SPACING / step - 1e-9)
    kept = non_overlapping_topk(
        numbered, TEMPO_KEPT, apart, key=keys, score=("score",), start="__step"
    ).drop("__step")
    order = Window.partitionBy(*keys).orderBy("score", "bpm")
    return kept.withColumn("rank", F.row_number().over(order)).drop("score")


def pulse(candidates: DataFrame, *, keys: Sequence[str] = SERIES) -> DataFrame:
    """Leading tempo and how far it stands out from the median of the (at most five) kept."""
    return candidates.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("bpm"))).alias("pulse_bpm"),
        F.greatest(
            F.max(F.when(F.col("rank") == 1, F.col("correlation")))
            - F.percentile("correlation", F.lit(0.5)),
            F.lit(0.0),
        ).alias("pulse_confidence"),
    )


def robust_zscore(
    rows: DataFrame, weights: dict[str, float] | None = None, name: str = "upbeat_score"
) -> DataFrame:
    """Weighted sum of (value - median) / scale over the whole table.

    The scale is 1.4826 MAD, the standard deviation where that vanishes, else 1.
    """
    weights = weights or UPBEAT_WEIGHTS
    large = has_large_group(rows, [])
    values = {c: F.col(c).cast("double") for c in weights}
    middle = medians(rows, values, large=large)
    spread = rows.agg(*[F.stddev_pop(v).alias(c) for c, v in values.items()]).first()
    apart = medians(rows, {c: F.abs(v - middle[c]) for c, v in values.items()}, large=large)
    score = F.lit(0.0)
    for c, weight in weights.items():
        if middle[c] is None:
            return rows.withColumn(name, F.lit(None).cast("double"))
        scale = apart[c] * 1.4826
        if scale < 1e-12:
            scale = spread[c] or 1.0
        score = score + F.lit(weight) * (values[c] - middle[c]) / scale
    return rows.withColumn(name, score)
