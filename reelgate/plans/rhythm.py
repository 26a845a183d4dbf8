"""From frame levels to songs ranked by tempo and rhythmic energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from reelgate.operators.scan import has_large_group
from reelgate.operators.sequence import SERIES
from reelgate.operators.tempo import (
    onset_stats,
    pulse,
    robust_zscore,
    tempo_candidates,
    transient_envelope,
)
from reelgate.session import pinned


def analyse_rhythm(
    frames: DataFrame,
    durations: DataFrame,
    frame_rate: float,
    *,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One row per song: tempo, confidence, onsets, activity and ``upbeat_score``.

    ``frames``: keys, frame_idx, rms, detail_rms; ``durations``: keys, duration_seconds. The
    envelope is stored, as onsets and tempo read it several times, and so are the songs.
    """
    large = has_large_group(frames, keys)
    envelope = pinned(transient_envelope(frames, keys=keys, large=large))
    stats = onset_stats(envelope, durations, frame_rate, keys=keys, large=large)
    beats = pulse(tempo_candidates(envelope, frame_rate, keys=keys), keys=keys)
    return robust_zscore(pinned(stats.join(beats, list(keys))))
