"""Seeded tones, recordings and contours for tests."""

from __future__ import annotations

import wave

import numpy as np


def tone(hertz: float, amplitude: float, seconds: float, rate: int) -> np.ndarray:
    return amplitude * np.sin(2 * np.pi * hertz * np.arange(round(seconds * rate)) / rate)


def write_wav(path, samples: np.ndarray, rate: int, width: int = 2) -> str:
    """Samples in [-1, 1), one column per channel, as 16 or 24 bit PCM."""
    values = np.atleast_2d(samples.T).T if samples.ndim == 1 else samples
    path.parent.mkdir(parents=True, exist_ok=True)
    scale = 2 ** (8 * width - 1)
    whole = np.clip(np.rint(values * scale), -scale, scale - 1).astype("<i4")
    raw = whole.reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    with wave.open(str(path), "wb") as out:
        out.setnchannels(values.shape[1])
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(raw)
    return str(path)


def contour_rows(spark, series: dict[str, list[float]]):
    rows = [(k, i, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, frame_idx bigint, f0 double")


def clean_by_walking(values, maximum_gap: int) -> np.ndarray:
    """Gap filling, then spike repair frame by frame: the sequential meaning of both."""
    f = np.asarray(values, dtype=np.float64).copy()
    f[~np.isfinite(f) | (f < 0)] = 0
    voiced = np.flatnonzero(f > 0)
    for a, b in zip(voiced[:-1], voiced[1:]):
        if 1 < b - a <= maximum_gap + 1 and abs(1200 * np.log2(f[b] / f[a])) <= 700:
            for k in range(1, b - a):
                f[a + k] = f[a] * (f[b] / f[a]) ** (k / (b - a))
    for i in range(1, len(f) - 1):
        p, c, n = f[i - 1], f[i], f[i + 1]
        if min(p, c, n) > 0 and abs(1200 * np.log2(n / p)) <= 100:
            if min(abs(1200 * np.log2(c / p)), abs(1200 * np.log2(c / n))) >= 700:
                f[i] = np.sqrt(p * n)
    return f
