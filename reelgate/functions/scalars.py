"""Column expressions for ids, decibels, cents, seeds, paths and captions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The smallest amplitude that is converted to decibels, the seed stride
# between phrases, the seed modulus, and the markers of live recordings (the wider list
# also serves song ids, the narrower one catalog titles).
AMPLITUDE_FLOOR = 1e-12
SEED_STRIDE = 1009
SEED_MODULUS = 2**63 - 1
POLICY_MARKERS = ("live", "concert", "shabahangi", "shabahang")
TITLE_MARKERS = ("live", "concert", "shabahangi")

# The codec names that are reported under one common name.
CODEC_ALIASES = {
    "pcm_s16le": "PCM_16",
    "pcm_s24le": "PCM_24",
    "pcm_s32le": "PCM_32",
    "pcm_f32le": "FLOAT",
    "pcm_f64le": "DOUBLE",
}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def amplitude_db(value: Column | str) -> Column:
    return 20 * F.log10(F.greatest(_col(value), F.lit(AMPLITUDE_FLOOR)))


def cents(a: Column | str, b: Column | str) -> Column:
    """1200 * log2(a / b); null unless both are positive."""
    a, b = _col(a), _col(b)
    return F.when((a > 0) & (b > 0), 1200 * F.log2(a / b))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def finite(value: Column | str) -> Column:
    """False for null, NaN and the infinities."""
    value = _col(value)
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False)
    )


def fold_case(value: Column | str) -> Column:
    """Case-insensitive form; unlike a full case fold it leaves a sharp s alone."""
    return F.lower(_col(value))


def slug(value: Column | str, length: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    named = F.when(bare == "", F.lit("recording")).otherwise(bare)
    return F.regexp_replace(F.substring(named, 1, length), "-+$", "")


def song_id(stem: Column | str, sha256: Column | str) -> Column:
    return F.concat(F.lit("song-"), slug(stem), F.lit("-"), F.substring(_col(sha256), 1, 8))


def candidate_seed(
    base: Column | str, phrase: Column | str, candidate: Column | str, wrap: bool = True
) -> Column:
    """Seed of one candidate; in decimal, as bases reach the end of 64 bits."""
    seed = (
        _col(base).cast("decimal(38,0)")
        + _col(phrase).cast("decimal(20,0)") * SEED_STRIDE
        + _col(candidate).cast("decimal(20,0)")
    )
    if not wrap:
        return seed.cast("decimal(38,0)")
    return (seed % F.lit(SEED_MODULUS).cast("decimal(38,0)")).cast("decimal(38,0)")


def utc_id(prefix: str, instant: Column | str, suffix: Column | str) -> Column:
    stamp = F.date_format(_col(instant), "yyyyMMdd't'HHmmss'z'")
    return F.concat(F.lit(f"{prefix}-"), stamp, F.lit("-"), _col(suffix))


def parse_utc_id(value: Column | str, prefix: str = "run") -> Column:
    """The instant inside an id, null when the id is malformed."""
    value = _col(value)
    stamp = F.regexp_extract(value, rf"^{prefix}-([0-9]{{8}}t[0-9]{{6}})z-[a-f0-9]{{8}}$", 1)
    return F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyyMMdd't'HHmmss")))


def fit_length(values: Column | str, length: Column | int) -> Column:
    """Cut or zero-pad an array to an exact length."""
    length = F.lit(length) if isinstance(length, int) else length
    padded = F.concat(_col(values), F.array_repeat(F.lit(0.0), length))
    return F.slice(padded, 1, length)


def set_channels(values: Column | str, channels: int) -> Column:
    """Frame-level channel conversion of an array with one value per channel."""
    values = _col(values)
    if channels == 1:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return F.array(total / F.size(values))
    return F.when(F.size(values) == 1, F.array_repeat(values[0], 2)).otherwise(
        F.slice(values, 1, 2)
    )


def caption(tag: Column | str, text: Column | str) -> Column:
    return F.concat(F.trim(_col(tag)), F.lit(", "), F.trim(_col(text)), F.lit("\n"))


def clean_lyrics(text: Column | str) -> Column:
    stripped = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    return F.concat(stripped, F.lit("\n"))


def has_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether the case-folded text contains any marker, also inside a word."""
    folded = fold_case(text)
    found = F.lit(False)
    for marker in markers:
        found = found | F.coalesce(F.contains(folded, F.lit(marker)), F.lit(False))
    return found


def recording_kind(
    title: Column | str, filename: Column | str, markers: Sequence[str] = TITLE_MARKERS
) -> Column:
    label = F.concat_ws(" ", _col(title), _col(filename))
    return F.when(has_marker(label, markers), F.lit("live")).otherwise(F.lit("studio"))


def peak_protect(peak: Column | str, ceiling: float = 10 ** (-1 / 20)) -> Column:
    """Decibels to take off so that the peak meets the ceiling."""
    over = amplitude_db(peak) - F.lit(20 * math.log10(ceiling))
    return F.greatest(F.lit(0.0), over)


def balance_correction(
    balance: Column | str, target: float, limit: float = 12.0, dead_zone: float = 0.01
) -> Column:
    """struct(correction, vocal_adjustment, instrumental_adjustment) in decibels."""
    wanted = clip(F.lit(float(target)) - _col(balance), -limit, limit)
    return F.struct(
        wanted.alias("correction_db"),
        F.when(wanted < -dead_zone, wanted).otherwise(F.lit(0.0)).alias("vocal_adjustment_db"),
        F.when(wanted > dead_zone, -wanted)
        .otherwise(F.lit(0.0))
        .alias("instrumental_adjustment_db"),
    )


def aware_instant(text: Column | str) -> Column:
    """Parse an ISO instant; null when it carries no offset or does not parse."""
    text = _col(text)
    offset = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.when(offset, F.try_to_timestamp(text))


def common_codec(codec: Column | str) -> Column:
    codec = _col(codec)
    named = codec
    for alias, name in CODEC_ALIASES.items():
        named = F.when(F.lower(codec) == alias, F.lit(name)).otherwise(named)
    return named


def safe_relative_path(path: Column | str) -> Column:
    """Lexical check: a non-empty relative path that does not leave its root."""
    path = _col(path)
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:)")
    climbs = path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return F.coalesce((path != "") & ~absolute & ~climbs, F.lit(False))
