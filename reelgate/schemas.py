"""Explicit table schemas, as DDL text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def struct_of(ddl: str) -> T.StructType:
    """Parse a schema (needs a running session)."""
    return T.StructType.fromDDL(ddl)


AUDIO = (
    "struct<duration_seconds: double, sample_rate: int, channels: int, codec: string, "
    "format_name: string>"
)
METRICS = (
    "struct<duration_seconds: double, voiced_fraction: double, median_f0_hz: double, "
    "f0_p05_hz: double, f0_p95_hz: double, active_rms_dbfs: double, "
    "one_second_level_range_db: double, peak_dbfs: double, clipping_fraction: double, "
    "high_band_ratio_db: double>"
)

CATALOG = (
    "artist_id string, song_id string, title string, source_filename string, "
    "source_sha256 string, original_path string, original_sha256 string, "
    f"audio {AUDIO}, imported_at timestamp, normalized_path string, normalized_sha256 string"
)
STEMS = (
    "schema_version int, artist_id string, song_id string, source_sha256 string, "
    "normalized_sha256 string, recording_kind string, created_at string, "
    "vocals struct<path: string, sha256: string, duration_seconds: double>, "
    "accompaniment struct<path: string, sha256: string, duration_seconds: double>, "
    "clean_vocals struct<path: string, sha256: string, source_vocals_sha256: string, "
    "duration_seconds: double, sample_rate: int, channels: int>, "
    "f0 struct<path: string, sha256: string>, "
    "vocal_cleaning struct<model_sha256: string, config_sha256: string, "
    "dereverb_strength: double>"
)
RIGHTS = (
    "artist_id string, status string, effective_at timestamp, expires_at timestamp, "
    "permissions struct<training: boolean, music_style: boolean, singing_voice: boolean, "
    "commercial_release: boolean>, "
    "approvals array<struct<holder: string, scope: string, evidence_reference: string, "
    "approved_at: timestamp>>, "
    "source_assets array<struct<sha256: string, evidence_reference: string>>, "
    "release struct<require_human_approval: boolean, require_ai_assisted_disclosure: boolean, "
    "allow_automatic_distribution: boolean>, notes string"
)
POLICY = (
    "schema_version int, artist_id string, reject_live_voice_recordings boolean, "
    "source_exclusions array<struct<sha256: string, filename: string, reason: string, "
    "excluded_at: timestamp>>, "
    "music_songs array<struct<song_id: string, exclude_from_training: boolean, reason: string, "
    "excluded_at: timestamp>>, "
    "voice_songs array<struct<song_id: string, exclude_entire_song: boolean, reason: string, "
    "excluded_intervals: array<struct<start_seconds: double, end_seconds: double, "
    "reason: string>>>>"
)
ARTISTS = "artist_id string, display_name string"
FRAMES = (
    "series_id string, frame_idx bigint, f0 double, rms double, n bigint, sum_sq double, "
    "peak double, clipped_n bigint, mid_sq double, side_sq double"
)
REFERENCES = (
    "artist_id string, reference_id string, review_status string, tags array<string>, "
    "source_song_id string, source_stem_sha256 string, parent_source_sha256 string, "
    f"source_sha256 string, audio_sha256 string, f0_sha256 string, metrics {METRICS}"
)
CANDIDATES = (
    "run_id string, phrase_index int, candidate_index int, reference_id string, "
    "seed decimal(38,0), passed boolean, raw_peak double, raw_peak_dbfs double, "
    "peak_reduction_db double, sustained_dropout_count bigint, dropout_fraction double, "
    "spectral_distance_db double, identity_similarity double, "
    "reference_identity_similarity double, minimum_window_identity_similarity double, "
    "mean_window_identity_similarity double, f0_median_error_cents double, "
    "f0_gross_error_fraction double"
)
RUN_EVENTS = (
    "run_id string, sequence bigint, stage string, occurred_at timestamp, message string, "
    "artifacts map<string,string>, hashes map<string,string>"
)
