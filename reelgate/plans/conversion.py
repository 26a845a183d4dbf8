"""From scored candidates to an accepted recording: plan, rank, gate, select, check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles
from reelgate.functions.scalars import amplitude_db
from reelgate.operators import qc, select
from reelgate.operators.frames import series_lengths
from reelgate.operators.sequence import clean_contour, coverage_check, plan_phrases


@dataclass(frozen=True)
class Conversion:
    decisions: DataFrame
    failures: DataFrame
    summary: DataFrame


def phrase_targets(
    frames: DataFrame, *, minimum_s: float = 12.0, maximum_s: float = 20.0, overlap_s: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Phrases of every series with their register and level, and the unplannable series.

    ``frames``: artist_id, series_id, frame_idx, f0, rms. Contours are cleaned first; a frame
    joins the (at most two) phrases that contain it through the phrase starts, not through
    a range join.
    """
    keys = ["artist_id", "series_id"]
    cleaned = clean_contour(frames, keys=keys)
    phrases, bad = plan_phrases(series_lengths(cleaned, keys), minimum_s, maximum_s, overlap_s, keys=keys)
    seconds = F.explode(
        F.sequence(F.expr("start_frame div 50"), F.expr("(end_frame - 1) div 50"))
    )
    spans = phrases.withColumn("__second", seconds)
    inside = (
        cleaned.withColumn("__second", F.expr("frame_idx div 50"))
        .join(spans, [*keys, "__second"])
        .where((F.col("frame_idx") >= F.col("start_frame")) & (F.col("frame_idx") < F.col("end_frame")))
    )
    group = [*keys, "phrase_idx"]
    level = inside.groupBy(*group).agg(
        amplitude_db(F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("target_level_db")
    )
    # a phrase is bounded by its longest duration, so its median needs no check for size
    pitch = exact_quantiles(
        inside.where("f0 > 0"), group, "f0", {"target_pitch": 0.5}, large=False
    )
    return phrases.join(level, group, "left").join(pitch, group, "left"), bad


def decide(candidates: DataFrame, thresholds: DataFrame, **limits: float) -> Conversion:
    """Gate and select the candidates of every phrase.

    ``candidates``: run_id, phrase_index, candidate_index and measurements; ``thresholds``:
    run_id, identity_window_threshold, joined_dropout_count. ``limits`` override those of the
    candidate gate.
    """
    keys = ["run_id", "phrase_index"]
    gated = select.candidate_passes(
        candidates.join(thresholds, "run_id"), F.col("identity_window_threshold"), **limits
    )
    chosen = select.select_candidate(gated, keys)
    failures = chosen.where("phrase_failed").select(*keys, "candidate_index", "identity_similarity")
    decisions = chosen.where(~F.col("phrase_failed"))
    return Conversion(decisions, failures, qc.conversion_summary(decisions))


def accept(
    summary: DataFrame, measurements: DataFrame, phrases: DataFrame, failures: DataFrame
) -> DataFrame:
    """The acceptance report of each run; a run with a failed phrase is never accepted."""
    duration = measurements.select("run_id", F.col("expected_seconds").alias("duration_seconds"))
    covered = coverage_check(phrases, duration, keys=["run_id"])
    failed = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("failed_phrases"))
    joined = (
        measurements.join(summary, "run_id", "left")
        .join(covered, "run_id", "left")
        .join(failed, "run_id", "left")
        .na.fill(0, ["failed_phrases"])
    )
    checked = qc.acceptance_checks(joined)
    return checked.withColumn("accepted", F.col("accepted") & (F.col("failed_phrases") == 0))
