"""User code over the sample tables, and the plan that scores and accepts conversions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from reelgate.catalogue.registry import (
    FRAMES_SQL,
    event_frames,
    gap_fill_sql,
    query,
    rounded,
    spike_repair_sql,
    table,
)
from reelgate.catalogue.selection import _CANDS_SQL, _candidates
from reelgate.operators.extension import extract_features, transform_series
from reelgate.operators.sequence import plan_phrases
from reelgate.plans import conversion
from reelgate.session import pinned


@query(
    "extracted_features",
    """SELECT doc_id, length(text) AS n_characters, len(regexp_extract_all(text, '[aeiou]')) AS n_vowels FROM documents""",
)
def extracted_features(spark, d):
    def load():
        vowels = re.compile("[aeiou]")

        def extract(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_characters": pdf["text"].str.len(),
                    "n_vowels": pdf["text"].map(lambda t: len(vowels.findall(t))),
                }
            )

        return extract

    rows = table(spark, d, "documents").select("doc_id", "text")
    return extract_features(rows, load, "doc_id bigint, n_characters bigint, n_vowels bigint")


@query(
    "transformed_series",
    f"""WITH {FRAMES_SQL} SELECT series_id, frame_idx, round(max(value) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS local_peak FROM frames""",
)
def transformed_series(spark, d):
    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        high = pdf["value"].rolling(5, center=True, min_periods=1).max()
        return pdf[["series_id", "frame_idx"]].assign(local_peak=high)

    frames = event_frames(spark, d).select("series_id", "frame_idx", "value")
    out = transform_series(
        frames, peaks, "series_id bigint, frame_idx bigint, local_peak double", before=2, after=2
    )
    return rounded(out)


@query(
    "phrase_targets",
    f"""WITH RECURSIVE {FRAMES_SQL}, {gap_fill_sql("frames", "filled", 6, 700)}, {spike_repair_sql("filled", "clean", 100, 700)},
    n AS (SELECT series_id, count(*) AS n, count(*) / 50 AS d FROM frames GROUP BY 1),
    c AS (SELECT *, CASE WHEN d <= 0.5 THEN 1 ELSE ceil((d - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE)) END AS c0 FROM n),
    w AS (SELECT *, CASE WHEN d <= 0.5 OR (d + (c0 - 1) * 0.1::DOUBLE) / c0 >= 0.3 THEN c0 ELSE greatest(floor((d - 0.1::DOUBLE) / (0.3::DOUBLE - 0.1::DOUBLE)), 1) END AS c FROM c),
    g AS (SELECT *, (d + (c - 1) * 0.1::DOUBLE) / c AS len FROM w),
    p AS (SELECT series_id, n, c, len, unnest(range(0, c::BIGINT)) AS i FROM g WHERE d <= 0.5 OR len BETWEEN 0.3 AND 0.5),
    s AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE round_even(i * ((len - 0.1::DOUBLE) * 50), 0) END AS st FROM p),
    ph AS (SELECT series_id, i AS phrase_idx, st::BIGINT AS start_frame, (CASE WHEN i = c - 1 THEN n ELSE round_even(st + len * 50, 0) END)::BIGINT AS end_frame FROM s)
    SELECT 'x' AS artist_id, ph.series_id, phrase_idx, start_frame, end_frame, round(20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12)), 6) AS target_level_db,
      round(quantile_cont(cl.f0, 0.5) FILTER (cl.f0 > 0), 6) AS target_pitch
    FROM ph LEFT JOIN clean cl ON cl.series_id = ph.series_id AND cl.frame_idx >= start_frame AND cl.frame_idx < end_frame
    LEFT JOIN frames f ON f.series_id = cl.series_id AND f.frame_idx = cl.frame_idx GROUP BY ALL""",
)
def phrase_targets(spark, d):
    frames = pinned(
        event_frames(spark, d).select(
            F.lit("x").alias("artist_id"), "series_id", "frame_idx", "f0", "rms"
        )
    )
    targets, _ = conversion.phrase_targets(frames, minimum_s=0.3, maximum_s=0.5, overlap_s=0.1)
    return rounded(targets)


@query(
    "conversion_decisions",
    f"""WITH {_CANDS_SQL}, b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY passed DESC,
      coalesce(minw, ident, -1) DESC, coalesce(meanw, -1) DESC, coalesce(ident, -1) DESC, drops, ci) = 1)
    SELECT l_orderkey % 50 AS run_id, count(*) FILTER (passed) AS phrase_count, count(*) FILTER (NOT passed) AS failed_phrases FROM b GROUP BY 1""",
)
def conversion_decisions(spark, d):
    candidates = _candidates(spark, d).withColumn("run_id", F.col("l_orderkey") % 50)
    candidates = candidates.withColumnRenamed("l_orderkey", "phrase_index").drop("passed")
    thresholds = candidates.select("run_id").distinct().select(
        "run_id",
        F.lit(0.2).alias("identity_window_threshold"),
        F.lit(0).alias("joined_dropout_count"),
    )
    done = conversion.decide(candidates, thresholds, gross=0.045)
    failed = done.failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("failed_phrases"))
    runs = thresholds.select("run_id")
    return (
        runs.join(done.summary.select("run_id", "phrase_count"), "run_id", "left")
        .join(failed, "run_id", "left")
        .na.fill(0)
    )


@query(
    "unplannable_series",
    """WITH n AS (SELECT user_id AS series_id, least(count(*), 18 + user_id % 30)::DOUBLE AS n FROM events GROUP BY 1), a AS (SELECT *, ceil((n - 9) / 11) AS c0 FROM n WHERE n > 20),
    b AS (SELECT *, CASE WHEN (n + (c0 - 1) * 9) / c0 >= 15 THEN c0 ELSE greatest(floor((n - 9) / 6), 1) END AS c FROM a)
    SELECT series_id, 'phrase bounds cannot be met' AS violation FROM b WHERE NOT (n + (c - 1) * 9) / c BETWEEN 15 AND 20
    UNION ALL SELECT o_custkey, 'phrase bounds cannot be met' FROM orders WHERE o_orderkey % 100 = 0""",
)
def unplannable_series(spark, d):
    """The beginnings of all series, some of a length between one phrase and two, and series without a frame."""
    lengths = table(spark, d, "events").groupBy(F.col("user_id").alias("series_id")).agg(
        F.least(F.count(F.lit(1)), 18 + F.first("user_id") % 30).alias("n_frames")
    )
    empty = table(spark, d, "orders").where("o_orderkey % 100 = 0").select(
        F.col("o_custkey").alias("series_id"), F.lit(0).cast("long").alias("n_frames")
    )
    _, bad = plan_phrases(lengths.unionByName(empty), 15.0, 20.0, 9.0, rate=1)
    return bad
