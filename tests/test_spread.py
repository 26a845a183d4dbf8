"""Work behind small rows is spread over the cluster, and dear windows are measured once."""

import pytest
from pyspark.sql import functions as F

from reelgate.operators.scan import map_sorted_groups
from reelgate.plans import curation
from reelgate.sources import media


def _files(spark):
    return spark.range(200).select(
        F.col("id").alias("series_id"), F.format_string("/nowhere/%d.wav", "id").alias("path"),
        F.lit(8000).alias("sample_rate"), F.lit(100).cast("long").alias("n_samples"), F.lit(4).cast("long").alias("n_frames"),
        F.lit(9).cast("long").alias("join_sample"),
    ).distinct()


@pytest.mark.parametrize(
    "work",
    [
        media.hash_files,
        media.probe_media,
        media.frame_energy,
        media.join_levels,
        lambda files: map_sorted_groups(files.select("series_id"), ["series_id"], [], lambda pdf: pdf, "series_id long"),
    ],
)
def test_small_rows_are_not_merged_into_few_tasks(spark, work):
    # counted before the work runs, as the files do not exist
    assert work(_files(spark)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_windows_are_stored_before_their_rules(spark, monkeypatch):
    stored = []

    def kept(df):
        stored.append(df.columns)
        return df

    monkeypatch.setattr(curation, "pinned", kept)
    frames = spark.range(1500).select(
        F.lit("a").alias("song_id"), F.col("id").alias("frame_idx"), F.lit(200.0).alias("f0"), F.lit(0.1).alias("rms"),
        F.lit(0.2).alias("peak"), F.lit(0).cast("long").alias("clipped_n"), F.lit(1).cast("long").alias("n"),
        F.lit(0.0).alias("mid_sq"), F.lit(0.0).alias("side_sq"), F.lit(1).alias("channels"),
    )
    nothing = spark.createDataFrame([], "song_id string, start_s double, end_s double")
    curation.bank_candidates(frames, curation.Policy(nothing, nothing, nothing))
    assert "rejected" in stored[0] and "failed_rules" not in stored[0]
