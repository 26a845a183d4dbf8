import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from synth import clean_by_walking, contour_rows

from reelgate.operators import frames, sequence


def _values(df, column="f0"):
    out = {}
    for row in df.orderBy("series_id", "frame_idx").collect():
        out.setdefault(row["series_id"], []).append(row[column])
    return out


def test_short_gap_and_octave_spike(spark):
    df = contour_rows(spark, {"a": [200, 200, 0, 0, 202, 404, 202], "b": [200, 200, 0, 0, 0, 200]})
    out = _values(sequence.clean_contour(df, 2))
    assert all(200 <= v <= 202 for v in out["a"][2:4])
    assert out["a"][5] == pytest.approx(202, abs=1)
    assert out["b"][2:5] == [0, 0, 0]


def test_repair_depends_on_order(spark):
    out = _values(sequence.spike_repair(contour_rows(spark, {"a": [200, 404, 202, 404]})))
    assert out["a"] == pytest.approx([200, math.sqrt(200 * 202), 202, 404])


@pytest.mark.parametrize("size", [16, 65536])
def test_cleaning_equals_the_walk(spark, size):
    spark.conf.set("reelgate.chunkFrames", str(size))
    rng = np.random.default_rng(7)
    series = {}
    for k in range(6):
        f = 200 * 2 ** rng.choice([0, 0.01, 1, 1.005, -1], size=150, p=[0.4, 0.3, 0.15, 0.1, 0.05])
        f[rng.random(150) < 0.15] = 0
        series[f"s{k}"] = f.tolist()
    # runs of alternating octaves that are longer than a chunk
    series["long"] = [200.0 if i % 2 else 400.0 for i in range(70)]
    out = _values(sequence.clean_contour(contour_rows(spark, series), 2))
    spark.conf.unset("reelgate.chunkFrames")
    for name, values in series.items():
        assert out[name] == pytest.approx(clean_by_walking(values, 2).tolist(), rel=1e-9)


def test_planner(spark):
    lengths = spark.createDataFrame([("a", 2400), ("b", 500), ("c", 0)], "series_id string, n_frames bigint")
    phrases, bad = sequence.plan_phrases(lengths)
    rows = phrases.where("series_id = 'a'").orderBy("phrase_idx").collect()
    assert [(r.start_frame, r.end_frame) for r in rows] == [(0, 833), (783, 1616), (1567, 2400)]
    assert phrases.where("series_id = 'b'").count() == 1
    assert [r.series_id for r in bad.collect()] == ["c"]
    with pytest.raises(ValueError):
        sequence.plan_phrases(lengths, 12, 20, 13)


def test_scattered_voicing_is_rejected(spark):
    rows = [("a", i, 200.0 if i % 10 == 0 else 0.0, 0.1) for i in range(100)]
    df = spark.createDataFrame(rows, "series_id string, frame_idx bigint, f0 double, rms double")
    assert frames.series_metrics(df).first().rejected == "no sustained voiced second"


def _dropout(spark, last):
    rows = []
    for i in range(50):
        quiet = [0.001 if 400 <= s < last else 0.1 for s in range(i * 20, i * 20 + 20)]
        sum_sq = sum(q * q for q in quiet)
        rows.append(("a", i, 200.0, math.sqrt(sum_sq / 20), sum_sq, 20))
    return spark.createDataFrame(
        rows, "series_id string, frame_idx bigint, f0 double, rms double, sum_sq double, n bigint"
    )


@pytest.mark.parametrize(("last", "kind"), [(520, "repairable"), (540, "failing")])
def test_dropout_classes(spark, last, kind):
    flagged = sequence.with_dropouts(_dropout(spark, last))
    assert sequence.sustained_runs(flagged).first().sustained_runs == 1
    (run,) = sequence.classify_runs(flagged).collect()
    assert run["class"] == kind


def test_stitching(spark):
    pieces = spark.createDataFrame(
        [("a", 0, 0, 8, [1.0] * 8), ("a", 1, 6, 14, [0.5] * 8)],
        "series_id string, piece_idx int, start bigint, end bigint, values array<double>",
    )
    lengths = spark.createDataFrame([("a", 14)], "series_id string, total bigint")
    joined, gains, bad = sequence.overlap_stitch(pieces, lengths)
    assert bad.count() == 0
    gain = {r.piece_idx: r.join_gain_db for r in gains.collect()}
    assert gain[0] == 0 and gain[1] == pytest.approx(6.0)
    out = [r.value for r in joined.orderBy("idx").collect()]
    phase = np.linspace(0, np.pi / 2, 2)
    g = 0.5 * 10 ** (6 / 20)
    assert out[6:8] == pytest.approx((np.cos(phase) + g * np.sin(phase)).tolist())
    assert out[:6] == pytest.approx([1.0] * 6) and out[8:] == pytest.approx([g] * 6)


def test_stitching_gap(spark):
    pieces = spark.createDataFrame(
        [("a", 0, 0, 4, [1.0] * 4), ("a", 1, 5, 8, [1.0] * 3)],
        "series_id string, piece_idx int, start bigint, end bigint, values array<double>",
    )
    lengths = spark.createDataFrame([("a", 8)], "series_id string, total bigint")
    _, _, bad = sequence.overlap_stitch(pieces, lengths)
    assert [r.violation for r in bad.collect()] == ["gap"]
    _, _, none = sequence.overlap_stitch(pieces, lengths, zero_fill=True)
    assert none.count() == 0


def test_join_jump_counts_only_voiced_joins(spark):
    voiced = contour_rows(spark, {"a": [200.0, 200.0], "b": [200.0, 0.0]})
    joins = spark.createDataFrame(
        [("a", 1, 0.5, 0.01), ("b", 1, 0.5, 0.01)],
        "series_id string, frame_idx bigint, before_rms double, after_rms double",
    )
    out = {r.series_id: r.max_join_jump_db for r in sequence.join_jump(joins, voiced).collect()}
    assert out["a"] > 6 and out["b"] == 0


def test_peak_picking_lets_a_higher_peak_replace(spark):
    heights = [0, 1.0, 0, 2.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3.0, 0, 0]
    df = contour_rows(spark, {"a": heights}).withColumnRenamed("f0", "value")
    out = sequence.peak_pick(df, minimum_gap=10).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.value) for r in out] == [(3, 2.0), (13, 3.0)]


def test_level_match_gain(spark):
    rows = [("a", i, 220.0, 0.08 / math.sqrt(2), 0.32 / math.sqrt(2)) for i in range(200)]
    df = spark.createDataFrame(
        rows, "series_id string, frame_idx bigint, f0 double, guide_rms double, other_rms double"
    )
    gains, residual = frames.level_match(df)
    assert gains.first().global_gain_db == pytest.approx(-12.04, abs=0.1)
    assert residual.agg(F.max(F.abs("residual_db"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_smoothing_equals_convolution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=90)
    df = contour_rows(spark, {"a": x.tolist()}).withColumnRenamed("f0", "value")
    spark.conf.set("reelgate.chunkFrames", "32")
    out = _values(sequence.smooth_gain(df, "value", F.lit(True)), "smoothed")["a"]
    spark.conf.unset("reelgate.chunkFrames")
    kernel = np.hanning(21) / np.hanning(21).sum()
    assert out == pytest.approx(np.convolve(x, kernel, mode="same").tolist())


@pytest.mark.parametrize("channels, expected", [(1, 60.0), (2, 120.0)])
def test_mono_windows_count_as_centred(spark, channels, expected):
    from reelgate.operators.frames import window_metrics

    rows = [("a", i, 200.0, 0.1, 1.0, 0.0, channels) for i in range(100)]
    frames = spark.createDataFrame(
        rows,
        "series_id string, frame_idx bigint, f0 double, rms double, mid_sq double, side_sq double, channels int",
    )
    out = window_metrics(frames, 100, 50).select("centre_dominance_db").collect()
    assert [r[0] for r in out] == [expected]


def test_gain_steps_compose():
    draw = random.Random(1)
    for _ in range(400):
        steps = []
        for _ in range(draw.randrange(1, 30)):
            kind = draw.random()
            shift = None if kind < 0.1 else draw.uniform(-9, 9)
            # mostly far below any gain, at times among them
            steps.append((shift, draw.uniform(-7, 7) if kind > 0.8 else -100.0))
        whole = sequence.GainMap()
        for step in steps:
            whole = whole.then(*step)
        for gain in [0.0, *(draw.uniform(-6, 6) for _ in range(20))]:
            walked = gain
            for shift, above in steps:
                walked = min(6.0, max(-6.0, walked + shift)) if shift is not None and walked > above else 0.0
            assert whole(gain) == pytest.approx(walked, abs=1e-9)


@pytest.mark.parametrize("size", ["65536", "3"])
def test_gains_of_a_long_series(spark, size):
    draw = random.Random(2)
    spark.conf.set("reelgate.chunkFrames", size)
    try:
        levels = [draw.choice([0.0, 1e-9, 0.8e-8, 1.3e-8, 0.01, 0.1, 0.5, 1.0]) for _ in range(60)]
        rows = [("a", i, 8 * i, 8 * i + (10 if i < 59 else 1), [levels[i]] * 8 + [levels[i] / 2] * 2) for i in range(60)]
        schema = "series_id string, piece_idx int, start long, end long, values array<double>"
        joined, gains, bad = sequence.overlap_stitch(
            spark.createDataFrame(rows, schema), spark.createDataFrame([("a", 8 * 59 + 1)], "series_id string, total long")
        )
        got = {r.piece_idx: r.join_gain_db for r in gains.collect()}
        count = joined.count()
    finally:
        spark.conf.unset("reelgate.chunkFrames")
    before, want = 0.0, {}
    for i, level in enumerate(levels):
        gain = 0.0
        if i and before > 1e-8 and level > 1e-8:
            gain = min(6.0, max(-6.0, 20 * math.log10(before / level)))
        want[i], before = gain, level / 2 * 10 ** (gain / 20)
    assert got == pytest.approx(want, abs=1e-9) and count == 8 * 59 + 1 and bad.count() == 0
