import random

import pytest
from pyspark.sql import functions as F

from reelgate.functions import scalars
from reelgate.operators import select

REFERENCES = (
    "artist_id string, reference_id string, review_status string, median_f0_hz double, "
    "f0_p05_hz double, f0_p95_hz double, active_rms_dbfs double"
)


def _bank(spark, status="approved"):
    rows = [
        ("x", name, status, f, 0.8 * f, 1.2 * f, level)
        for name, f, level in [("low", 140.0, -30.0), ("mid", 220.0, -24.0), ("high", 325.0, -23.0)]
    ]
    return spark.createDataFrame(rows, REFERENCES)


def _rank(spark, pitch, bank):
    phrase = spark.createDataFrame(
        [("x", "s", 0, pitch, -23.0)],
        "artist_id string, series_id string, phrase_idx int, target_pitch double, target_level_db double",
    )
    ranked = select.rank_references(phrase, bank)
    best = select.rank_references(phrase, bank, best_only=True)
    out = [r.reference_id for r in ranked.orderBy("rank").collect()]
    assert best.first().reference_id == out[0]
    return out


def test_reference_ranking(spark):
    assert _rank(spark, 330.0, _bank(spark)) == ["high", "mid", "low"]
    assert _rank(spark, None, _bank(spark)) == ["high", "low", "mid"]
    assert _rank(spark, 330.0, _bank(spark, "rejected")) == ["high", "low", "mid"]
    only = _bank(spark, "rejected").where("reference_id = 'low'")
    assert _rank(spark, 330.0, only) == ["low"]


def _candidates(spark, rows):
    full = [
        (1, i, passed, sim, window, None, None, 0, 0.0, 0.0, 0.0)
        for i, (sim, window, passed) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "phrase_index int, candidate_index int, passed boolean, identity_similarity double, "
        "minimum_window_identity_similarity double, mean_window_identity_similarity double, "
        "reference_identity_similarity double, sustained_dropout_count int, dropout_fraction double, "
        "spectral_distance_db double, peak_reduction_db double",
    )


@pytest.mark.parametrize(
    ("rows", "best"),
    [
        ([(0.8, None, False), (0.6, None, True), (0.7, None, True)], 2),
        ([(0.9, 0.45, True), (0.8, 0.7, True)], 1),
        ([(0.9, float("nan"), True), (0.2, 0.1, True)], 0),
        ([(0.5, None, False), (0.6, None, False)], 1),
    ],
)
def test_candidate_choice(spark, rows, best):
    row = select.select_candidate(_candidates(spark, rows), ["phrase_index"]).first()
    assert row.candidate_index == best and row.phrase_failed == (not rows[best][2])


def test_candidate_gate_fails_nan_and_infinite(spark):
    base = {"identity_similarity": 0.8, "minimum_window_identity_similarity": 0.7,
            "sustained_dropout_count": 0.0, "raw_peak": 1.0, "f0_median_error_cents": 10.0,
            "f0_gross_error_fraction": 0.01}
    cases = [base, {**base, "identity_similarity": float("nan")},
             {**base, "f0_median_error_cents": float("inf")}, {**base, "raw_peak": 0.0},
             {**base, "minimum_window_identity_similarity": None}]
    df = spark.createDataFrame(
        [(i, *c.values()) for i, c in enumerate(cases)],
        "id int, " + ", ".join(f"{k} double" for k in base),
    )
    out = select.candidate_passes(df, 0.6).orderBy("id").collect()
    assert [r.passed for r in out] == [True, False, False, False, False]


def test_retry_order(spark):
    records = spark.createDataFrame(
        [(0, "soft", 0, 0.5, 0.6, 0, 0.0), (0, "low", 1, 0.7, 0.8, 1, 0.0), (0, "neutral", 2, 0.4, 0.5, 2, 0.1)],
        "phrase int, reference_id string, candidate_index int, minimum_window_identity_similarity double, "
        "mean_window_identity_similarity double, sustained_dropout_count int, f0_gross_error_fraction double",
    )
    fallback = spark.createDataFrame(
        [(0, r, i) for i, r in enumerate(["neutral", "low", "soft", "high"])],
        "phrase int, reference_id string, position int",
    )
    out = select.retry_order(records, fallback, ["phrase"]).orderBy("position").collect()
    assert [r.reference_id for r in out] == ["soft", "low", "neutral", "high"]


def test_retry_budget(spark):
    rows = [("a", i, i in (0, 1)) for i in range(15)]
    rows += [("b", i, i in (2, 8)) for i in range(15)] + [("c", i, i == 3) for i in range(15)]
    df = spark.createDataFrame(rows, "phrase string, candidate_index int, passed boolean")
    out = {r.phrase: (r.attempts, r.enough) for r in select.retry_budget(df, ["phrase"]).collect()}
    assert out == {"a": (5, True), "b": (9, True), "c": (15, False)}


def _greedy(values, k, spacing):
    chosen = []
    for score, start in sorted(values):
        if all(abs(start - s) >= spacing for _, s in chosen) and len(chosen) < k:
            chosen.append((score, start))
    return sorted(chosen)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_spaced_choice_is_the_greedy_one(spark, kind):
    rng = random.Random(3)
    cast = int if kind == "bigint" else float
    rows = {k: [(rng.choice([0.1, 0.2, 0.3, 0.4]), cast(5 * i)) for i in range(60)] for k in "abc"}
    df = spark.createDataFrame(
        [(k, s, t) for k, v in rows.items() for s, t in v], f"song_id string, score double, start_seconds {kind}"
    )
    out = select.non_overlapping_topk(df, 6, 10.0).collect()
    for k, v in rows.items():
        assert sorted((r.score, r.start_seconds) for r in out if r.song_id == k) == _greedy(v, 6, 10.0)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_repeated_starts_do_not_crowd_out_a_far_one(spark, kind):
    cast = int if kind == "bigint" else float
    rows = [("a", 0.1 + i / 100, cast(i % 3)) for i in range(30)] + [("a", 9.0, cast(100))]
    df = spark.createDataFrame(rows, f"song_id string, score double, start_seconds {kind}")
    out = select.non_overlapping_topk(df, 2, 10.0).collect()
    assert sorted(r.start_seconds for r in out) == [0, 100]


def test_split(spark):
    df = spark.createDataFrame(
        [("a", 0.0), ("a", 20.0), ("a", 40.0), ("b", 5.0)], "song_id string, start_seconds double"
    )
    out = {(r.song_id, r.start_seconds): (r.split, r.segment_idx) for r in select.train_validation_split(df).collect()}
    assert out == {("a", 0.0): ("train", 0), ("a", 20.0): ("train", 1), ("a", 40.0): ("validation", 0), ("b", 5.0): ("train", 0)}


def test_roles_fall_back_to_used_songs(spark):
    rows = [("a", 0.0, 100.0, -30.0), ("a", 2.0, 300.0, -10.0), ("b", 0.0, 200.0, -20.0)]
    df = spark.createDataFrame(rows, "song_id string, start_seconds double, median_f0_hz double, active_rms_dbfs double")
    df = df.withColumn("voiced_fraction", F.lit(0.85)).withColumn("one_second_level_range_db", F.lit(0.0))
    out = {r.role: r.song_id for r in select.assign_roles(select.role_scores(df)).collect()}
    assert out == {"neutral": "b", "soft": "a", "strong": "a", "low": "a", "high": "a"}


def test_next_revision_fills_holes(spark):
    wanted = spark.createDataFrame([("low",), ("high",), ("soft",)], "role string")
    existing = spark.createDataFrame([("low",), ("low-v2",), ("low-v4",), ("high",)], "reference_id string")
    out = {r.role: r.reference_id for r in select.next_revision(wanted, existing).collect()}
    assert out == {"low": "low-v3", "high": "high-v2", "soft": "soft"}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.song_id(F.lit("--Ünder  The_Sea!--"), F.lit("abcdef0123456789")).alias("song"),
        scalars.song_id(F.lit("???"), F.lit("abcdef0123456789")).alias("none"),
        scalars.candidate_seed(F.lit(2**63 - 2), F.lit(1), F.lit(2)).cast("string").alias("seed"),
        scalars.candidate_seed(F.lit(2**63 - 2), F.lit(1), F.lit(2), wrap=False).cast("string").alias("plain"),
        scalars.common_codec(F.lit("PCM_S24LE")).alias("codec"),
        scalars.common_codec(F.lit("flac")).alias("other"),
        scalars.safe_relative_path(F.lit("a/..b/c")).alias("safe"),
        scalars.safe_relative_path(F.lit("C:\\x")).alias("drive"),
        scalars.balance_correction(F.lit(20.0), 1.5)["vocal_adjustment_db"].alias("cut"),
        scalars.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 3).alias("fit"),
    ).first()
    assert row.song == "song-nder-the-sea-abcdef01" and row.none == "song-recording-abcdef01"
    assert row.seed == str((2**63 - 2 + 1009 + 2) % (2**63 - 1)) and row.plain == str(2**63 - 2 + 1011)
    assert (row.codec, row.other) == ("PCM_24", "flac")
    assert row.safe and not row.drive and row.cut == -12.0 and row.fit == [1.0, 2.0, 0.0]
