import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgate.operators import identity
from reelgate.operators.extension import extract_features, transform_series
from reelgate.plans import conversion
from reelgate.schemas import CANDIDATES, RUN_EVENTS, struct_of

CLEAN = {
    "raw_peak": 0.9, "sustained_dropout_count": 0, "dropout_fraction": 0.0,
    "spectral_distance_db": 1.0, "peak_reduction_db": 0.0, "identity_similarity": 0.8,
    "reference_identity_similarity": 0.8, "mean_window_identity_similarity": 0.7,
    "f0_median_error_cents": 10.0, "f0_gross_error_fraction": 0.01,
}


def _candidate(run, phrase, index, window, **changes):
    return {"run_id": run, "phrase_index": phrase, "candidate_index": index,
            "minimum_window_identity_similarity": window, **CLEAN, **changes}


def test_decisions_and_acceptance(spark):
    rows = [
        _candidate("good", 0, 0, 0.5), _candidate("good", 0, 1, 0.6),
        _candidate("good", 1, 0, 0.9, sustained_dropout_count=1), _candidate("good", 1, 1, 0.5),
        _candidate("bad", 0, 0, 0.9), _candidate("bad", 1, 0, 0.1),
    ]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        ", ".join(f"{k} {'string' if k == 'run_id' else 'int' if 'index' in k else 'bigint' if 'count' in k else 'double'}" for k in rows[0]),
    )
    thresholds = spark.createDataFrame(
        [("good", 0.4, 0), ("bad", 0.4, 0)],
        "run_id string, identity_window_threshold double, joined_dropout_count bigint",
    )
    done = conversion.decide(df, thresholds)
    chosen = {(r.run_id, r.phrase_index): r.candidate_index for r in done.decisions.collect()}
    assert chosen == {("good", 0): 1, ("good", 1): 1, ("bad", 0): 0}
    assert [(r.run_id, r.phrase_index) for r in done.failures.collect()] == [("bad", 1)]
    measured = spark.createDataFrame(
        [(r, 30.0, 30.0, 48000, 2, "PCM_24", -14.0, -1.5, 1.0, 0.0, 1.0, 10.0, 0.01, 0.4, None) for r in ("good", "bad")],
        "run_id string, duration_seconds double, expected_seconds double, sample_rate int, channels int, codec string, "
        "integrated_lufs double, true_peak_dbfs double, vocal_to_instrumental_db double, clipping_fraction double, "
        "max_voiced_join_jump_db double, f0_median_error_cents double, f0_gross_error_fraction double, "
        "identity_window_threshold double, identity_threshold double",
    )
    phrases = spark.createDataFrame(
        [(r, i, s, e) for r in ("good", "bad") for i, (s, e) in enumerate([(0.0, 16.0), (15.0, 30.0)])],
        "run_id string, phrase_idx int, start_seconds double, end_seconds double",
    )
    out = {r.run_id: r for r in conversion.accept(done.summary, measured, phrases, done.failures).collect()}
    assert out["good"].accepted and out["good"].phrase_count == 2
    assert not out["bad"].accepted and out["bad"].failed_phrases == 1


@pytest.mark.parametrize("chunk", ["65536", "100"])
def test_phrase_targets(spark, chunk):
    spark.conf.set("reelgate.chunkFrames", chunk)
    rows = [("x", "s", i, 220.0 if i < 1200 else 330.0, 0.1) for i in range(2400)]
    frames = spark.createDataFrame(rows, "artist_id string, series_id string, frame_idx bigint, f0 double, rms double")
    targets, bad = conversion.phrase_targets(frames)
    out = [(r.start_frame, r.target_pitch, round(r.target_level_db, 6)) for r in targets.orderBy("phrase_idx").collect()]
    spark.conf.unset("reelgate.chunkFrames")
    assert out == [(0, 220.0, -20.0), (783, 220.0, -20.0), (1567, 330.0, -20.0)]
    assert bad.count() == 0


def test_identity_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(7, 5))
    labels = ["a"] * 6 + ["b"]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(labels, vectors)], "label string, embedding array<double>")
    out = {tuple(r.embedding): r.similarity for r in identity.leave_one_out_similarity(df, ["label"]).collect()}
    for i in range(6):
        others = np.delete(vectors[:6], i, axis=0).mean(axis=0)
        assert out[tuple(vectors[i])] == pytest.approx(vectors[i] @ (others / np.linalg.norm(others)))
    assert out[tuple(vectors[6])] == 1.0
    scores = spark.createDataFrame([("a", 0.5), ("a", 0.9)], "label string, similarity double")
    low = identity.adaptive_threshold(scores, ["label"], margin=0.08, floor=0.45).first().threshold
    high = identity.adaptive_threshold(scores, ["label"], margin=0.04, floor=0.2, window=True).first().threshold
    assert (low, high) == (0.45, pytest.approx(0.54))


def test_extractor_must_keep_the_count(spark):
    df = spark.range(10)
    ok = extract_features(df, lambda: lambda pdf: pdf * 2, "id bigint")
    assert ok.agg(F.sum("id")).first()[0] == 90
    with pytest.raises(Exception, match="results for"):
        extract_features(df, lambda: lambda pdf: pdf.head(0), "id bigint").count()


def test_series_transform_sees_its_halo(spark):
    spark.conf.set("reelgate.chunkFrames", "8")
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(50)], "series_id string, frame_idx bigint, x double")
    out = transform_series(
        df, lambda p: p[["series_id", "frame_idx"]].assign(d=p["x"].diff().fillna(0.0)),
        "series_id string, frame_idx bigint, d double", before=1,
    )
    rows = [r.d for r in out.orderBy("frame_idx").collect()]
    spark.conf.unset("reelgate.chunkFrames")
    assert rows == [0.0] + [float(2 * i + 1) for i in range(49)]


def test_schemas_parse(spark):
    assert struct_of(CANDIDATES)["seed"].dataType.simpleString() == "decimal(38,0)"
    assert struct_of(RUN_EVENTS).fieldNames()[0] == "run_id"
