from datetime import datetime

from pyspark.sql import functions as F

from reelgate.operators import gates, sequence
from reelgate.schemas import CATALOG, METRICS, struct_of
from reelgate.sources import sinks

A = "a" * 64


def _failures(df, rules):
    return [r.violations for r in gates.validate_rows(df, rules).collect()]


def test_metric_ranges(spark):
    fine = (15.0, 0.8, 220.0, 180.0, 260.0, -20.0, 3.0, -1.0, 0.0, -30.0)
    odd = (0.0, 1.2, 0.0, None, 260.0, 1.0, -1.0, 2.0, float("nan"), 61.0)
    schema = METRICS.removeprefix("struct<").removesuffix(">")
    out = _failures(spark.createDataFrame([fine, odd], schema), gates.metric_range_rules())
    assert out[0] == []
    assert set(out[1]) == set(gates.METRIC_RANGES) - {"f0_p95_hz"}


def test_catalog_and_split(spark):
    row = ("x", "song-a", "A", "a.wav", A, "p", A, (1.0, 48000, 2, "PCM_24", "WAV"), datetime(2024, 1, 1), None, None)
    bad = ("x", "Song", "", "a.wav", "A" * 64, "p", A, (0.0, 48000, 2, "", "WAV"), datetime(2024, 1, 1), None, "x")
    df = gates.validate_rows(spark.createDataFrame([row, bad], struct_of(CATALOG)), gates.catalog_rules())
    valid, quarantined = gates.split_valid(df)
    assert [r.song_id for r in valid.collect()] == ["song-a"]
    assert set(quarantined.first().violations) == {
        "song_id", "title", "source_sha256", "duration", "codec", "normalized_sha256",
    }


def test_policy_and_request_rules(spark):
    spans = spark.createDataFrame(
        [(0.0, 1.0, "r"), (2.0, 2.0, "r"), (-1.0, 0.0, None)], "start_s double, end_s double, reason string"
    )
    assert _failures(spans, gates.interval_rules()) == [[], ["order"], ["start", "end", "reason"]]
    voice = spark.createDataFrame(
        [("song-a", True, None), ("song-a", False, None), ("a", None, None)],
        "song_id string, exclude_entire_song boolean, reason string",
    )
    assert _failures(voice, gates.voice_policy_rules()) == [["reason"], [], ["song_id"]]
    asked = spark.createDataFrame(
        [("p", 180, None, None, "en", 2**63 - 1), ("", 5, 10, "k" * 51, "EN", -1)],
        "prompt string, duration_seconds int, bpm int, key string, vocal_language string, seed bigint",
    )
    out = _failures(asked, gates.generation_rules())
    assert out[0] == [] and len(out[1]) == 6


def test_dropout_definitions_differ(spark):
    rows = [("a", i, 200.0, 0.1 if i else 0.0025) for i in range(9)]
    df = spark.createDataFrame(rows, "series_id string, frame_idx bigint, f0 double, rms double")

    def count(definition):
        factor, floor = definition
        flagged = sequence.with_dropouts(df, factor=factor, floor=floor)
        return flagged.where("dropout").count()

    assert count(sequence.DROPOUT_STRICT) == 1 and count(sequence.DROPOUT_LOOSE) == 0


def test_report_is_lines(spark, tmp_path):
    header = spark.createDataFrame([("d", 2)], "dataset_id string, n int")
    segments = spark.createDataFrame([("d", "s1"), ("d", "s2")], "dataset_id string, song_id string")
    path = str(tmp_path / "report")
    sinks.write_report({"header": header, "segment": segments}, ["dataset_id"], path)
    back = spark.read.json(path)
    assert {(r.kind, r["count"]) for r in back.groupBy("kind").count().collect()} == {("header", 1), ("segment", 2)}
    assert back.where(F.col("kind") == "header").first().body == '{"dataset_id":"d","n":2}'
