from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reelgate.operators import gates, lineage, qc

A, B = "a" * 64, "b" * 64
NOW = datetime(2024, 6, 1)
RIGHTS = (
    "artist_id string, status string, effective_at timestamp, expires_at timestamp, "
    "n_approvals int, training boolean, singing_voice boolean"
)


def _gate(spark, capability="training", artist="x", at=NOW, **changes):
    row = {
        "artist_id": "x", "status": "approved", "effective_at": NOW - timedelta(days=1),
        "expires_at": NOW + timedelta(days=1), "n_approvals": 1, "training": True,
        "singing_voice": False, **changes,
    }
    rights = spark.createDataFrame([tuple(row.values())], RIGHTS)
    asked = spark.createDataFrame([(artist, capability)], "artist_id string, capability string")
    return gates.capability_gate(asked, rights, F.lit(at)).first()


@pytest.mark.parametrize(
    ("options", "reason"),
    [
        ({}, None),
        ({"artist": "y"}, "no rights manifest"),
        ({"n_approvals": 0}, "no approval evidence"),
        ({"n_approvals": None}, "no approval evidence"),
        ({"status": "revoked"}, "not approved"),
        ({"status": None}, "not approved"),
        ({"at": NOW - timedelta(days=2)}, "not yet effective"),
        ({"at": NOW + timedelta(days=1)}, "expired"),
        ({"at": NOW - timedelta(days=1)}, None),
        ({"capability": "singing_voice"}, "capability not granted"),
        ({"capability": "sing"}, "unknown capability"),
        ({"training": None}, "capability not granted"),
    ],
)
def test_capability_gate(spark, options, reason):
    row = _gate(spark, **options)
    assert row.denial_reason == reason and row.allowed == (reason is None)


def test_exclusions_by_hash_and_name(spark):
    policy = spark.createDataFrame(
        [(B, "other.mp3", "second", 1), (A, "removed.mp3", "first", 0)],
        "sha256 string, filename string, reason string, pos int",
    )
    files = spark.createDataFrame(
        [(1, A, "renamed.mp3"), (2, "c" * 64, "REMOVED.MP3"), (3, "c" * 64, "kept.mp3"),
         (4, B, "removed.mp3"), (5, "c" * 64, None)],
        "id int, sha256 string, filename string",
    )
    out = {r.id: r.exclusion_reason for r in gates.source_exclusions(files, policy).collect()}
    assert out == {1: "first", 2: "first", 3: None, 4: "first", 5: None}
    plan = gates.source_exclusions(files, policy)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_voice_gate_matches_inside_words(spark):
    songs = spark.createDataFrame(
        [("song-olive", "a"), ("song-b", "Concert"), ("song-c", "studio"), ("song-d", "x")],
        "song_id string, title string",
    )
    policy = spark.createDataFrame(
        [("song-d", True, "fragment")], "song_id string, exclude_entire_song boolean, reason string"
    )
    out = {
        r.song_id: r.voice_reason
        for r in gates.voice_song_gate(songs, policy, F.col("title")).collect()
        if r.voice_excluded
    }
    assert set(out) == {"song-olive", "song-b", "song-d"} and out["song-d"] == "fragment"
    relaxed = gates.voice_song_gate(songs, policy, F.col("title"), reject_live=False)
    assert [r.song_id for r in relaxed.where("voice_excluded").collect()] == ["song-d"]


def test_intervals_are_half_open(spark):
    windows = spark.createDataFrame(
        [("s", 15.0, 25.0), ("s", 32.0, 47.0), ("s", 5.0, 20.0), ("s", 19.0, 20.5), ("t", 20.0, 30.0)],
        "song_id string, start_s double, end_s double",
    )
    walls = spark.createDataFrame(
        [("s", 20.0, 32.0), ("s", 21.0, 22.0)], "song_id string, start_s double, end_s double"
    )
    kept = gates.interval_exclusion(windows, walls).orderBy("song_id", "start_s").collect()
    assert [(r.song_id, r.start_s) for r in kept] == [("s", 5.0), ("s", 32.0), ("t", 20.0)]


def test_scopes_are_independent(spark):
    songs = spark.createDataFrame([("song-a",), ("song-b",)], "song_id string")
    music = spark.createDataFrame(
        [("song-a", True, "r", NOW), ("song-b", True, None, None)],
        "song_id string, exclude_from_training boolean, reason string, excluded_at timestamp",
    )
    assert gates.music_song_gate(songs, music).count() == 0
    voice = spark.createDataFrame([], "song_id string, exclude_entire_song boolean, reason string")
    assert gates.voice_song_gate(songs, voice, F.lit("")).where("voice_excluded").count() == 0
    checked = gates.validate_rows(music, gates.music_policy_rules())
    assert {r.song_id: r.violations for r in checked.collect()} == {"song-a": [], "song-b": ["audit"]}


def test_row_rules(spark):
    policy = spark.createDataFrame(
        [(A, "x.mp3", "r", NOW), (A, "a/x.mp3", "r", NOW), ("A" * 64, "x.mp3", "", None)],
        "sha256 string, filename string, reason string, excluded_at timestamp",
    )
    out = [r.violations for r in gates.validate_rows(policy, gates.exclusion_rules()).collect()]
    assert out == [[], ["filename"], ["sha256", "reason", "excluded_at"]]
    rights = spark.createDataFrame(
        [("a-b", "approved", NOW, NOW, None, None), ("A", "new", None, None, None, None)],
        "artist_id string, status string, effective_at timestamp, expires_at timestamp, "
        "approvals array<struct<holder:string,scope:string,evidence_reference:string,approved_at:timestamp>>, "
        "source_assets array<struct<sha256:string,evidence_reference:string>>",
    )
    out = [r.violations for r in gates.validate_rows(rights, gates.rights_rules()).collect()]
    assert out == [["window"], ["artist_id", "status"]]


def test_metric_gate_fails_null_and_nan(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "id int, voiced_fraction double")
    out = gates.metric_gate(rows, {"voiced_fraction": (0.1, 0.9)})
    assert [len(r.failed_rules) for r in out.orderBy("id").collect()] == [0, 1, 1]


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame(
        [("B.wav", A), ("a.wav", A), ("c.wav", B)], "path string, sha256 string"
    )
    kept = lineage.dedup_by_hash(rows, [F.lower("path")]).orderBy("path").collect()
    assert [r.path for r in kept] == ["a.wav", "c.wav"]
    plan = lineage.dedup_by_hash(rows, [F.lower("path")])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    ("exists", "recorded", "rebuild", "decision"),
    [
        (False, None, False, "create"),
        (True, (A, 0.9), False, "reuse"),
        (True, (A, None), False, "refuse: settings differ"),
        (True, (A, 0.5), True, "rebuild"),
        (True, (B, 0.9), True, "refuse: lineage mismatch"),
        (True, None, True, "refuse: untracked output"),
    ],
)
def test_reconcile(spark, exists, recorded, rebuild, decision):
    asked = spark.createDataFrame(
        [("s", exists, A, 0.9)], "song_id string, output_exists boolean, h string, strength double"
    )
    rows = [("s", *recorded)] if recorded else []
    known = spark.createDataFrame(rows, "song_id string, h string, strength double")
    out = lineage.reconcile(
        asked, known, "song_id", lineage=["h"], settings={"strength": 1.0}, rebuild=rebuild
    )
    assert out.first().decision == decision


def test_null_hash_passes_only_in_the_run_variant(spark):
    recorded = spark.createDataFrame([("r", "a", None)], "run_id string, name string, sha256 string")
    actual = spark.createDataFrame([("r", "a", A)], "run_id string, name string, sha256 string")
    keys = ["run_id", "name"]
    assert lineage.integrity_check(recorded, actual, keys).first().status == "mismatch"
    lax = lineage.integrity_check(recorded, actual, keys, null_recorded_passes=True)
    assert lax.first().status == "ok"


def test_no_policy_is_a_policy(spark):
    sets = spark.createDataFrame([("d", None), ("e", A)], "dataset_id string, dataset_policy_sha256 string")
    assert [r.dataset_id for r in lineage.stale_policy(sets, F.lit(None).cast("string")).collect()] == ["e"]
    assert [r.dataset_id for r in lineage.stale_policy(sets, F.lit(A)).collect()] == ["d"]


def test_tree_digest_sees_every_change(spark):
    def digest(*files):
        df = spark.createDataFrame([("r", p, h) for p, h in files], "root string, rel_path string, sha256 string")
        return lineage.tree_digest(df).first().digest

    base = digest(("a", A), ("b", B))
    assert base == digest(("b", B), ("a", A))
    assert len({base, digest(("a", B), ("b", A)), digest(("a", A)), digest(("c", A), ("b", B))}) == 4


def test_run_transitions(spark):
    rows = [
        ("ok", 0, "created"), ("ok", 1, "music_generated"), ("ok", 2, "complete"),
        ("bad", 0, "created"), ("bad", 1, "complete"),
        ("late", 0, "created"), ("late", 2, "failed"),
        ("dead", 0, "created"), ("dead", 1, "failed"), ("dead", 2, "created"),
        ("odd", 0, "mixed"),
    ]
    events = spark.createDataFrame(rows, "run_id string, sequence bigint, stage string")
    out = {
        (r.run_id, r.sequence): r.violation
        for r in lineage.legal_transitions(events).where("violation is not null").collect()
    }
    assert out == {
        ("bad", 1): "illegal transition",
        ("late", 2): "sequence gap",
        ("dead", 2): "illegal transition",
        ("odd", 0): "illegal first stage",
    }


def test_acceptance_of_missing_measurements(spark):
    good = {
        "duration_seconds": 180.0, "expected_seconds": 180.0, "sample_rate": 48000, "channels": 2,
        "codec": "PCM_24", "integrated_lufs": -14.2, "true_peak_dbfs": -1.0,
        "vocal_to_instrumental_db": 1.5, "clipping_fraction": 0.0, "sustained_dropout_count": 0,
        "max_voiced_join_jump_db": 2.0, "f0_median_error_cents": 10.0,
        "f0_gross_error_fraction": 0.01, "identity_window_threshold": 0.4,
        "minimum_window_identity_similarity": 0.5, "identity_threshold": 0.9,
        "minimum_identity_similarity": 0.1, "covered": True,
    }
    schema = ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'double'}"
        for k, v in good.items()
    )

    def check(**changes):
        row = {**good, **changes}
        values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row.values()]
        return qc.acceptance_checks(spark.createDataFrame([tuple(values)], schema)).first()

    assert check().accepted and len(qc.CHECKS) == 14
    assert check(f0_median_error_cents=None).failures == ["pitch_median"]
    assert check(f0_gross_error_fraction=0.05).failures == ["pitch_gross"]
    assert check(minimum_window_identity_similarity=None).failures == ["voice_identity"]
    assert check(identity_window_threshold=None).failures == ["voice_identity"]
    assert check(identity_window_threshold=None, identity_threshold=None).accepted
    assert check(covered=None).failures == ["phrase_coverage"]
