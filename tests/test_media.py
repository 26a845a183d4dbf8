import hashlib
import json
import random
import struct
from datetime import datetime

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from samples_dir import SAMPLE
from synth import tone, write_wav

from reelgate.catalogue import media as catalogue
from reelgate.operators.frames import active_rms, series_metrics, window_metrics
from reelgate.plans import curation, ingestion
from reelgate.plans.rhythm import analyse_rhythm
from reelgate.sources import documents, media, sinks
from reelgate.streaming.ingest import TABLES, media_paths, read_table, start_media_ingest
from reelgate.streaming.runs import run_state_stream


def _recordings(spark, files):
    df = spark.createDataFrame(list(files.items()), "series_id string, path string")
    return media.probe_media(df)


def test_discovery_reads_no_content(spark, tmp_path):
    for name in ("b.WAV", "sub/a.mp3", "notes.txt", "sub/C.flac"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    files = media.discover_media(spark, str(tmp_path))
    listed = [r.filename for r in media.in_path_order(files).collect()]
    assert listed == ["b.WAV", "a.mp3", "C.flac"]
    scan = files.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan
    hashed = media.hash_files(files).where("filename = 'a.mp3'").first()
    assert hashed.sha256 == hashlib.sha256(b"sub/a.mp3").hexdigest() and hashed.error is None


def test_discovery_is_not_held_by_the_driver(spark, tmp_path):
    for n in range(300):
        path = tmp_path / f"{n % 3}" / f"{n % 7}" / f"{n}.wav"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    files = media.discover_media(spark, str(tmp_path))
    # a reader of the files would list them all while the plan is built
    assert files.inputFiles() and all("/pinned-" in f for f in files.inputFiles())
    assert {(r.filename, r.length) for r in files.collect()} == {(f"{n}.wav", n) for n in range(300)}


def test_recordings_of_the_queries_are_not_held_by_the_driver(spark):
    """What pitch_adherence, curation_plan and bank_plan read; media_stream_ingest lists the same folder."""
    recordings = catalogue._recordings(spark, SAMPLE)
    assert recordings.inputFiles() and all("/pinned-" in f for f in recordings.inputFiles())


def test_discovery_of_odd_roots(spark, tmp_path):
    for name in ("a b/x.wav", "a b/.y.wav", "_c/empty.wav", "z.wav/inside.mp3", "a b/none.txt", "u.WAV"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"" if "empty" in name else name.encode())
    (tmp_path / "void").mkdir()
    (tmp_path / "gone.wav").symlink_to(tmp_path / "nowhere")

    def found(root, **how):
        return media.discover_media(spark, root, **how)

    every = found(str(tmp_path))
    assert [c for c, _ in every.dtypes] == ["path", "length", "modificationTime", "filename"]
    rows = {r.filename: r for r in every.collect()}
    assert set(rows) == {"x.wav", ".y.wav", "empty.wav", "inside.mp3", "u.WAV"}
    assert rows["x.wav"].path == f"file:{tmp_path}/a b/x.wav" and rows["empty.wav"].length == 0
    assert abs(rows["x.wav"].modificationTime.timestamp() - (tmp_path / "a b/x.wav").stat().st_mtime) < 0.01
    assert {r.filename for r in found(f"file://{tmp_path}/*", suffixes=["mp3"]).collect()} == {"inside.mp3"}
    assert [r.filename for r in found(str(tmp_path / "u.WAV")).collect()] == ["u.WAV"]
    assert found(str(tmp_path / "void")).count() == 0
    held = {r.filename: bytes(r.content) for r in found(str(tmp_path), content=True).collect()}
    assert held["x.wav"] == b"a b/x.wav" and held["empty.wav"] == b"" and len(held) == 5
    with pytest.raises(FileNotFoundError):
        found(str(tmp_path / "nothing"))


def test_probe_quarantines_bad_files(spark, tmp_path):
    good = write_wav(tmp_path / "a.wav", np.zeros((4410, 2)), 44100, 3)
    (tmp_path / "b.wav").write_bytes(b"not audio")
    rows = {r.series_id: r for r in _recordings(spark, {"a": good, "b": str(tmp_path / "b.wav"), "c": "/none.wav"}).collect()}
    a = rows["a"]
    assert (a.duration_seconds, a.sample_rate, a.channels, a.codec) == (0.1, 44100, 2, "PCM_24")
    assert rows["b"].error and rows["c"].error and rows["c"].duration_seconds is None


def test_frame_energy_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    rate, n, count = 22_050, 50_123, 113
    audio = rng.uniform(-1, 1, (n, 2))
    path = write_wav(tmp_path / "a.wav", audio, rate)
    exact = media.read_samples(path, 0, n).astype(np.float64)
    mono = exact.mean(axis=1).astype(np.float32).astype(np.float64)
    edges = np.rint(np.linspace(0, n, count + 1)).astype(int)
    recs = _recordings(spark, {"a": path}).withColumn("n_frames", F.lit(count))
    rows = media.frame_energy(recs, per_task=10).orderBy("frame_idx").collect()
    assert len(rows) == count
    for i, r in enumerate(rows):
        part = mono[edges[i] : edges[i + 1]]
        both = exact[edges[i] : edges[i + 1]]
        assert r.n == len(part)
        assert r.rms == pytest.approx(np.sqrt(np.mean(part**2)), rel=1e-6)
        assert r.peak == pytest.approx(np.abs(part).max(), rel=1e-6)
        assert r.side_sq == pytest.approx(np.sum((both[:, 0] - both[:, 1]) ** 2) / 4, rel=1e-6)


def test_overlapped_energy_matches_numpy(spark, tmp_path):
    rate = 8_000
    audio = np.random.default_rng(2).uniform(-0.5, 0.5, 9_000)
    path = write_wav(tmp_path / "a.wav", audio, rate)
    mono = media.read_samples(path, 0, 9_000)[:, 0]
    size, hop = round(rate * 0.046), round(rate * 0.012)
    change = np.diff(mono, prepend=mono[0])
    starts = range(0, len(mono) - size + 1, hop)
    rows = media.overlapped_energy(_recordings(spark, {"a": path}), per_task=7).orderBy("frame_idx").collect()
    assert len(rows) == len(starts)
    for r, s in zip(rows, starts):
        assert r.rms == pytest.approx(np.sqrt(np.mean(mono[s : s + size].astype(float) ** 2)), rel=1e-6)
        assert r.detail_rms == pytest.approx(np.sqrt(np.mean(change[s : s + size].astype(float) ** 2)), rel=1e-6)


def test_active_rms_of_a_half_silent_recording(spark, tmp_path):
    audio = np.concatenate([np.full(2048 * 3, 0.5), np.zeros(2048 * 3 + 100)])
    path = write_wav(tmp_path / "a.wav", audio, 8_000)
    out = active_rms(media.fixed_frames(_recordings(spark, {"a": path}), per_task=2))
    assert out.first().active_rms == pytest.approx(0.5, abs=1e-4)


def test_band_ratio_and_join_levels(spark, tmp_path):
    rate = 44_100
    bright = tone(6_000, 0.1, 1, rate) + tone(180, 0.01, 1, rate)
    step = np.concatenate([np.full(480, 0.5), np.full(480, 0.01)])
    paths = {"a": write_wav(tmp_path / "a.wav", bright, rate), "b": write_wav(tmp_path / "b.wav", step, 96_000)}
    recs = _recordings(spark, paths)
    excerpts = recs.where("series_id = 'a'").select(
        "path", "sample_rate", F.lit(0).alias("start_sample"), F.col("n_samples").alias("end_sample")
    )
    assert media.band_ratio(excerpts).first().high_band_ratio_db == pytest.approx(20, abs=0.5)
    joins = recs.where("series_id = 'b'").select(
        "path", "sample_rate", F.explode(F.array(F.lit(480), F.lit(100))).alias("join_sample")
    )
    rows = {r.join_sample: r for r in media.join_levels(joins).collect()}
    assert rows[480].before_rms / rows[480].after_rms == pytest.approx(50, rel=0.01)
    assert rows[100].before_rms is None


def test_recordings_without_samples_have_no_levels(spark, tmp_path):
    sound = write_wav(tmp_path / "a.wav", np.full(900, 0.5), 8_000)
    empty = write_wav(tmp_path / "b.wav", np.zeros((0, 1)), 8_000)
    recs = _recordings(spark, {"a": sound, "b": empty, "c": str(tmp_path / "none.wav")})
    joins = recs.withColumn("join_sample", F.expr("n_samples div 2"))
    rows = {r.series_id: (r.before_rms, r.after_rms) for r in media.join_levels(joins).collect()}
    assert rows["a"] == pytest.approx((0.5, 0.5), abs=1e-4) and rows["b"] == rows["c"] == (None, None)
    assert {r.series_id for r in media.overlapped_energy(recs).collect()} == {"a"}


@pytest.mark.parametrize("name", ["join_levels", "overlapped_energy", "stereo_energy"])
def test_documents_without_text(spark, tmp_path, name):
    """Null, empty and one byte: the first two are recordings without samples."""
    rows = [(0, None, "src0"), (1, "", "src0"), (2, "x", "src1"), (3, "some words" * 50, "src1")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, duck, str(tmp_path), name) is None


@pytest.mark.parametrize("hertz", [220.0, 247.0])
def test_pitch_adherence(spark, tmp_path, hertz):
    path = write_wav(tmp_path / "a.wav", tone(220, 0.3, 4, 24_000), 24_000)
    recs = _recordings(spark, {"a": path})
    frames = spark.createDataFrame(
        [("a", i, hertz) for i in range(200)], "series_id string, frame_idx bigint, f0 double"
    )
    row = media.pitch_adherence(frames, recs).first()
    if hertz == 220.0:
        assert row.f0_median_error_cents < 20 and row.f0_gross_error_fraction == 0
    else:
        assert row.f0_median_error_cents > 90


def test_contours(spark, tmp_path):
    for name, values in {"a": np.arange(1, 51, dtype=np.float32).reshape(2, 25), "b": np.zeros(4, np.float32), "e": np.zeros(0)}.items():
        np.save(tmp_path / f"{name}.npy", values)
    (tmp_path / "x.npy").write_bytes(b"broken")
    files = spark.createDataFrame([(k, str(tmp_path / f"{k}.npy")) for k in "abex"], "series_id string, path string")
    frames, bad = media.read_contours(files, per_task=7)
    assert [r.f0 for r in frames.where("series_id = 'a'").orderBy("frame_idx").collect()] == list(range(1, 51))
    assert {r.series_id for r in bad.collect()} == {"b", "e", "x"}


@pytest.fixture(scope="module")
def song(spark, tmp_path_factory):
    """45 s stereo: a 180 Hz voice with some air, silent contour in the last half second of two."""
    rate = 44_100
    mono = tone(180, 0.1, 45, rate) + tone(6_000, 0.003, 45, rate)
    path = write_wav(tmp_path_factory.mktemp("song") / "clean_vocals.wav", np.column_stack([mono, mono]), rate)
    recs = _recordings(spark, {"song-a": path}).withColumn("n_frames", F.lit(2250))
    f0 = [0.0 if i % 100 >= 75 else 180.0 for i in range(2250)]
    contour = spark.createDataFrame(
        [("song-a", i, f) for i, f in enumerate(f0)], "series_id string, frame_idx bigint, f0 double"
    )
    frames = media.frame_energy(recs).join(contour, ["series_id", "frame_idx"])
    return recs, frames.withColumnRenamed("series_id", "song_id")


def _policy(spark, intervals=(), sources=()):
    return curation.Policy(
        sources=spark.createDataFrame(list(sources), "artist_id string, sha256 string, filename string, reason string, pos int"),
        voice=spark.createDataFrame([], "artist_id string, song_id string, exclude_entire_song boolean, reason string"),
        intervals=spark.createDataFrame(list(intervals), "artist_id string, song_id string, start_s double, end_s double"),
    )


def _build(spark, song, intervals=(), lineage="v", listed="src", sources=(), granted=True, artists=("x",), clean=None, f0=None):
    recs, frames = song
    path = recs.first().path
    with open(path.removeprefix("file:"), "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    stems = spark.createDataFrame(
        [(a, "song-a", "src", ("v",), (*(clean or (path, digest)), lineage), f0 or (path, digest)) for a in artists],
        "artist_id string, song_id string, source_sha256 string, vocals struct<sha256:string>, "
        "clean_vocals struct<path:string, sha256:string, source_vocals_sha256:string>, f0 struct<path:string, sha256:string>",
    )
    catalog = spark.createDataFrame(
        [("x", "song-a", "A", "a.wav")], "artist_id string, song_id string, title string, source_filename string"
    )
    allowed = spark.createDataFrame([("x", listed)], "artist_id string, sha256 string")
    rights = spark.createDataFrame(
        [(a, "approved", None, None, 1, True, granted) for a in artists],
        "artist_id string, status string, effective_at timestamp, expires_at timestamp, n_approvals int, "
        "training boolean, singing_voice boolean",
    )

    def bands(windows):
        where = recs.select(F.col("series_id").alias("song_id"), "path", "sample_rate")
        cut = windows.join(where, "song_id").withColumn(
            "start_sample", F.rint(F.col("start_s") * F.col("sample_rate")).cast("long")
        ).withColumn("end_sample", F.rint(F.col("end_s") * F.col("sample_rate")).cast("long"))
        return media.band_ratio(cut)

    def frames_of(passed):
        return frames.join(passed.select("artist_id", "song_id"), "song_id")

    return curation.curate(
        stems, catalog, _policy(spark, intervals, sources), allowed, frames_of,
        rights=rights, at=F.lit(datetime(2024, 6, 1)), bands=bands, training_segments=1,
    )


def test_curation(spark, song):
    built = _build(spark, song)
    rows = built.segments.collect()
    assert sorted(r.split for r in rows) == ["train", "validation"]
    assert built.violations.count() == 0
    row = rows[0]
    assert row.median_f0_hz == pytest.approx(180) and row.voiced_fraction == pytest.approx(0.75, abs=0.03)
    assert row.centre_dominance_db == pytest.approx(120) and row.longest_voicing_seconds == 1.5
    assert row.high_band_ratio_db == pytest.approx(20 * np.log10(0.03), abs=1)


def test_curation_skips_excluded_intervals(spark, song):
    built = _build(spark, song, [("x", "song-a", 0.0, 20.0), ("y", "song-a", 0.0, 45.0)])
    assert all(r.start_s >= 20 for r in built.segments.collect())


def test_curation_reports_broken_lineage_and_unlisted_sources(spark, song):
    assert [r.violation for r in _build(spark, song, lineage=None).violations.collect()] == ["incomplete"]
    assert [r.violation for r in _build(spark, song, listed="other").violations.collect()] == ["not allow-listed"]


def test_curation_never_decodes_files_that_changed(spark, song):
    path = song[0].first().path
    for given, found in (
        ({"clean": (path, "0" * 64)}, [("changed file", "clean_vocals")]),
        ({"f0": (path + ".gone", "0" * 64)}, [("missing file", "f0")]),
        ({"clean": (None, "0" * 64), "f0": (path, None)}, [("incomplete", "clean_vocals"), ("incomplete", "f0")]),
    ):
        built = _build(spark, song, **given)
        assert sorted((r.violation, r.column_name) for r in built.violations.collect()) == found
        assert built.segments.count() == 0 and built.sources.count() == 0


def test_relative_stem_paths_start_at_the_root(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "clean_vocals.wav").write_bytes(b"sound")
    digest = hashlib.sha256(b"sound").hexdigest()
    entry = ("a/clean_vocals.wav", digest)
    stems = spark.createDataFrame(
        [("x/s", "x", "s", entry, entry)],
        "song_key string, artist_id string, song_id string, clean_vocals struct<path:string, sha256:string>, f0 struct<path:string, sha256:string>",
    )
    passed, broken = curation.intact_stems(stems, str(tmp_path))
    assert passed.count() == 1 and broken.count() == 0


def test_curation_is_governed_per_artist(spark, song):
    """Two artists share a song id and a source hash; rules and allow-lists are their own."""
    rule = ("y", "src", "", "withdrawn", 0)
    built = _build(spark, song, artists=("x", "y"), sources=[rule])
    assert {(r.artist_id, r.scope, r.reason) for r in built.excluded.collect()} == {("y", "source", "withdrawn")}
    assert {r.artist_id for r in built.segments.collect()} == {"x"}
    built = _build(spark, song, artists=("x", "y"))
    assert [(r.artist_id, r.violation) for r in built.violations.collect()] == [("y", "not allow-listed")]
    assert [(r.artist_id, r.training_segments) for r in built.sources.collect()] == [("x", 1)]


def test_curation_asks_for_every_capability(spark, song):
    built = _build(spark, song, granted=False)
    assert [(r.scope, r.reason) for r in built.excluded.collect()] == [("rights", "capability not granted")]
    assert built.segments.count() == 0 and built.sources.count() == 0


def test_window_metrics_equal_series_metrics_of_the_cut(spark, song):
    _, frames = song
    window = window_metrics(frames, 750, 250, keys=["song_id"]).where("start_frame = 500").first()
    cut = frames.where("frame_idx >= 500 and frame_idx < 1250").withColumn("frame_idx", F.col("frame_idx") - 500)
    whole = series_metrics(cut, keys=["song_id"], sample_rate=44_100).first()
    for name in ("voiced_fraction", "median_f0_hz", "f0_p05_hz", "active_rms_dbfs", "one_second_level_range_db", "peak_dbfs", "clipping_fraction", "duration_seconds"):
        assert window[name] == pytest.approx(whole[name]), name


def test_bank_fills_roles(spark, song):
    _, frames = song
    candidates = curation.bank_candidates(frames, _policy(spark))
    assert candidates.count() > 0
    roles = [r.role for r in curation.fill_bank(candidates, ["neutral", "low"]).collect()]
    assert sorted(roles) == ["low", "neutral"]


def test_ingest(spark, tmp_path):
    for name, level in {"a.wav": 0.1, "b.wav": 0.1, "Removed.wav": 0.2, "new.wav": 0.3, "old.wav": 0.4}.items():
        write_wav(tmp_path / name, np.full(800, level), 8_000)
    (tmp_path / "broken.wav").write_bytes(b"x")
    sha = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    files = media.discover_media(spark, str(tmp_path)).select(F.lit("x").alias("artist_id"), "path", "filename")
    listed = [(sha[n], "e") for n in ("a.wav", "Removed.wav", "old.wav", "broken.wav")]
    rights = spark.createDataFrame(
        [("x", "approved", None, None, (True, False, False, False), [("h", "s", "e", datetime(2024, 1, 1))], listed, None, None)],
        "artist_id string, status string, effective_at timestamp, expires_at timestamp, "
        "permissions struct<training:boolean,music_style:boolean,singing_voice:boolean,commercial_release:boolean>, "
        "approvals array<struct<holder:string,scope:string,evidence_reference:string,approved_at:timestamp>>, "
        "source_assets array<struct<sha256:string,evidence_reference:string>>, release string, notes string",
    )
    exclusions = spark.createDataFrame([("x", "0" * 64, "removed.WAV", "withdrawn", 0)], "artist_id string, sha256 string, filename string, reason string, pos int")
    catalog = spark.createDataFrame([("x", "song-old-1", sha["old.wav"])], "artist_id string, song_id string, source_sha256 string")
    done = ingestion.ingest(files, rights, exclusions, catalog, F.lit(datetime(2024, 6, 1)))
    results = {r.path.rsplit("/", 1)[1]: (r.status, r.song_id) for r in done.results.collect()}
    song = f"song-a-{sha['a.wav'][:8]}"
    assert results["a.wav"] == ("imported", song) and results["b.wav"][0] == "duplicate"
    assert results["old.wav"] == ("duplicate", "song-old-1")
    denied = {r.path.rsplit("/", 1)[1]: r.denial_reason for r in done.denials.collect()}
    assert denied["Removed.wav"] == "withdrawn" and denied["new.wav"] == "not allow-listed" and denied["broken.wav"]
    rows = done.catalog.collect()
    assert [r.song_id for r in rows] == [song] and rows[0].audio.sample_rate == 8_000
    with pytest.raises(PermissionError):
        ingestion.ingest(files, rights, exclusions, catalog, F.lit(datetime(2024, 6, 1)), strict=True)


def test_ingest_denies_every_copy_of_an_unreadable_file(spark, tmp_path):
    for name in ("a.wav", "b.wav"):
        (tmp_path / name).write_bytes(b"no header")
    digest = hashlib.sha256(b"no header").hexdigest()
    files = spark.createDataFrame(
        [("x", str(tmp_path / n), n) for n in ("a.wav", "b.wav")], "artist_id string, path string, filename string"
    )
    rights = spark.createDataFrame(
        [("x", "approved", None, None, 1, True)],
        "artist_id string, status string, effective_at timestamp, expires_at timestamp, n_approvals int, training boolean",
    )
    assets = spark.createDataFrame([("x", digest)], "artist_id string, sha256 string")
    none = spark.createDataFrame(
        [], "artist_id string, sha256 string, filename string, reason string, pos int"
    )
    catalog = spark.createDataFrame([], "artist_id string, song_id string, source_sha256 string")
    at = F.lit(datetime(2024, 6, 1))
    done = ingestion.ingest(files, rights, none, catalog, at, assets=assets)
    assert done.catalog.count() == 0 and done.results.count() == 0
    assert sorted(r.path[-5:] for r in done.denials.collect()) == ["a.wav", "b.wav"]
    with pytest.raises(Exception, match="denied source"):
        ingestion.ingest(files, rights, none, catalog, at, assets=assets, strict=True)


def test_media_ingest_resumes_and_replays(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "state"
    none = spark.createDataFrame([("x", "", "LATE.wav", "withdrawn", 0)], "artist_id string, sha256 string, filename string, reason string, pos int")
    rights = spark.createDataFrame(
        [("x", "approved", None, None, 1, True), ("y", "pending", None, None, 1, True)],
        "artist_id string, status string, effective_at timestamp, expires_at timestamp, n_approvals int, training boolean",
    )
    at = F.lit(datetime(2024, 6, 1))

    def write(name, level):
        write_wav(source / name, np.full(100, level), 8_000)
        return ("x", hashlib.sha256((source / name).read_bytes()).hexdigest())

    listed = [write("x/a.wav", 0.1)]
    write("y/a.wav", 0.1)

    def arrived():
        artist = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("artist_id")
        return media_paths(spark, str(source), media.SUFFIXES).select(artist, "path", "filename")

    def run():
        assets = spark.createDataFrame(listed, "artist_id string, sha256 string")
        start_media_ingest(
            arrived(), str(folder), rights=rights, exclusions=none, at=at, assets=assets
        ).awaitTermination()
        done = [read_table(spark, str(folder), name).collect() for name in TABLES]
        names = [["/".join(p.rsplit("/", 2)[1:]) for p in ps] for ps in ([r.path for r in done[0]], [r.path for r in done[1]])]
        return (
            sorted(zip(names[0], [(r.status, r.song_id) for r in done[0]])),
            sorted(zip(names[1], [r.denial_reason for r in done[1]])),
            sorted(r.song_id for r in done[2]),
        )

    song = f"song-a-{listed[0][1][:8]}"
    assert run() == ([("x/a.wav", ("imported", song))], [("y/a.wav", "not approved")], [song])
    write("x/copy.wav", 0.1)
    write("x/late.wav", 0.1)
    write("x/unknown.wav", 0.3)
    listed.append(write("x/new.wav", 0.2))
    (source / "x/broken.wav").write_bytes(b"no header")
    listed.append(("x", hashlib.sha256(b"no header").hexdigest()))
    results, denials, songs = run()
    other = f"song-new-{listed[1][1][:8]}"
    assert results == [("x/a.wav", ("imported", song)), ("x/copy.wav", ("duplicate", song)), ("x/new.wav", ("imported", other))]
    assert [d for d in denials if d[0] != "x/broken.wav"] == [
        ("x/late.wav", "withdrawn"), ("x/unknown.wav", "not allow-listed"), ("y/a.wav", "not approved")
    ]
    assert len(denials) == 4 and songs == sorted([song, other])
    # the last batch runs again, as after a failure between its writes and its commit
    for file in (folder / "progress" / "commits").glob("*1*"):
        file.unlink()
    assert run() == (results, denials, songs)
    # the plan for files at rest agrees
    rest = media.discover_media(spark, str(source)).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("artist_id"), "path", "filename"
    )
    catalog = spark.createDataFrame([], "artist_id string, song_id string, source_sha256 string")
    assets = spark.createDataFrame(listed, "artist_id string, sha256 string")
    once = ingestion.ingest(rest, rights, none, catalog, at, assets=assets)
    assert sorted(r.song_id for r in once.catalog.collect()) == songs
    assert sorted((r.status, r.song_id) for r in once.results.collect()) == sorted(r[1] for r in results)
    assert once.denials.count() == len(denials)


def test_unannounced_batches_are_not_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/catalog/batch=0")
    assert read_table(spark, str(tmp_path), "catalog") is None
    spark.range(1).write.parquet(f"{tmp_path}/announced/batch=0")
    spark.range(5).write.parquet(f"{tmp_path}/catalog/batch=1")
    assert read_table(spark, str(tmp_path), "catalog").count() == 3
    assert read_table(spark, str(tmp_path), "catalog", before=0) is None


def test_run_states_survive_between_batches(spark, tmp_path):
    source, out = tmp_path / "events", str(tmp_path / "out")
    source.mkdir()

    def run(name, rows):
        text = "\n".join(json.dumps(dict(zip(("run_id", "sequence", "stage"), r))) for r in rows)
        (source / name).write_text(text)
        stream = spark.readStream.schema("run_id string, sequence bigint, stage string").json(str(source))
        (
            run_state_stream(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
            .start().awaitTermination()
        )

    run("1.json", [("r", 1, "music_generated"), ("r", 0, "created"), ("q", 0, "mixed")])
    run("2.json", [("r", 2, "complete"), ("r", 1, "mixed"), ("q", 0, "created"), ("q", 2, "failed")])
    rows = [((r.run_id, r.sequence, r.stage), r.alert) for r in spark.read.parquet(out).collect()]
    alerts = {k: v for k, v in rows if v is not None}
    assert len(rows) == 7
    assert alerts == {
        ("q", 0, "mixed"): "illegal first stage",
        ("r", 1, "mixed"): "late event",
        ("q", 2, "failed"): "sequence gap",
    }
    stages = {(r.run_id, r.sequence, r.stage): (r.run_sequence, r.run_stage) for r in spark.read.parquet(out).collect()}
    assert stages[("r", 1, "music_generated")] == (1, "music_generated")
    assert stages[("r", 1, "mixed")] == (1, "music_generated") and stages[("q", 0, "mixed")] == (-1, None)
    # the latest rows tell what the event tables tell
    legal = spark.read.parquet(out).where("alert IS NULL")
    held = {r.run_id: r.stage for r in legal.groupBy("run_id").agg(F.max_by("stage", "sequence").alias("stage")).collect()}
    assert held == {"r": "complete", "q": "created"}


def test_run_states_of_disordered_events(spark, tmp_path):
    allowed = {"a": ("b",), "b": ("a",)}
    rows = [("r", i, "ab"[i % 2]) for i in range(60)] + [("r", 70, "a"), ("r", 30, "a"), ("s", 1, "b")]
    random.Random(1).shuffle(rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "sequence", "stage"), r))) for r in rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema("run_id string, sequence bigint, stage string").json(str(tmp_path / "in"))
        (
            run_state_stream(stream, allowed=allowed, first="a").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 63
    alerts = sorted((r.run_id, r.sequence, r.alert) for r in got if r.alert)
    assert alerts == [("r", 30, "late event"), ("r", 70, "sequence gap"), ("s", 1, "sequence gap")]
    assert max((r.run_sequence, r.run_stage) for r in got if r.run_id == "r") == (59, "b")


def test_documents(spark, tmp_path):
    stems = tmp_path / "stems"
    for name, body in {"a": '{"artist_id": "x",\n "song_id": "s", "f0": {"path": "p"}}', "b": "{", "c": '{"song_id": "s"}'}.items():
        (stems / name).mkdir(parents=True)
        (stems / name / "stems.json").write_text(body)
    good, bad = documents.read_stem_manifests(spark, f"{stems}/*/stems.json")
    assert [r.f0.path for r in good.collect()] == ["p"]
    assert sorted(r.violation for r in bad.collect()) == ["corrupt document", "missing identity"]
    (tmp_path / "rights.yaml").write_text(
        "artist_id: x\nstatus: approved\neffective_at: 2024-01-01T00:00:00Z\npermissions: {training: true}\n"
        "approvals:\n- {holder: h, scope: s, evidence_reference: e, approved_at: 2024-01-01T00:00:00Z}\n"
    )
    rights, wrong = documents.read_rights(spark, f"{tmp_path}/rights.yaml")
    row = rights.first()
    assert row.permissions.training and row.approvals[0].holder == "h" and wrong.count() == 0
    assert row.effective_at is not None
    (tmp_path / "catalog.yaml").write_text("artist_id: x\nsongs:\n- {id: song-a, title: A, audio: {channels: 2}}\n")
    songs, _ = documents.read_catalog(spark, f"{tmp_path}/catalog.yaml")
    assert songs.first().song_id == "song-a" and songs.first().audio.channels == 2


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 0.0), ("validation", "a", 9.0)], "split string, song_id string, start_seconds double")
    path = str(tmp_path / "d")
    sinks.write_dataset(df, path)
    assert (tmp_path / "d" / "_SUCCESS").exists() and (tmp_path / "d" / "split=train").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_dataset(df, path)
    body = sinks.report_lines({"segment": df}, ["song_id"]).orderBy("body").first().body
    assert body == '{"song_id":"a","split":"train","start_seconds":0.0}'


def test_rhythm_finds_the_beat(spark):
    rate, bpm = 83.0, 120.0
    rows = []
    for name, tempo in (("fast", 120.0), ("slow", 80.0)):
        period = rate * 60 / tempo
        for i in range(2_000):
            hit = 1.0 if i % period < 1 else 0.01
            rows.append((name, i, hit, hit))
    frames = spark.createDataFrame(rows, "series_id string, frame_idx bigint, rms double, detail_rms double")
    durations = spark.createDataFrame([("fast", 24.0), ("slow", 24.0)], "series_id string, duration_seconds double")
    out = {r.series_id: r for r in analyse_rhythm(frames, durations, rate).collect()}
    assert out["fast"].onset_density_per_second == pytest.approx(2.0, abs=0.1)
    assert out["slow"].onset_density_per_second == pytest.approx(80 / 60, abs=0.1)
    tempos = [bpm / 2, bpm, 2 * bpm]
    assert min(abs(out["fast"].pulse_bpm - t) for t in tempos) < 3
    assert out["fast"].upbeat_score > out["slow"].upbeat_score


def riff(*chunks, name=b"RIFF"):
    body = b"".join(n + struct.pack("<I", size if size is not None else len(b)) + b + b"\0" * (len(b) % 2) for n, b, size in chunks)
    return name + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def form_of(tag, channels, width, rate=8_000):
    return struct.pack("<HHIIHH", tag, channels, rate, rate * width * channels, width * channels, 8 * width)


def extensible(tag, channels, width):
    guid = struct.pack("<H", tag) + b"\0\0\0\0\x10\0\x80\0\0\xaa\0\x38\x9b\x71"
    return form_of(0xFFFE, channels, width) + struct.pack("<HHI", 22, 8 * width, 3) + guid


def test_wav_layouts(spark, tmp_path):
    x = np.linspace(-1, 1, 101)[:100].astype(np.float32)
    two = np.stack([x, -x], 1)
    whole = (two * 32768).clip(-32768, 32767).astype("<i2")
    three = b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in x)
    files = {
        "float": riff((b"LIST", b"odd", None), (b"fmt ", form_of(3, 2, 4), None), (b"data", two.astype("<f4").tobytes(), None), (b"id3 ", b"tail", None)),
        "double": riff((b"fmt ", form_of(3, 2, 8), None), (b"fact", b"1234", None), (b"data", two.astype("<f8").tobytes(), None)),
        "ext16": riff((b"fmt ", extensible(1, 2, 2), None), (b"data", whole.tobytes(), None)),
        "ext24": riff((b"fmt ", extensible(1, 1, 3), None), (b"data", three, None)),
        "extfloat": riff((b"fmt ", extensible(3, 1, 4), None), (b"data", x.tobytes(), None)),
        "cut": riff((b"fmt ", form_of(3, 1, 4), None), (b"data", x.tobytes()[:-3], 10_000)),
        "long": riff(
            (b"ds64", struct.pack("<QQQI", 1, 400, 100, 0), None), (b"fmt ", form_of(3, 1, 4), None), (b"data", x.tobytes() + b"behind", 0xFFFFFFFF), name=b"RF64"
        ),
        "empty": riff((b"fmt ", form_of(3, 1, 4), None), (b"data", b"", None)),
        "late": riff((b"data", x.tobytes(), None), (b"fmt ", form_of(3, 1, 4), None)),
        "none": riff((b"fmt ", form_of(3, 1, 4), None)),
        "mulaw": riff((b"fmt ", form_of(7, 1, 1), None), (b"data", b"abcd", None)),
        "block": riff((b"fmt ", form_of(3, 0, 4), None), (b"data", b"abcd", None)),
        "junk": b"not a recording at all",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.wav").write_bytes(body)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in media.probe_media(media.discover_media(spark, str(tmp_path)).select("path")).collect()}
    found = {n: (r.codec, r.channels, r.n_samples) for n, r in got.items() if r.error is None}
    assert found == {
        "float": ("FLOAT", 2, 100), "double": ("DOUBLE", 2, 100), "ext16": ("PCM_16", 2, 100), "ext24": ("PCM_24", 1, 100),
        "extfloat": ("FLOAT", 1, 100), "cut": ("FLOAT", 1, 99), "long": ("FLOAT", 1, 100),
    }
    for name in ("float", "double"):
        assert np.array_equal(media.read_samples(str(tmp_path / f"{name}.wav"), 10, 60), two[10:60])
    assert np.allclose(media.read_samples(str(tmp_path / "ext16.wav"), 0, 100), two, atol=1e-4)
    assert np.allclose(media.read_samples(str(tmp_path / "ext24.wav"), 0, 500)[:, 0], x, atol=1e-6)
    assert len(media.read_samples(str(tmp_path / "cut.wav"), 90, 500)) == 9
    assert np.array_equal(media.read_samples(str(tmp_path / "long.wav"), 0, 500)[:, 0], x)
