"""Sources, sinks and whole plans over recordings and documents derived from the tables.

Every document becomes a recording (its UTF-8 bytes as 8-bit samples) and every supplier a
governance document; the files lie in the shared folder and grow with the tables.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.catalogue.registry import (
    gap_fill_sql,
    query,
    rounded,
    spike_repair_sql,
    table,
)
from reelgate.catalogue.selection import topk_sql
from reelgate.operators.sequence import clean_contour
from reelgate.plans import curation, ingestion
from reelgate.session import pinned, shared_dir
from reelgate.sources import documents, media, sinks
from reelgate.streaming.ingest import TABLES, read_table, start_media_ingest

RATE = 8_000
FRAME = 160


def _put(folder: str, name: str, body: bytes) -> str:
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    system, root = (
        (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)
    )
    path = f"{root}/{name}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(body)
    return f"{folder}/{name}"


def _export(rows: DataFrame, folder: str, encode) -> None:
    """Write one file per row (name, body; null: empty) from the executors; a retry writes it again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [
                _put(folder, n, encode("" if b is None else b)) for n, b in zip(pdf["name"], pdf["body"], strict=True)
            ]
            yield pd.DataFrame({"path": paths})

    spread = rows.select("name", "body").repartition("name")
    spread.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def _wav(body) -> bytes:
    raw = body.encode() if isinstance(body, str) else bytes(body)
    out = io.BytesIO()
    with wave.open(out, "wb") as audio:
        audio.setnchannels(1)
        audio.setsampwidth(1)
        audio.setframerate(RATE)
        audio.writeframes(raw)
    return out.getvalue()


def _npy(body) -> bytes:
    out = io.BytesIO()
    np.save(out, np.frombuffer(body.encode(), np.uint8).astype(np.float32))
    return out.getvalue()


def _text(body) -> bytes:
    return body.encode()


def _name(suffix: str) -> Column:
    """A document's file, ten thousand numbers to a folder, as each folder is listed by one task."""
    return F.concat(F.expr("doc_id div 10000").cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix))


def _folder(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid4().hex}"


def _export_wavs(spark, d) -> str:
    folder = _folder(spark, "media")
    rows = table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"),
        F.col("text").alias("body"),
    )
    _export(rows, folder, _wav)
    return folder


def _recordings(spark, d) -> DataFrame:
    probed = media.probe_media(media.discover_media(spark, _export_wavs(spark, d)).select("path"))
    return probed.withColumn(
        "series_id", F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    ).withColumn("n_frames", F.ceil(F.col("n_samples") / FRAME))


def _hex32(n: str) -> str:
    return "||".join(f"lpad(to_hex(({n} // {256**i}) % 256), 2, '0')" for i in range(4))


@query(
    "media_inventory",
    f"""WITH t AS (SELECT doc_id, source, encode(text) AS b, octet_length(encode(text)) AS n FROM documents),
    w AS (SELECT *, unhex('52494646' || {_hex32("(n + 36)")} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_hex32("n")}) || b AS f FROM t)
    SELECT doc_id, source, n / 8000 AS duration_seconds, 8000 AS sample_rate, 1 AS channels, 'pcm_u8' AS codec, 'WAV' AS format_name,
      sha256(f) AS sha256, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR sha256(f) IN (SELECT sha256(x.f) FROM w x WHERE x.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS is_authorized FROM w""",
)
def media_inventory(spark, d):
    files = media.discover_media(spark, _export_wavs(spark, d)).select("path")
    hashed = media.hash_files(media.probe_media(files).drop("error")).drop("error", "n_samples")
    known = hashed.withColumn(
        "doc_id", F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    ).withColumn("source", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    good = known.join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    return media.inventory(known.drop("path"), good.select("sha256"))


_BYTES_SQL = """h AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents),
l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, n, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM l),
x AS (SELECT doc_id, n, i, (('0x' || p)::INT - 128) / 128 AS x FROM b)"""


def _energy_sql(samples: int) -> str:
    return f"""{_BYTES_SQL}, y AS (SELECT *, ceil(n / {samples})::BIGINT AS f FROM x),
    z AS (SELECT *, least(floor(i / (n / f))::BIGINT, f - 1) AS g FROM y),
    k AS (SELECT doc_id, x, CASE WHEN g + 1 < f AND i >= round_even((g + 1) * (n / f), 0) THEN g + 1
      WHEN i < round_even(g * (n / f), 0) THEN g - 1 ELSE g END AS k FROM z)"""


@query(
    "frame_energy",
    f"""WITH {_energy_sql(FRAME)}
    SELECT doc_id AS series_id, k AS frame_idx, count(*) AS n, round(sum(x * x), 6) AS sum_sq, round(sqrt(avg(x * x)), 6) AS rms,
      round(max(abs(x)), 6) AS peak, count(*) FILTER (abs(x) >= 0.999) AS clipped_n,
      round(sum(x * x), 6) AS mid_sq, 0::DOUBLE AS side_sq, 1 AS channels
    FROM k GROUP BY 1, 2""",
)
def frame_energy(spark, d):
    return rounded(media.frame_energy(_recordings(spark, d)))


@query(
    "stereo_energy",
    """WITH l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
    b AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i, len(l) // 2 AS m FROM l),
    x AS (SELECT doc_id, i // 2 AS j, m, max((('0x' || p)::INT - 128) / 128) FILTER (i % 2 = 0) AS a, max((('0x' || p)::INT - 128) / 128) FILTER (i % 2 = 1) AS b
      FROM b WHERE i < 2 * m GROUP BY ALL)
    SELECT doc_id AS series_id, max(m) AS n, round(sum(pow((a + b) / 2, 2)), 5) AS mid_sq, round(sum(pow((a - b) / 2, 2)), 5) AS side_sq,
      round(max(abs((a + b) / 2)), 6) AS peak, 2 AS channels FROM x GROUP BY 1""",
)
def stereo_energy(spark, d):
    """Every document's bytes as two interleaved channels: what both share, and what parts them."""
    folder = _folder(spark, "stereo")
    rows = table(spark, d, "documents").select(
        _name(".wav").alias("name"), F.col("text").alias("body")
    )
    _export(rows, folder, _stereo)
    probed = media.probe_media(media.discover_media(spark, folder).select("path")).where("error IS NULL")
    known = probed.withColumn("series_id", F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long"))
    frames = media.frame_energy(known.withColumn("n_frames", F.ceil(F.col("n_samples") / FRAME)))
    return frames.groupBy("series_id").agg(
        F.sum("n").alias("n"),
        F.round(F.sum("mid_sq"), 5).alias("mid_sq"),
        F.round(F.sum("side_sq"), 5).alias("side_sq"),
        F.round(F.max("peak"), 6).alias("peak"),
        F.max("channels").alias("channels"),
    )


def _stereo(body: str) -> bytes:
    raw = body.encode()
    form = struct.pack("<HHIIHH", 1, 2, RATE, RATE * 2, 2, 8)
    return _riff((b"fmt ", form), (b"data", raw[: len(raw) // 2 * 2]))


@query(
    "fixed_frames",
    f"""WITH {_BYTES_SQL} SELECT doc_id AS series_id, i // 2048 AS frame_idx, count(*) AS n, round(sum(x * x), 6) AS sum_sq FROM x GROUP BY 1, 2""",
)
def fixed_frames(spark, d):
    return rounded(media.fixed_frames(_recordings(spark, d)))


@query(
    "overlapped_energy",
    f"""WITH {_BYTES_SQL}, y AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY doc_id ORDER BY i), 0) AS dx FROM x),
    o AS (SELECT doc_id, i, x, dx, n, unnest(range(greatest((i - 368 + 96) // 96, 0), i // 96 + 1)) AS k FROM y)
    SELECT doc_id AS series_id, k AS frame_idx, round(sqrt(avg(x * x)), 5) AS rms, round(sqrt(avg(dx * dx)), 5) AS detail_rms
    FROM o WHERE i >= k * 96 AND i < k * 96 + 368 AND k * 96 < greatest(n - 368 + 1, 1) GROUP BY 1, 2""",
)
def overlapped_energy(spark, d):
    return rounded(media.overlapped_energy(_recordings(spark, d)), 5)


def _riff(*chunks: tuple[bytes, bytes]) -> bytes:
    body = b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def _wav_kinds(body: str) -> bytes:
    """Samples as floats, doubles, or 16 bits with an extensible header, by the first character."""
    kind, raw = int(body[0]), body[1:].encode()
    x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    width, samples = {0: (4, x.astype("<f4")), 1: (8, x.astype("<f8")), 2: (2, (x * 32768).astype("<i2"))}[kind]
    tag = 1 if kind == 2 else 3
    form = struct.pack("<HHIIHH", tag, 1, RATE, RATE * width, width, 8 * width)
    if kind == 2:
        guid = b"\x00\x00\x00\x00\x10\x00\x80\x00\x00\xaa\x00\x38\x9b\x71"
        form = struct.pack("<H", 0xFFFE) + form[2:] + struct.pack("<HHIH", 22, 8 * width, 4, tag) + guid
    # chunks of an odd length before the samples, and one behind them
    return _riff((b"LIST", b"odd"), (b"fmt ", form), (b"junk", b"x" * 5), (b"data", samples.tobytes()), (b"id3 ", b"tail"))


@query(
    "recording_formats",
    f"""WITH {_BYTES_SQL} SELECT doc_id AS series_id, CASE doc_id % 3 WHEN 0 THEN 'FLOAT' WHEN 1 THEN 'DOUBLE' ELSE 'PCM_16' END AS codec,
      count(*) AS n_samples, round(count(*) / 8000, 9) AS duration_seconds, round(sum(x * x), 6) AS sum_sq, round(max(abs(x)), 6) AS peak FROM x GROUP BY doc_id""",
)
def recording_formats(spark, d):
    """The documents as floating-point and extensible recordings, probed and decoded."""
    folder = _folder(spark, "formats")
    rows = table(spark, d, "documents").select(
        _name(".wav").alias("name"),
        F.concat((F.col("doc_id") % 3).cast("string"), F.coalesce("text", F.lit(""))).alias("body"),
    )
    _export(rows, folder, _wav_kinds)
    probed = media.probe_media(media.discover_media(spark, folder).select("path")).where("error IS NULL")
    known = pinned(probed.withColumn("series_id", F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")))
    frames = media.frame_energy(known.withColumn("n_frames", F.ceil(F.col("n_samples") / FRAME)))
    sums = frames.groupBy("series_id").agg(
        F.round(F.sum("sum_sq"), 6).alias("sum_sq"), F.round(F.max("peak"), 6).alias("peak")
    )
    return known.join(sums, "series_id").select(
        "series_id", "codec", "n_samples", F.round("duration_seconds", 9).alias("duration_seconds"), "sum_sq", "peak"
    )


#: Samples of a short excerpt, and the rate it is read at, which has a band above 5 kHz.
EXCERPT, FAST = 256, 16_000


@query(
    "band_ratio",
    f"""WITH {_BYTES_SQL}, s AS (SELECT doc_id, i, least(n, {EXCERPT}) AS n, x FROM x WHERE i < {EXCERPT}),
    w AS (SELECT doc_id, i, n, x * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM s WHERE n > 1),
    f AS (SELECT doc_id, n, k, sum(x * cos(2 * pi() * k * i / n)) AS re, sum(x * sin(2 * pi() * k * i / n)) AS im
      FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM w) GROUP BY ALL),
    e AS (SELECT doc_id, greatest(coalesce(sum(re * re + im * im) FILTER (k * {FAST} / n >= 5000), 0), 1e-20) AS hi,
      greatest(coalesce(sum(re * re + im * im) FILTER (k * {FAST} / n >= 100 AND k * {FAST} / n < 5000), 0), 1e-20) AS lo FROM f GROUP BY 1)
    SELECT doc_id AS series_id, round(coalesce(least(greatest(10 * (log10(hi) - log10(lo)), -120), 60), -120), 6) AS high_band_ratio_db
    FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN e USING (doc_id)""",
)
def band_ratio(spark, d):
    """The twin sums every sample into every bin of a spectrum."""
    excerpts = _recordings(spark, d).where("error IS NULL").select(
        "series_id",
        "path",
        F.lit(FAST).alias("sample_rate"),
        F.lit(0).cast("long").alias("start_sample"),
        F.least("n_samples", F.lit(EXCERPT)).alias("end_sample"),
    )
    return rounded(media.band_ratio(excerpts).select("series_id", "high_band_ratio_db"))


@query(
    "join_levels",
    f"""WITH {_BYTES_SQL} SELECT h.doc_id AS series_id, round(CASE WHEN h.n // 2 >= 40 AND h.n // 2 + 40 <= h.n THEN sqrt(avg(x * x) FILTER (i < h.n // 2)) END, 6) AS before_rms,
      round(CASE WHEN h.n // 2 >= 40 AND h.n // 2 + 40 <= h.n THEN sqrt(avg(x * x) FILTER (i >= h.n // 2)) END, 6) AS after_rms
    FROM h JOIN x ON x.doc_id = h.doc_id AND i >= h.n // 2 - 40 AND i < h.n // 2 + 40 GROUP BY h.doc_id, h.n""",
)
def join_levels(spark, d):
    joins = _recordings(spark, d).where("error IS NULL").select(
        "series_id", "path", "sample_rate", F.expr("n_samples div 2").alias("join_sample")
    )
    return rounded(
        media.join_levels(joins).select("series_id", "before_rms", "after_rms")
    )


@query(
    "pitch_adherence",
    f"""WITH {_energy_sql(FRAME)},
    fr AS (SELECT doc_id, k AS f, sqrt(avg(x * x)) AS rms FROM k GROUP BY 1, 2),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS nth FROM fr WHERE rms > 0.2),
    p AS (SELECT doc_id, f, 8000 / (150 + 100 * rms) AS ideal, f * 160 + 80 AS c FROM v WHERE nth % 5 = 0),
    a AS (SELECT doc_id, list(x ORDER BY i) AS xs FROM x GROUP BY 1),
    sp AS (SELECT p.*, list_slice(xs, greatest(c - 320, 0) + 1, least(c + 320, len(xs))) AS s FROM p JOIN a USING (doc_id)),
    st AS (SELECT *, len(s) AS n, list_avg(s) AS m, sqrt(list_dot_product(s, s) / len(s)) AS lev FROM sp WHERE len(s) >= 320),
    w AS (SELECT doc_id, f, ideal, n, lev, list_transform(s, lambda y, j: (y - m) * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / (n - 1)))) AS s FROM st),
    e AS (SELECT *, list_dot_product(s, s) AS en, greatest(round_even(ideal / pow(2, 100 / 1200.0::DOUBLE), 0), 1)::BIGINT AS lo,
      least(round_even(ideal * pow(2, 100 / 1200.0::DOUBLE), 0), n - 1)::BIGINT AS hi, round_even(ideal / 2, 0)::BIGINT AS o1, round_even(ideal * 2, 0)::BIGINT AS o2 FROM w),
    g AS (SELECT *, unnest(list_distinct(list_concat(range(lo, hi + 1), [o1, o2]))) AS lag FROM e WHERE lev >= 1e-5 AND en > 1e-12 AND hi > lo),
    m AS (SELECT doc_id, f, ideal, lo, hi, o1, o2, lag, list_dot_product(list_slice(s, 1, n - lag), list_slice(s, lag + 1, n)) / en AS r FROM g WHERE lag BETWEEN 1 AND n - 1),
    bl AS (SELECT doc_id, f, any_value(ideal) AS ideal, max(r) FILTER (lag BETWEEN lo AND hi) AS best, (list(lag ORDER BY r DESC, lag) FILTER (lag BETWEEN lo AND hi))[1] AS lag,
      max(r) FILTER (lag IN (o1, o2)) AS rival FROM m GROUP BY 1, 2),
    er AS (SELECT p.doc_id, CASE WHEN best IS NULL THEN 'infinity'::DOUBLE WHEN best < 0.12 OR coalesce(rival > best * 1.15, false) THEN 1200
      ELSE abs(log2(bl.ideal / lag)) * 1200 END AS err FROM p LEFT JOIN bl USING (doc_id, f)),
    q AS (SELECT doc_id, quantile_cont(err, 0.5) FILTER (err < 'infinity'::DOUBLE) AS md, avg((err > 200)::INT) AS gross FROM er GROUP BY 1)
    SELECT doc_id AS series_id, round(CASE WHEN gross IS NULL THEN 0 ELSE coalesce(md, 1200) END, 6) AS f0_median_error_cents,
      round(coalesce(gross, 0), 6) AS f0_gross_error_fraction FROM (SELECT DISTINCT doc_id FROM fr) LEFT JOIN q USING (doc_id)""",
)
def pitch_adherence(spark, d):
    recordings = pinned(_recordings(spark, d))
    frames = pinned(media.frame_energy(recordings)).select(
        "series_id",
        "frame_idx",
        F.when(F.col("rms") > 0.2, 150 + 100 * F.col("rms")).otherwise(F.lit(0.0)).alias("f0"),
    )
    return rounded(media.pitch_adherence(frames, recordings))


@query(
    "contours",
    """WITH l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM l)
    SELECT doc_id AS series_id, count(*) AS n_frames, sum(('0x' || p)::INT * (i % 97))::BIGINT AS checksum FROM x GROUP BY 1""",
)
def contours(spark, d):
    folder = _folder(spark, "contours")
    rows = table(spark, d, "documents").select(
        _name(".npy").alias("name"),
        F.col("text").alias("body"),
    )
    _export(rows, folder, _npy)
    files = media.discover_media(spark, folder, [".npy"]).select(
        F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("long").alias("series_id"), "path"
    )
    frames, _ = media.read_contours(files)
    return frames.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(F.col("f0").cast("long") * (F.col("frame_idx") % 97)).alias("checksum"),
    )


@query(
    "clean_contours",
    f"""WITH RECURSIVE {_energy_sql(FRAME)},
    raw AS (SELECT doc_id AS series_id, k AS frame_idx, CASE WHEN sqrt(avg(x * x)) > 0.3 THEN 400 * (sqrt(avg(x * x)) - 0.29) ELSE 0 END AS f0 FROM k GROUP BY 1, 2),
    {gap_fill_sql("raw", "filled", 6, 700)}, {spike_repair_sql("filled", "repaired", 100, 700)}
    SELECT series_id, frame_idx, round(f0, 6) AS f0 FROM repaired""",
)
def clean_contours(spark, d):
    frames = pinned(media.frame_energy(_recordings(spark, d))).select(
        "series_id",
        "frame_idx",
        F.when(F.col("rms") > 0.3, 400 * (F.col("rms") - 0.29)).otherwise(F.lit(0.0)).alias("f0"),
    )
    return rounded(clean_contour(frames))


@query(
    "stem_manifests",
    """SELECT s_suppkey::VARCHAR AS song_id, s_nationkey::VARCHAR AS artist_id, sha256(s_name) AS vocals_sha256, s_acctbal AS duration_seconds FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0""",
)
def stem_manifests(spark, d):
    folder = _folder(spark, "stems")
    key = F.col("s_suppkey")
    document = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"),
            F.when(key % 10 != 0, F.col("s_nationkey").cast("string")).alias("artist_id"),
            key.cast("string").alias("song_id"),
            F.struct(
                F.sha2("s_name", 256).alias("sha256"), F.col("s_acctbal").alias("duration_seconds")
            ).alias("vocals"),
        )
    )
    rows = table(spark, d, "supplier").select(
        F.concat(key.cast("string"), F.lit("/stems.json")).alias("name"),
        F.when(key % 9 == 0, F.substring(document, 1, 20)).otherwise(document).alias("body"),
    )
    _export(rows, folder, _text)
    good, _ = documents.read_stem_manifests(spark, f"{folder}/*/stems.json")
    return good.select(
        "song_id",
        "artist_id",
        F.col("vocals.sha256").alias("vocals_sha256"),
        F.col("vocals.duration_seconds").alias("duration_seconds"),
    )


@query(
    "policy_documents",
    """SELECT s_suppkey::VARCHAR AS artist_id, CASE WHEN s_suppkey % 4 = 0 THEN true ELSE s_suppkey % 3 = 0 END AS reject_live,
      CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE sha256(s_name) END AS sha256, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'kept out' END AS reason FROM supplier""",
)
def policy_documents(spark, d):
    folder = _folder(spark, "policies")
    key = F.col("s_suppkey")
    supplier = table(spark, d, "supplier")
    rows = supplier.where(key % 4 != 0).select(
        F.concat(key.cast("string"), F.lit("/dataset-policy.yaml")).alias("name"),
        F.format_string(
            "schema_version: 1\nartist_id: '%s'\nreject_live_voice_recordings: %s\n"
            "source_exclusions:\n- sha256: %s\n  filename: x.mp3\n  reason: kept out\n"
            "  excluded_at: 2024-01-01T00:00:00Z\n",
            key.cast("string"),
            F.when(key % 3 == 0, "true").otherwise("false"),
            F.sha2("s_name", 256),
        ).alias("body"),
    )
    _export(rows, folder, _text)
    artists = supplier.select(key.cast("string").alias("artist_id"))
    tables, _ = documents.read_policy(spark, f"{folder}/*/dataset-policy.yaml", artists)
    return tables["defaults"].join(
        tables["sources"].select("artist_id", "sha256", "reason"), "artist_id", "left"
    )


@query(
    "dataset_sink",
    """SELECT CASE WHEN l_returnflag = 'N' THEN 'validation' ELSE 'train' END AS split, l_suppkey AS song_id, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1, 2""",
)
def dataset_sink(spark, d):
    segments = table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "validation").otherwise("train").alias("split"),
        F.col("l_suppkey").alias("song_id"),
        F.col("l_orderkey").alias("start_frame"),
        "l_quantity",
    )
    path = _folder(spark, "dataset")
    sinks.write_dataset(segments, path)
    return spark.read.parquet(path).groupBy("split", "song_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("total")
    )


@query(
    "ingest_plan",
    """WITH t AS (SELECT doc_id, source, doc_id % 40 = 0 OR text = '' AS broken, sha256(text) || (doc_id % 40 = 0)::VARCHAR AS h FROM documents),
    r AS (SELECT *, source <> 'src3' AS ok, h IN (SELECT h FROM t WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS bad FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id::VARCHAR || '.wav') AS rn FROM r WHERE ok AND NOT bad)
    SELECT source AS artist_id, doc_id, CASE WHEN broken THEN 'unreadable' WHEN rn = 1 THEN 'imported' ELSE 'duplicate' END AS outcome FROM k
    UNION ALL SELECT source, doc_id, CASE WHEN NOT ok THEN 'not approved' ELSE 'toxic' END FROM r WHERE NOT ok OR bad""",
)
def ingest_plan(spark, d):
    """Every fortieth document is a file without a header, empty ones hold no samples."""
    folder = _export_wavs(spark, d)
    _export(_headless(spark, d), folder, _text)
    files = media.discover_media(spark, folder).select(_artist(), "path", "filename")
    rights, excluded, assets = _ingest_rules(spark, d, files)
    catalog = assets.limit(0).select(
        "artist_id", F.lit("").alias("song_id"), F.col("sha256").alias("source_sha256")
    )
    done = ingestion.ingest(files, rights, excluded, catalog, _imported_at(), assets=assets)
    return _outcomes(done.results.drop("song_id"), done.denials)


def _imported_at() -> Column:
    return F.lit("2024-06-01").cast("timestamp")


def _artist() -> Column:
    return F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("artist_id")


def _headless(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 40 = 0").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"),
        F.col("text").alias("body"),
    )


def _ingest_rules(spark, d, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rights (src3 is pending), exclusions of toxic contents, and the listed assets of each artist."""
    number = F.regexp_extract("filename", r"^([0-9]+)", 1).cast("long")
    hashed = pinned(media.hash_files(files.withColumn("doc_id", number)))
    toxic = hashed.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    excluded = (
        toxic.select("sha256").distinct()
        .join(hashed.select("artist_id", "sha256").distinct(), "sha256")
        .select("artist_id", "sha256", F.lit("").alias("filename"), F.lit("toxic").alias("reason"), F.lit(0).alias("pos"))
    )
    approved = F.when(F.col("artist_id") != "src3", "approved").otherwise("pending")
    # rights list an artist's assets in one document; here a row per asset carries the same
    assets = hashed.select("artist_id", "sha256").distinct()
    rights = assets.select("artist_id").distinct().select(
        "artist_id",
        approved.alias("status"),
        F.lit(None).cast("timestamp").alias("effective_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(1).alias("n_approvals"),
        F.lit(True).alias("training"),
    )
    return rights, excluded, assets


def _outcomes(results: DataFrame, denials: DataFrame, *more: str) -> DataFrame:
    number = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("doc_id")
    reason = F.col("denial_reason")
    known = reason.isin("not approved", "toxic", "by name", "not allow-listed")
    gate = F.when(known, reason).otherwise("unreadable").alias("outcome")
    return results.select("artist_id", number, F.col("status").alias("outcome"), *more).unionByName(
        denials.select("artist_id", number, gate), allowMissingColumns=True
    )


@query(
    "media_stream_ingest",
    """WITH t AS (SELECT doc_id, source, doc_id % 3 AS part, doc_id % 40 = 0 OR text = '' AS broken, sha256(text) || (doc_id % 40 = 0)::VARCHAR AS h,
      doc_id::VARCHAR || '.wav' AS name FROM documents),
    r AS (SELECT *, source <> 'src3' AS ok, doc_id % 50 = 7 AS named, doc_id % 11 = 5 AS unlisted,
      h IN (SELECT h FROM t WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS bad FROM t),
    l AS (SELECT *, NOT bool_and(unlisted) OVER (PARTITION BY source, h) AS listed FROM r),
    k AS (SELECT *, row_number() OVER w AS rn, first_value(name) OVER w AS f FROM l WHERE ok AND NOT bad AND NOT named AND listed
      WINDOW w AS (PARTITION BY source, h ORDER BY part, name)),
    q AS (SELECT k.*, w.digest FROM k JOIN (SELECT doc_id, sha256(unhex('52494646' || SIZE36 || '57415645666D74201000000001000100401F0000401F00000100080064617461' || SIZE) || b) AS digest
      FROM (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)) w USING (doc_id))
    SELECT source AS artist_id, doc_id, CASE WHEN broken THEN 'unreadable' WHEN rn = 1 THEN 'imported' ELSE 'duplicate' END AS outcome,
      CASE WHEN NOT broken THEN 'song-' || replace(f, '.wav', '') || '-' || substr(digest, 1, 8) END AS song_id,
      CASE WHEN NOT broken AND rn = 1 THEN octet_length(encode(text)) / 8000 END AS duration_seconds
    FROM q JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
    UNION ALL SELECT source, doc_id, CASE WHEN NOT ok THEN 'not approved' WHEN bad THEN 'toxic' WHEN named THEN 'by name' ELSE 'not allow-listed' END, NULL, NULL
    FROM l WHERE NOT ok OR bad OR named OR NOT listed""".replace("SIZE36", _hex32("(n + 36)")).replace("SIZE", _hex32("n")),
)
def media_stream_ingest(spark, d):
    """The same files arrive in three parts, each met by a stream that is started anew.

    Some are kept out by their name and some contents are on nobody's list.
    """
    source, folder = _export_wavs(spark, d), _folder(spark, "ingested")
    _export(_headless(spark, d), source, _text)
    files = media.discover_media(spark, source).select(_artist(), "path", "filename")
    rights, excluded, _ = _ingest_rules(spark, d, files)
    number = F.regexp_extract("filename", r"^([0-9]+)", 1).cast("long")
    named = files.where(number % 50 == 7).select(
        "artist_id", F.lit("").alias("sha256"), F.upper("filename").alias("filename"), F.lit("by name").alias("reason"), F.lit(1).alias("pos")
    )
    excluded = pinned(excluded.unionByName(named))
    assets = pinned(media.hash_files(files.where(number % 11 != 5)).select("artist_id", "sha256").distinct())
    at_first = f"{folder}/arrived"
    paths = pinned(files.withColumn("part", number % 3))
    for part in range(3):
        paths.where(F.col("part") == part).drop("part").write.mode("append").parquet(at_first)
        arrivals = spark.readStream.schema(paths.drop("part").schema).parquet(at_first)
        start_media_ingest(
            arrivals, f"{folder}/state", rights=rights, exclusions=excluded, at=_imported_at(), assets=assets
        ).awaitTermination()
    results, denials, catalog = (read_table(spark, f"{folder}/state", name) for name in TABLES)
    songs = catalog.select("artist_id", F.col("original_path").alias("path"), F.col("audio.duration_seconds").alias("duration_seconds"))
    return _outcomes(results.join(songs, ["artist_id", "path"], "left"), denials, "song_id", "duration_seconds")


@query(
    "curation_plan",
    f"""WITH {_energy_sql(4)},
    fr AS (SELECT doc_id, k, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM k GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN peak < 0.9 AND rms >= 0.12 THEN 400 * rms ELSE 0 END AS f0, count(*) OVER (PARTITION BY doc_id) AS n FROM fr),
    u AS (SELECT *, unnest(range(greatest((k - 500) // 250, 0), k // 250 + 1)) * 250 AS st FROM v WHERE n >= 750),
    w AS (SELECT * FROM u WHERE k >= st AND k < st + 750 AND st + 750 <= n),
    m AS (SELECT doc_id, st, avg((f0 > 0)::INT) AS vf, 20 * log10(greatest(sqrt(avg(rms * rms) FILTER (f0 > 0)), 1e-12)) AS act,
      20 * log10(max(peak)) AS pk, max(peak) AS mp FROM w GROUP BY 1, 2),
    sec AS (SELECT doc_id, st, (k - st) // 50 AS s, 20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12)) AS db FROM w GROUP BY ALL HAVING avg((f0 > 0)::INT) >= 0.2),
    rg AS (SELECT doc_id, st, quantile_cont(db, 0.95) - quantile_cont(db, 0.05) AS rng FROM sec GROUP BY 1, 2),
    isl AS (SELECT doc_id, st, k - row_number() OVER (PARTITION BY doc_id, st ORDER BY k) AS g FROM w WHERE f0 > 0),
    lr AS (SELECT doc_id, st, max(c) AS c FROM (SELECT doc_id, st, g, count(*) AS c FROM isl GROUP BY ALL) GROUP BY 1, 2),
    toxic AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE source = 'src3' OR doc_id % 19 = 3
      OR (doc_id % 3 > 0 AND doc_id % 23 = 1 AND source <> 'src5')),
    altered AS (SELECT doc_id, CASE WHEN doc_id % 31 = 2 THEN 2 ELSE (doc_id % 17 = 5)::INT + (doc_id % 29 = 7)::INT END AS n
      FROM documents WHERE (doc_id % 17 = 5 OR doc_id % 29 = 7 OR doc_id % 31 = 2) AND doc_id NOT IN (SELECT doc_id FROM toxic)),
    scr AS (SELECT doc_id, st, vf, act, rng FROM m JOIN rg USING (doc_id, st) JOIN lr USING (doc_id, st)
      WHERE vf BETWEEN 0.72 AND 0.98 AND rng <= 8 AND mp < 0.999 AND act >= -45 AND pk <= -0.1 AND c / 50 >= 1.2 AND st > 0 AND (st // 250) % 7 <= 3 AND doc_id NOT IN (SELECT doc_id FROM toxic) AND doc_id NOT IN (SELECT doc_id FROM altered)),
    top AS (SELECT doc_id, quantile_cont(act, 0.75) AS top FROM scr GROUP BY 1),
    c0 AS (SELECT doc_id AS series_id, st AS start_frame, abs(vf - 0.82) + rng / 20 + greatest(0, -35 - act) / 20 AS a, 0 AS b
      FROM scr JOIN top USING (doc_id) WHERE greatest(0, top - act) <= 6),
    {topk_sql(6, 500)}, cn AS (SELECT series_id, count(*) AS c FROM picked GROUP BY 1)
    SELECT doc_id::VARCHAR AS song_id, CASE WHEN c IS NULL THEN 0 WHEN c > 1 THEN c - 1 ELSE 1 END AS training_segments,
      (CASE WHEN c > 1 THEN 1 ELSE 0 END)::BIGINT AS validation_segments FROM documents LEFT JOIN cn ON series_id = doc_id
      WHERE doc_id NOT IN (SELECT doc_id FROM toxic) AND doc_id NOT IN (SELECT doc_id FROM altered)
    UNION ALL SELECT doc_id::VARCHAR, -1, -1 FROM documents WHERE doc_id IN (SELECT doc_id FROM toxic)
    UNION ALL SELECT doc_id::VARCHAR, -2, -n FROM altered""",
)
def curation_plan(spark, d):
    """The dataset build over the recordings: every document's text is a song of its source."""
    recordings = pinned(_recordings(spark, d).withColumn("n_frames", F.ceil(F.col("n_samples") / 4)))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    labels = table(spark, d, "labels")
    song = F.col("doc_id").cast("string")
    known = docs.withColumn("h", F.sha2(song, 256))
    # some files have changed since their manifest, some contours are missing, some manifests incomplete
    files = media.hash_files(recordings.select("series_id", "path").distinct())
    files = files.select(F.col("series_id").alias("doc_id"), "path", F.col("sha256").alias("written"))
    changed = F.when(F.col("doc_id") % 17 == 5, F.reverse("written")).otherwise(F.col("written"))
    contour = F.when(F.col("doc_id") % 29 == 7, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    whole = F.col("doc_id") % 31 != 2
    stems = known.join(files, "doc_id").select(
        F.col("source").alias("artist_id"),
        song.alias("song_id"),
        F.col("h").alias("source_sha256"),
        F.struct(F.col("h").alias("sha256")).alias("vocals"),
        F.struct(F.when(whole, F.col("path")).alias("path"), changed.alias("sha256"), F.col("h").alias("source_vocals_sha256")).alias("clean_vocals"),
        F.struct(contour.alias("path"), F.when(whole, F.col("written")).alias("sha256")).alias("f0"),
    )
    # every third stem has no catalog row
    catalog = docs.where("doc_id % 3 > 0").select(
        F.col("source").alias("artist_id"), song.alias("song_id"),
        F.when(F.col("doc_id") % 23 == 1, F.concat(F.lit("Live "), "lang")).otherwise(F.col("lang")).alias("title"),
        F.concat(song, F.lit(".wav")).alias("source_filename"),
    )
    toxic = known.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    policy = curation.Policy(
        sources=toxic.select(
            F.col("source").alias("artist_id"), F.col("h").alias("sha256"), F.lit("").alias("filename"), F.lit("toxic").alias("reason"),
            F.col("doc_id").alias("pos"),
        ),
        voice=known.where("doc_id % 19 in (3, 4)").select(
            F.col("source").alias("artist_id"), song.alias("song_id"), (F.col("doc_id") % 19 == 3).alias("exclude_entire_song"), F.lit("kept out").alias("reason")
        ),
        defaults=known.select(F.col("source").alias("artist_id"), (F.col("source") != "src5").alias("reject_live")).distinct(),
        intervals=known.select(F.col("source").alias("artist_id"), song.alias("song_id"), F.lit(0.0).alias("start_s"), F.lit(0.5).alias("end_s")),
    )

    def frames_of(passed: DataFrame) -> DataFrame:
        owners = passed.select("artist_id", F.col("song_id").cast("long").alias("series_id"))
        wanted = recordings.join(owners, "series_id", "left_semi")
        frames = media.frame_energy(wanted).join(owners, "series_id")
        return frames.select(
            "artist_id", F.col("series_id").cast("string").alias("song_id"), "frame_idx",
            F.when((F.col("peak") < 0.9) & (F.col("rms") >= 0.12), 400 * F.col("rms"))
            .otherwise(F.lit(0.0))
            .alias("f0"),
            "rms", "peak", "clipped_n", "n", "mid_sq", "side_sq", "channels",
        )

    # recordings of 8 kHz have no high band; their place stands in for it
    def bands(windows: DataFrame) -> DataFrame:
        step = F.expr("start_frame div 250") % 7
        return windows.withColumn("high_band_ratio_db", (-20 - 5 * step).cast("double"))

    rights = docs.select(F.col("source").alias("artist_id")).distinct().select(
        "artist_id",
        F.lit("approved").alias("status"),
        F.lit(None).cast("timestamp").alias("effective_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(1).alias("n_approvals"),
        F.lit(True).alias("training"),
        (F.col("artist_id") != "src3").alias("singing_voice"),
    )
    allowed = known.select(F.col("source").alias("artist_id"), F.col("h").alias("sha256"))
    at = F.lit("2024-06-01").cast("timestamp")
    built = curation.curate(
        stems, catalog, policy, allowed, frames_of, rights=rights, at=at, bands=bands
    )
    return rounded(
        built.sources.select("song_id", "training_segments", "validation_segments").unionByName(
            built.excluded.select(
                F.col("song_id"),
                F.lit(-1).cast("long").alias("training_segments"),
                F.lit(-1).cast("long").alias("validation_segments"),
            )
        ).unionByName(
            built.violations.where(F.col("violation").isin("changed file", "missing file", "incomplete")).groupBy("song_id").agg(
                F.lit(-2).cast("long").alias("training_segments"), (-F.count(F.lit(1))).alias("validation_segments")
            )
        )
    )


OPEN_ROLES = ("strong", "neutral", "high")


def _bank_steps() -> str:
    """Each open role takes the best excerpt of a song that no role before it took, or of any."""
    steps = []
    for n, role in enumerate(OPEN_ROLES):
        used = " OR ".join(f"song_id = (SELECT song_id FROM c{i})" for i in range(n)) or "song_id IS NULL"
        steps.append(f"c{n} AS (SELECT '{role}' AS role, song_id, begins, {role} AS score FROM sc ORDER BY ({used}), {role}, song_id, begins LIMIT 1)")
    return ", ".join(steps)


@query(
    "bank_plan",
    f"""WITH {_energy_sql(4)},
    fr AS (SELECT doc_id, k, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM k GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN rms < 0.45 THEN 400 * rms ELSE 0 END AS f0, count(*) OVER (PARTITION BY doc_id) AS n FROM fr
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    u AS (SELECT *, unnest(range(greatest((k - 650) // 100, 0), k // 100 + 1)) * 100 AS st FROM v WHERE n >= 750),
    w AS (SELECT * FROM u WHERE k >= st AND k < st + 750 AND st + 750 <= n),
    m AS (SELECT doc_id, st, avg((f0 > 0)::INT) AS vf, 20 * log10(greatest(sqrt(avg(rms * rms) FILTER (f0 > 0)), 1e-12)) AS act,
      quantile_cont(f0, 0.5) FILTER (f0 > 0) AS med, max(peak) AS mp FROM w GROUP BY 1, 2),
    sec AS (SELECT doc_id, st, (k - st) // 50 AS s, 20 * log10(greatest(sqrt(avg(rms * rms)), 1e-12)) AS db FROM w GROUP BY ALL HAVING avg((f0 > 0)::INT) >= 0.2),
    rg AS (SELECT doc_id, st, quantile_cont(db, 0.95) - quantile_cont(db, 0.05) AS rng FROM sec GROUP BY 1, 2),
    cd AS (SELECT doc_id::VARCHAR AS song_id, st / 50 AS begins, vf, act, med, rng FROM m JOIN rg USING (doc_id, st)
      WHERE vf BETWEEN 0.70 AND 0.95 AND rng <= 6 AND mp < 0.999 AND act >= -40 AND st > 0),
    bd AS (SELECT min(med) AS p0, max(med) AS p1, min(act) AS l0, max(act) AS l1 FROM cd),
    pl AS (SELECT song_id, begins, (med - p0) / greatest(p1 - p0, 1e-6) AS p, (act - l0) / greatest(l1 - l0, 1e-6) AS l, 0.2 * (abs(vf - 0.85) + rng / 12) AS q FROM cd, bd),
    sc AS (SELECT song_id, begins, abs(p - 0.5) + abs(l - 0.5) + q AS neutral, 1 - l + 0.5 * abs(p - 0.5) + q AS strong, 1 - p + 0.25 * abs(l - 0.5) + q AS high FROM pl),
    {_bank_steps()}
    SELECT role, song_id, begins::DOUBLE AS start_seconds, round(score, 6) AS score, (SELECT count(*) FROM cd) AS n_candidates
    FROM ({" UNION ALL ".join(f"SELECT * FROM c{n}" for n in range(len(OPEN_ROLES)))})""",
)
def bank_plan(spark, d):
    """From recordings to the excerpts that fill a bank's open roles; excluded songs are never decoded."""
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("series_id"))
    recordings = _recordings(spark, d).where("error IS NULL").join(toxic, "series_id", "left_anti")
    frames = media.frame_energy(recordings.withColumn("n_frames", F.ceil(F.col("n_samples") / 4)))
    frames = pinned(
        frames.withColumn("song_id", F.col("series_id").cast("string"))
        .withColumn("f0", F.when(F.col("rms") < 0.45, 400 * F.col("rms")).otherwise(F.lit(0.0)))
        .drop("series_id", "sum_sq")
    )
    songs = frames.select("song_id").distinct()
    nothing = songs.limit(0)
    policy = curation.Policy(
        sources=nothing, voice=nothing, intervals=songs.select("song_id", F.lit(0.0).alias("start_s"), F.lit(0.5).alias("end_s"))
    )
    candidates = pinned(curation.bank_candidates(frames, policy))
    filled = curation.fill_bank(candidates, list(OPEN_ROLES))
    return rounded(filled).withColumn("n_candidates", F.lit(candidates.count()).cast("long"))
