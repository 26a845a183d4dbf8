"""Media files as tables: discovery, hashes, headers and frame energies.

Audio is decoded on the executors in ranges of samples, so neither a file's size nor its
length has to fit a task. Only per-frame sums leave the decoder, never samples.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgate.functions.quantiles import exact_quantiles
from reelgate.functions.scalars import common_codec
from reelgate.operators.scan import Running, chunk_frames, home_chunk, ordered_scan
from reelgate.session import pinned, spread

# The suffixes of supported recordings.
SUFFIXES = (".aac", ".aiff", ".alac", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav")
CLIPPED = 0.999
_BLOCK = 1024 * 1024


def discover_media(
    spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, content: bool = False
) -> DataFrame:
    """Files below ``root`` with a supported suffix; bytes are read only when asked for.

    ``root`` is a folder, a file or a pattern of either. Folders are listed level by level on the
    executors, and the listing is a stored step: the driver holds a row per match of ``root``, never
    the files below it. Empty and hidden files are files; what is neither file nor folder is not.
    """
    endings = tuple(f".{s.lstrip('.')}" for s in suffixes)

    def wanted(path: str) -> bool:
        return path.lower().endswith(endings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf["path"]:
                found = (e for e in _entries(folder) if e[3] or wanted(e[0]))
                while held := list(islice(found, _ENTRIES)):
                    yield pd.DataFrame(held, columns=["path", "length", "modified", "is_folder"])

    schema = "path string, length bigint, modified bigint, is_folder boolean"
    start = [e for e in _matches(spark, root) if e[3] or wanted(e[0])]
    levels = [spark.createDataFrame(start, schema).coalesce(1)]
    folders = sum(e[3] for e in start)
    while folders:
        below = levels[-1].where("is_folder").select("path")
        # the first folders are few rows of the driver's, and so one task or few
        below = below if len(levels) == 1 and folders == 1 else spread(below, "path")
        levels.append(pinned(below.mapInPandas(run, schema)))
        folders = levels[-1].where("is_folder").count()
    files = reduce(DataFrame.unionByName, levels).where("NOT is_folder")
    named = files.select(
        "path",
        "length",
        F.timestamp_millis("modified").alias("modificationTime"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
    )
    return _with_content(named) if content else named


#: Entries of a folder that a task holds at a time.
_ENTRIES = 10_000


def _matches(spark: SparkSession, root: str) -> list[tuple[str, int, int, bool]]:
    """What ``root`` names, as the cluster's own file system tells."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"nothing to discover: {root}")
    return [
        (s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in found
    ]


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """Files and folders right below a folder (path, length, milliseconds, folder or not), as they come."""
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    if folder.startswith("/"):
        try:
            with os.scandir(folder) as inside:
                for entry in inside:
                    is_folder = entry.is_dir()
                    if is_folder or entry.is_file():
                        known = entry.stat()
                        yield f"file:{entry.path}", known.st_size, known.st_mtime_ns // 1_000_000, is_folder
        except FileNotFoundError:
            return  # gone since it was listed itself
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    before = folder[: len(folder) - len(inner)]
    for entry in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if entry.type in (fs.FileType.File, fs.FileType.Directory):
            is_folder = entry.type == fs.FileType.Directory
            yield before + entry.path, entry.size or 0, (entry.mtime_ns or 0) // 1_000_000, is_folder


def _with_content(files: DataFrame) -> DataFrame:
    """Whole files as a column, each read by itself."""
    schema = files.withColumn("content", F.lit(b"")).select("path", "length", "modificationTime", "content", "filename").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(len(pdf)):
                one = pdf.iloc[at : at + 1]
                with _open(one["path"].iloc[0]) as stream:
                    yield one.assign(content=[stream.read()])

    return spread(files, "path").mapInPandas(run, schema)


def in_path_order(files: DataFrame) -> DataFrame:
    """The stable order of a final listing."""
    return files.orderBy(F.lower("path"), "path")


def _open(path: str):
    """Open a path of any file system pyarrow knows, on the executor."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def hash_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``sha256`` of whole files of any size, read in blocks; null and ``error`` if unreadable.

    Where file contents are already a column, ``sha2(content, 256)`` gives the same.
    """
    schema = files.withColumn("sha256", F.lit("")).withColumn("error", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            digests, errors = [], []
            for p in pdf[path]:
                try:
                    digest = hashlib.sha256()
                    with _open(p) as stream:
                        while block := stream.read(_BLOCK):
                            digest.update(block)
                    digests.append(digest.hexdigest())
                    errors.append(None)
                except Exception as problem:  # a bad file becomes a row, not a failed job
                    digests.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pdf.assign(sha256=digests, error=errors)

    return spread(files, path).mapInPandas(run, _nullable(schema))


def _nullable(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


#: Codec by format tag (1 whole numbers, 3 floating point) and bytes of a sample (fixed values).
_CODECS = {
    (1, 1): "pcm_u8",
    (1, 2): "pcm_s16le",
    (1, 3): "pcm_s24le",
    (1, 4): "pcm_s32le",
    (3, 4): "pcm_f32le",
    (3, 8): "pcm_f64le",
}
_EXTENSIBLE = 0xFFFE
#: A size that a 32-bit field cannot hold; the ``ds64`` chunk has it.
_ELSEWHERE = 0xFFFFFFFF


@dataclass(frozen=True)
class WavLayout:
    """Where the samples of a WAV file lie and how they are written."""

    tag: int
    width: int
    channels: int
    rate: int
    offset: int
    n_samples: int

    @property
    def codec(self) -> str:
        return _CODECS[self.tag, self.width]


def wav_layout(stream) -> WavLayout:
    """Walk the chunks of a RIFF or RF64 file up to its samples; an odd chunk has a byte of padding."""
    riff = stream.read(12)
    if len(riff) < 12 or riff[:4] not in (b"RIFF", b"RF64") or riff[8:] != b"WAVE":
        raise ValueError("no WAVE header")
    at, end = 12, stream.size()
    form = long_size = None
    while at + 8 <= end:
        stream.seek(at)
        name, size = struct.unpack("<4sI", stream.read(8))
        at += 8
        if name == b"ds64":
            long_size = struct.unpack("<QQ", stream.read(16))[1]
        elif name == b"fmt ":
            form = stream.read(min(size, 40))
        elif name == b"data":
            break
        at += size + size % 2
    else:
        raise ValueError("no data chunk")
    if form is None or len(form) < 16:
        raise ValueError("no format before the samples")
    tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == _EXTENSIBLE:
        if len(form) < 26:
            raise ValueError("short extensible format")
        # the sub-format begins with the tag that an ordinary header would have
        tag = struct.unpack("<H", form[24:26])[0]
    width = (bits + 7) // 8
    if (tag, width) not in _CODECS:
        raise ValueError(f"unsupported samples: tag {tag}, {bits} bits")
    if channels < 1 or rate < 1 or block != channels * width:
        raise ValueError("inconsistent format")
    if size == _ELSEWHERE and long_size is not None:
        size = long_size
    # a recorder that was cut off leaves a size beyond the end of its file
    return WavLayout(tag, width, channels, rate, at, min(size, end - at) // block)


def probe_media(files: DataFrame, path: str = "path") -> DataFrame:
    """Add duration_seconds, n_samples, sample_rate, channels, codec, format_name, error.

    Reads headers only. WAV of whole numbers and of floating point, plain and extensible, is
    understood; other formats are quarantined through ``error``.
    """
    base = _nullable(files.schema)
    schema = (
        f"{base}, duration_seconds double, n_samples bigint, sample_rate int, channels int, "
        "codec string, format_name string, error string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf[path]:
                try:
                    with _open(p) as stream:
                        form = wav_layout(stream)
                    n, rate = form.n_samples, form.rate
                    if n <= 0:
                        raise ValueError("no decodable samples")
                    rows.append((n / rate, n, rate, form.channels, form.codec, "WAV", None))
                except Exception as problem:
                    message = f"{type(problem).__name__}: {problem}"
                    rows.append((None, None, None, None, None, None, message))
            names = [
                "duration_seconds",
                "n_samples",
                "sample_rate",
                "channels",
                "codec",
                "format_name",
                "error",
            ]
            found = pd.DataFrame(rows, columns=names, index=pdf.index)
            for c in ("n_samples", "sample_rate", "channels"):
                found[c] = found[c].astype("Int64")
            yield pd.concat([pdf, found], axis=1)

    return spread(files, path).mapInPandas(run, schema).withColumn("codec", common_codec("codec"))


def inventory(files: DataFrame, allowed: DataFrame, sha256: str = "sha256") -> DataFrame:
    """Hashed files with ``is_authorized``; nothing is imported."""
    known = allowed.select(F.col("sha256").alias("__a")).distinct()
    return (
        files.join(known, F.col(sha256) == F.col("__a"), "left")
        .withColumn("is_authorized", F.col("__a").isNotNull())
        .drop("__a")
    )


def read_samples(path: str, start: int, stop: int) -> np.ndarray:
    """Samples start..stop of a WAV file as float32, one column per channel; whole numbers in [-1, 1)."""
    with _open(path) as stream:
        form = wav_layout(stream)
        start, stop = max(start, 0), min(stop, form.n_samples)
        if stop <= start:
            return np.zeros((0, form.channels), dtype=np.float32)
        block = form.channels * form.width
        stream.seek(form.offset + start * block)
        raw = stream.read((stop - start) * block)
    if form.tag == 3:
        values = np.frombuffer(raw, f"<f{form.width}")
    elif form.width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif form.width == 2:
        values = np.frombuffer(raw, "<i2") / 32768.0
    elif form.width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        signed = (parts[:, 0] | (parts[:, 1] << 8) | (parts[:, 2] << 16)) << 8
        values = (signed >> 8) / 8388608.0
    else:
        values = np.frombuffer(raw, "<i4") / 2147483648.0
    return values.astype(np.float32).reshape(-1, form.channels)


def _ranges(recordings: DataFrame, units: str, per_task: int) -> DataFrame:
    """Cut every recording into ranges of units and spread the ranges over the cluster."""
    first = F.sequence(
        F.lit(0).cast("long"), F.col(units).cast("long") - 1, F.lit(per_task).cast("long")
    )
    cut = recordings.where(F.col(units) > 0).withColumn("__first", F.explode(first))
    stop = F.least(F.col("__first") + per_task, F.col(units).cast("long"))
    return spread(cut.withColumn("__stop", stop), "path", "__first")


def frame_energy(
    recordings: DataFrame, frames: str = "n_frames", per_task: int = 6_000
) -> DataFrame:
    """Per-frame sums of each recording, aligned with its contour of ``frames`` frames.

    ``recordings``: series_id, path, n_samples, channels and the frame count. Frame i covers
    the samples from rint(i * N / F) up to rint((i + 1) * N / F), halves to even; level, peak and
    clipping are those of the mono mix.
    """
    wanted = recordings.select("series_id", "path", "n_samples", F.col(frames).alias("__units"))
    ids = dict(wanted.dtypes)["series_id"]
    schema = (
        f"series_id {ids}, frame_idx bigint, n bigint, sum_sq double, rms double, peak double, "
        "clipped_n bigint, mid_sq double, side_sq double, channels int"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _batched(map(one, pdf.itertuples(index=False)))

    def one(row) -> dict[str, np.ndarray]:
        first, stop = int(row[4]), int(row[5])
        edges = np.rint(np.arange(first, stop + 1) * (row.n_samples / row[3])).astype(np.int64)
        if stop == row[3]:
            edges[-1] = row.n_samples
        audio = read_samples(row.path, int(edges[0]), int(edges[-1]))
        return _frame_sums(row.series_id, first, audio, edges - edges[0])

    return _ranges(wanted, "__units", per_task).mapInPandas(run, schema)


def _batched(parts: Iterator[dict], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Join the columns of many short recordings into frames of a useful size."""
    held: list[dict] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part["frame_idx"])
        if size >= rows:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[dict]) -> pd.DataFrame:
    counts = [len(p["frame_idx"]) for p in parts]
    return pd.DataFrame(
        {
            name: np.repeat([p[name] for p in parts], counts)
            if np.isscalar(parts[0][name])
            else np.concatenate([p[name] for p in parts])
            for name in parts[0]
        }
    )


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def _frame_sums(series_id, first: int, audio: np.ndarray, edges: np.ndarray) -> dict:
    mono = audio.mean(axis=1, dtype=np.float32) if len(audio) else np.zeros(0, np.float32)
    n = np.diff(edges)
    filled = n > 0
    energy = np.zeros(len(n))
    peak = np.zeros(len(n))
    clipped = np.zeros(len(n), np.int64)
    mid = np.zeros(len(n))
    side = np.zeros(len(n))
    if filled.any():
        at = edges[:-1][filled]
        square = np.square(mono, dtype=np.float64)
        energy[filled] = np.add.reduceat(square, at)
        peak[filled] = np.maximum.reduceat(np.abs(mono), at)
        clipped[filled] = np.add.reduceat((np.abs(mono) >= CLIPPED).astype(np.int64), at)
        if audio.shape[1] >= 2:
            left, right = audio[:, 0].astype(np.float64), audio[:, 1].astype(np.float64)
            mid[filled] = np.add.reduceat(np.square(0.5 * (left + right)), at)
            side[filled] = np.add.reduceat(np.square(0.5 * (left - right)), at)
        else:
            mid[filled] = energy[filled]
    return {
        "series_id": series_id,
        "frame_idx": np.arange(first, first + len(n)),
        "n": n,
        "sum_sq": energy,
        "rms": np.sqrt(energy / np.maximum(n, 1)),
        "peak": peak,
        "clipped_n": clipped,
        "mid_sq": mid,
        "side_sq": side,
        "channels": audio.shape[1],
    }


def fixed_frames(recordings: DataFrame, length: int = 2048, per_task: int = 4_096) -> DataFrame:
    """Energy of consecutive frames of ``length`` samples; the last may be partial."""
    wanted = recordings.select("series_id", "path", "n_samples").withColumn(
        "__units", F.ceil(F.col("n_samples") / length)
    )
    schema = f"series_id {dict(wanted.dtypes)['series_id']}, frame_idx bigint, n bigint, sum_sq double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _batched(map(one, pdf.itertuples(index=False)))

    def one(row) -> dict[str, np.ndarray]:
        first, stop = int(row[4]), int(row[5])
        audio = read_samples(row.path, first * length, stop * length)
        mono = audio.mean(axis=1, dtype=np.float32)
        edges = np.minimum(np.arange(stop - first + 1) * length, len(mono))
        return {
            "series_id": row.series_id,
            "frame_idx": np.arange(first, stop),
            "n": np.diff(edges),
            "sum_sq": _sums(np.square(mono, dtype=np.float64), edges),
        }

    return _ranges(wanted, "__units", per_task).mapInPandas(run, schema)


def overlapped_energy(
    recordings: DataFrame, frame_s: float = 0.046, hop_s: float = 0.012, per_task: int = 8_192
) -> DataFrame:
    """Levels of overlapping frames and of their sample differences, by prefix sums; none without samples."""
    rate = F.col("sample_rate")
    length = F.greatest(F.rint(rate * frame_s), F.lit(32)).cast("long")
    hop = F.greatest(F.rint(rate * hop_s), F.lit(8)).cast("long")
    wanted = (
        recordings.where(F.col("n_samples") > 0)
        .select("series_id", "path", "n_samples", length.alias("__len"), hop.alias("__hop"))
        .withColumn("__units", F.ceil(F.greatest(F.col("n_samples") - F.col("__len") + 1, F.lit(1)) / F.col("__hop")))
    )
    schema = (
        f"series_id {dict(wanted.dtypes)['series_id']}, frame_idx bigint, rms double, "
        "detail_rms double"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _batched(map(one, pdf.itertuples(index=False)))

    def one(row) -> dict[str, np.ndarray]:
        size, step, first, stop = int(row[3]), int(row[4]), int(row[6]), int(row[7])
        begin = first * step
        lead = 1 if begin > 0 else 0
        audio = read_samples(row.path, begin - lead, (stop - 1) * step + size)
        mono = audio.mean(axis=1, dtype=np.float32)
        change = np.diff(mono, prepend=mono[:1])[lead:]
        mono = mono[lead:]
        starts = np.arange(stop - first) * step
        ends = np.minimum(starts + size, len(mono))
        width = np.maximum(ends - starts, 1)
        levels = []
        for values in (mono, change):
            total = np.concatenate([[0.0], np.cumsum(np.square(values, dtype=np.float64))])
            levels.append(np.sqrt(np.maximum((total[ends] - total[starts]) / width, 0.0)))
        return {
            "series_id": row.series_id,
            "frame_idx": np.arange(first, stop),
            "rms": levels[0],
            "detail_rms": levels[1],
        }

    return _ranges(wanted, "__units", per_task).mapInPandas(run, schema)


#: Bounds of the two bands in hertz, and their decibel range (fixed values).
BODY_HERTZ, BRIGHT_HERTZ, RATIO_DB = 100, 5000, (-120.0, 60.0)
BAND_SECONDS = 3


def band_ratios(excerpts: Sequence[np.ndarray], rates: Sequence[int], clipped: bool = True) -> np.ndarray:
    """Energy from 5 kHz up against 100-5000 Hz in the first three seconds, in decibels.

    Excerpts of one rate and length are the rows of one matrix, transformed at once; both
    band energies are one product of their power spectra with the bands' membership.
    """
    ratios = np.full(len(excerpts), RATIO_DB[0])
    shapes: dict[tuple[int, int], list[int]] = {}
    for number, (samples, rate) in enumerate(zip(excerpts, rates, strict=True)):
        shapes.setdefault((rate, min(len(samples), BAND_SECONDS * rate)), []).append(number)
    for (rate, length), members in shapes.items():
        if length < 2:
            continue
        matrix = np.stack([np.asarray(excerpts[m][:length], dtype=np.float64) for m in members])
        spectra = np.fft.rfft(matrix * np.hanning(length), axis=1)
        hertz = np.arange(spectra.shape[1]) * (rate / length)
        bands = np.stack([hertz >= BRIGHT_HERTZ, (hertz >= BODY_HERTZ) & (hertz < BRIGHT_HERTZ)], axis=1)
        energy = np.maximum((spectra.real**2 + spectra.imag**2) @ bands.astype(np.float64), 1e-20)
        ratios[members] = 10 * (np.log10(energy[:, 0]) - np.log10(energy[:, 1]))
    return np.clip(ratios, *RATIO_DB) if clipped else ratios


def band_ratio(excerpts: DataFrame, clipped: bool = True) -> DataFrame:
    """Add ``high_band_ratio_db`` to excerpts (path, sample_rate, start_sample, end_sample)."""
    schema = f"{_nullable(excerpts.schema)}, high_band_ratio_db double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rates = [int(r) for r in pdf["sample_rate"]]
            audio = [
                read_samples(p, int(a), min(int(b), int(a) + BAND_SECONDS * rate)).mean(axis=1, dtype=np.float32)
                for p, rate, a, b in zip(pdf["path"], rates, pdf["start_sample"], pdf["end_sample"], strict=True)
            ]
            ratios = band_ratios(audio, rates, clipped)
            yield pdf.assign(high_band_ratio_db=ratios)

    return spread(excerpts, "path", "start_sample").mapInPandas(run, schema)


def join_levels(joins: DataFrame, window_s: float = 0.005) -> DataFrame:
    """Add ``before_rms`` and ``after_rms``: the level 5 ms either side of a join.

    ``joins``: path, sample_rate, join_sample. Null where a side leaves the recording, and where
    rate or place are unknown, as they are of a file that could not be probed.
    """
    schema = f"{_nullable(joins.schema)}, before_rms double, after_rms double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            before, after = [], []
            for p, rate, at in zip(
                pdf["path"], pdf["sample_rate"], pdf["join_sample"], strict=True
            ):
                if pd.isna(rate) or pd.isna(at):
                    before.append(None)
                    after.append(None)
                    continue
                reach = max(1, round(window_s * rate))
                audio = read_samples(p, int(at) - reach, int(at) + reach)
                mono = audio.mean(axis=1, dtype=np.float32).astype(np.float64)
                whole = at >= reach and len(mono) == 2 * reach
                before.append(float(np.sqrt(np.mean(mono[:reach] ** 2))) if whole else None)
                after.append(float(np.sqrt(np.mean(mono[reach:] ** 2))) if whole else None)
            yield pdf.assign(before_rms=before, after_rms=after)

    return spread(joins, "path", "join_sample").mapInPandas(run, schema)


#: Limits of the pitch check (fixed values): search reach either way in cents, least level and energy,
#: least correlation, and how far an octave may exceed it before the pitch counts as an octave off.
REACH_CENTS, LEAST_LEVEL, LEAST_ENERGY, LEAST_MATCH, OCTAVE_MARGIN = 100, 1e-5, 1e-12, 0.12, 1.15
OFF_CENTS = 1200.0


def pitch_errors(mono: np.ndarray, begins: np.ndarray, ends: np.ndarray, rate: int, pitches: np.ndarray, least: int) -> np.ndarray:
    """Cents between each pitch and the best lag of the audio span around it; inf where unmeasurable.

    A span's normalised correlation at a lag is a dot product of the span with itself shifted. Only
    lags within reach of some pitch, and its octaves, are looked at: per lag, one row-wise
    product over all spans of equal length that ask for it.
    """
    errors = np.full(len(pitches), np.inf)
    ideal = rate / pitches
    factor = 2 ** (REACH_CENTS / 1200)
    lengths = ends - begins
    for length in np.unique(lengths[lengths >= max(least, 2)]):
        rows = np.flatnonzero(lengths == length)
        spans = mono[begins[rows][:, None] + np.arange(length)]
        loud = np.sqrt((spans**2).mean(axis=1)) >= LEAST_LEVEL
        spans = (spans - spans.mean(axis=1, keepdims=True)) * np.hanning(length)
        energy = np.einsum("ij,ij->i", spans, spans)
        low = np.maximum(np.rint(ideal[rows] / factor), 1).astype(int)
        high = np.minimum(np.rint(ideal[rows] * factor), length - 1).astype(int)
        usable = loud & (energy > LEAST_ENERGY) & (high > low)
        rows, spans, energy, low, high = (x[usable] for x in (rows, spans, energy, low, high))
        if not len(rows):
            continue
        octaves = np.rint(np.stack([ideal[rows] * 0.5, ideal[rows] * 2.0])).astype(int)
        best = np.full(len(rows), -np.inf)
        rival = np.full(len(rows), -np.inf)
        lag_of = low.copy()
        asked = np.zeros(length, dtype=bool)
        for a, b in zip(low, high, strict=True):
            asked[a : b + 1] = True
        asked[octaves[(octaves >= 1) & (octaves < length)]] = True
        for lag in np.flatnonzero(asked):
            inside = (low <= lag) & (lag <= high)
            beside = (octaves == lag).any(axis=0)
            at = np.flatnonzero(inside | beside)
            match = np.einsum("ij,ij->i", spans[at, : length - lag], spans[at, lag:]) / energy[at]
            rival[at] = np.where(beside[at], np.maximum(rival[at], match), rival[at])
            better = inside[at] & (match > best[at])
            best[at[better]], lag_of[at[better]] = match[better], lag
        off = (best < LEAST_MATCH) | (rival > best * OCTAVE_MARGIN)
        cents = np.abs(np.log2(ideal[rows] / lag_of)) * 1200
        errors[rows] = np.where(off, OFF_CENTS, cents)
    return errors


def pitch_adherence(
    frames: DataFrame, recordings: DataFrame, rate: int = 50, every: int = 5
) -> DataFrame:
    """Median error and gross share of every fifth voiced frame against the audio itself.

    ``frames``: series_id, frame_idx, f0; ``recordings``: series_id, path, sample_rate.
    """
    voiced = frames.select("series_id", "frame_idx", F.col("f0").cast("double").alias("f0")).where(
        F.col("f0") > 0
    )
    numbered = ordered_scan(
        voiced,
        ["series_id"],
        ["frame_idx"],
        {"__nth": Running("ordinal")},
        chunk=home_chunk(frames),
    )
    probes = (
        numbered.where(F.col("__nth") % every == 0)
        .drop("__nth")
        .join(recordings.select("series_id", "path", "sample_rate"), "series_id")
        .withColumn("__part", F.expr(f"frame_idx div {min(chunk_frames(frames), 3_000)}"))
    )
    schema = f"{_nullable(probes.schema)}, error_cents double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (path, sr, _), part in pdf.groupby(["path", "sample_rate", "__part"], sort=False):
                half = round(0.04 * sr)
                centres = np.rint((part["frame_idx"].to_numpy() + 0.5) * sr / rate).astype(np.int64)
                base = max(0, int(centres.min()) - half)
                audio = read_samples(path, base, int(centres.max()) + half)
                mono = audio.mean(axis=1, dtype=np.float32).astype(np.float64)
                begins = np.clip(centres - half - base, 0, len(mono))
                ends = np.clip(centres + half - base, begins, len(mono))
                errors = pitch_errors(mono, begins, ends, int(sr), part["f0"].to_numpy(), half)
                yield part.assign(error_cents=errors)

    measured = pinned(
        spread(probes, "path", "__part")
        .sortWithinPartitions("path", "__part", "frame_idx")
        .mapInPandas(run, schema)
        .select("series_id", "error_cents")
    )
    measurable = F.when(F.col("error_cents") < float("inf"), F.col("error_cents"))
    gross = F.avg((F.col("error_cents") > 200).cast("double"))
    found = exact_quantiles(
        measured, ["series_id"], measurable, {"__m": 0.5}, extras={"__gross": gross}
    )
    return (
        frames.select("series_id")
        .distinct()
        .join(found, "series_id", "left")
        .select(
            "series_id",
            F.when(F.col("__gross").isNull(), F.lit(0.0))
            .otherwise(F.coalesce("__m", F.lit(1200.0)))
            .alias("f0_median_error_cents"),
            F.coalesce("__gross", F.lit(0.0)).alias("f0_gross_error_fraction"),
        )
    )


def read_contours(files: DataFrame, per_task: int = 262_144) -> tuple[DataFrame, DataFrame]:
    """Pitch contours (.npy) as frames (series_id, frame_idx, f0), and the unusable files.

    ``files``: series_id, path. Headers are read first, then ranges of values.
    """
    ids = dict(files.dtypes)["series_id"]
    head_schema = f"series_id {ids}, path string, n_frames bigint, error string"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for series_id, path in zip(pdf["series_id"], pdf["path"], strict=True):
                try:
                    _, shape, _ = _npy_header(path)
                    n = int(np.prod(shape))
                    rows.append((series_id, path, n, None if n else "empty contour"))
                except Exception as problem:
                    rows.append((series_id, path, 0, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["series_id", "path", "n_frames", "error"])

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _batched(map(one, pdf.itertuples(index=False)))

    def one(row) -> dict[str, np.ndarray]:
        first, stop = int(row[4]), int(row[5])
        dtype, _, offset = _npy_header(row.path)
        with _open(row.path) as stream:
            stream.seek(offset + first * dtype.itemsize)
            raw = stream.read((stop - first) * dtype.itemsize)
        f0 = np.frombuffer(raw, dtype).astype(np.float32).astype(np.float64)
        return {"series_id": row.series_id, "frame_idx": np.arange(first, stop), "f0": f0}

    known = spread(files.select("series_id", "path"), "path").mapInPandas(heads, head_schema)
    frames = _ranges(known.where(F.col("error").isNull()), "n_frames", per_task).mapInPandas(
        values, f"series_id {ids}, frame_idx bigint, f0 double"
    )
    unreadable = known.where(F.col("error").isNotNull()).select(
        "series_id", F.col("error").alias("violation")
    )
    silent = (
        frames.groupBy("series_id")
        .agg(F.max(F.coalesce(F.col("f0") > 0, F.lit(False)) & ~F.isnan("f0")).alias("__any"))
        .where(~F.col("__any"))
        .select("series_id", F.lit("no voiced frame").alias("violation"))
    )
    return frames, unreadable.unionByName(silent)


def _npy_header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    with _open(path) as stream:
        version = np.lib.format.read_magic(stream)
        read = (
            np.lib.format.read_array_header_1_0
            if version == (1, 0)
            else np.lib.format.read_array_header_2_0
        )
        shape, fortran, dtype = read(stream)
        if dtype.hasobject or (fortran and len(shape) > 1):
            raise ValueError("unsupported contour layout")
        return dtype, shape, stream.tell()
