"""The rule sets and readers of governance records over records damaged in every way.

Each document gives one record per rule set. Its columns are plain expressions that both engines
read, so that the SQL twins judge the same records by their own rules.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.catalogue.media import _export, _folder, _name, _npy, _text
from reelgate.catalogue.registry import query, table
from reelgate.operators import gates
from reelgate.sources import documents, media

_HASH = "lpad(CAST(k AS STRING), 64, '0')"
_DAY = "CAST('2024-01-01' AS TIMESTAMP)"
_SONG = "CASE WHEN k % {n} = 1 THEN 'Song ' || k ELSE 'song-' || k END"
_HEX = "regexp_matches({}, '^[a-f0-9]{{64}}$')"


def _metrics() -> tuple[dict[str, str], dict[str, str]]:
    """Each metric in its middle, at times below its range, above it or missing."""
    columns, rules = {}, {}
    for number, (name, (low, high)) in enumerate(gates.METRIC_RANGES.items()):
        positive = name in gates.POSITIVE_METRICS
        above = low + 10 if high is None else high + 1
        middle = low + 5 if high is None else (low + high) / 2
        below = low if positive else low - 1
        columns[name] = (
            f"CAST(CASE WHEN k % 31 = {number} THEN {below} WHEN k % 37 = {number} THEN {above} "
            f"WHEN k % 41 <> {number} THEN {middle} END AS DOUBLE)"
        )
        rules[name] = f"{name} {'>' if positive else '>='} {low}" + ("" if high is None else f" AND {name} <= {high}")
    return columns, rules


#: Per rule set: the rules, the record's columns, and the same rules for the twin.
SETS = {
    "metrics": (gates.metric_range_rules, *_metrics()),
    "catalog": (
        gates.catalog_rules,
        {
            "song_id": _SONG.format(n=13),
            "title": "CASE WHEN k % 26 = 2 THEN '' WHEN k % 26 = 15 THEN repeat('x', 501) ELSE 'title' END",
            "source_filename": "CASE WHEN k % 13 = 3 THEN '' ELSE 'a.wav' END",
            "source_sha256": f"CASE WHEN k % 13 = 4 THEN 'ABC' ELSE {_HASH} END",
            "original_path": "CASE WHEN k % 13 = 5 THEN '' ELSE 'data/a.wav' END",
            "original_sha256": f"CASE WHEN k % 13 <> 6 THEN {_HASH} END",
            "seconds": "CAST(CASE WHEN k % 13 = 7 THEN 0 ELSE 2.5 END AS DOUBLE)",
            "rate": "CASE WHEN k % 13 = 8 THEN 0 ELSE 8000 END",
            "channels": "CASE WHEN k % 13 = 9 THEN -1 ELSE 2 END",
            "codec": "CASE WHEN k % 13 = 10 THEN '' ELSE 'PCM_16' END",
            "format": "CASE WHEN k % 13 <> 11 THEN 'WAV' END",
            "normalized_sha256": f"CASE WHEN k % 13 = 12 THEN 'x' WHEN k % 2 = 0 THEN {_HASH} END",
        },
        {
            "song_id": "regexp_matches(song_id, '^song-[a-z0-9-]+$')",
            "title": "length(title) BETWEEN 1 AND 500",
            "source_filename": "length(source_filename) > 0",
            "source_sha256": _HEX.format("source_sha256"),
            "original_path": "length(original_path) > 0",
            "original_sha256": _HEX.format("original_sha256"),
            "duration": "seconds > 0",
            "sample_rate": "rate > 0",
            "channels": "channels > 0",
            "codec": "length(codec) > 0",
            "format_name": "length(format) > 0",
            "normalized_sha256": f"normalized_sha256 IS NULL OR {_HEX.format('normalized_sha256')}",
        },
    ),
    "rights": (
        gates.rights_rules,
        {
            "artist_id": "CASE WHEN k % 18 = 1 THEN 'Bad Id' WHEN k % 18 = 10 THEN repeat('a', 65) ELSE 'artist-' || k END",
            "status": "CASE WHEN k % 9 = 2 THEN 'unknown' ELSE 'approved' END",
            "effective_at": f"CASE WHEN k % 4 > 0 OR k % 9 = 3 THEN {_DAY} END",
            "expires_at": f"CASE WHEN k % 9 = 3 THEN {_DAY} ELSE CAST('2025-01-01' AS TIMESTAMP) END",
            "listed": "k % 10 > 0",
            "holder": "CASE WHEN k % 9 = 4 THEN '' ELSE 'h' END",
            "evidence": "CASE WHEN k % 9 = 6 THEN '' ELSE 'e' END",
            "approved_at": f"CASE WHEN k % 9 <> 5 THEN {_DAY} END",
            "asset": f"CASE WHEN k % 9 = 7 THEN 'short' ELSE {_HASH} END",
            "proof": "CASE WHEN k % 9 = 8 THEN '' ELSE 'p' END",
        },
        {
            "artist_id": "regexp_matches(artist_id, '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(artist_id) BETWEEN 1 AND 64",
            "status": "status IN ('pending', 'approved', 'expired', 'revoked')",
            "window": "effective_at IS NULL OR expires_at IS NULL OR expires_at > effective_at",
            "approvals": "NOT listed OR (length(holder) > 0 AND length(evidence) > 0 AND approved_at IS NOT NULL)",
            "source_assets": f"NOT listed OR ({_HEX.format('asset')} AND length(proof) > 0)",
        },
    ),
    "exclusions": (
        gates.exclusion_rules,
        {
            "sha256": f"CASE WHEN k % 6 = 1 THEN 'x' ELSE {_HASH} END",
            "filename": "CASE WHEN k % 6 = 2 THEN 'a/b.mp3' WHEN k % 6 = 3 THEN '..' ELSE 'b.mp3' END",
            "reason": "CASE WHEN k % 6 = 4 THEN '' ELSE 'withdrawn' END",
            "excluded_at": f"CASE WHEN k % 6 <> 5 THEN {_DAY} END",
        },
        {
            "sha256": _HEX.format("sha256"),
            "filename": "length(filename) > 0 AND NOT contains(filename, '/') AND filename NOT IN ('.', '..')",
            "reason": "length(reason) > 0",
            "excluded_at": "excluded_at IS NOT NULL",
        },
    ),
    "intervals": (
        gates.interval_rules,
        {
            "start_s": "CAST(CASE WHEN k % 5 = 1 THEN -1 WHEN k % 5 = 2 THEN -3 ELSE 5 END AS DOUBLE)",
            "end_s": "CAST(CASE WHEN k % 5 = 2 THEN -2 WHEN k % 5 = 3 THEN 5 ELSE 9 END AS DOUBLE)",
            "reason": "CASE WHEN k % 5 <> 4 THEN 'noise' END",
        },
        {"start": "start_s >= 0", "end": "end_s > 0", "order": "end_s > start_s", "reason": "length(reason) > 0"},
    ),
    "music": (
        gates.music_policy_rules,
        {
            "song_id": _SONG.format(n=4),
            "exclude_from_training": "CASE WHEN k % 4 > 1 THEN true WHEN k % 4 = 1 THEN false END",
            "reason": "CASE WHEN k % 8 = 2 THEN '' ELSE 'poor' END",
            "excluded_at": f"CASE WHEN k % 8 <> 3 THEN {_DAY} END",
        },
        {
            "song_id": "regexp_matches(song_id, '^song-[a-z0-9-]+$')",
            "audit": "NOT coalesce(exclude_from_training, false) OR (length(reason) > 0 AND excluded_at IS NOT NULL)",
        },
    ),
    "voice": (
        gates.voice_policy_rules,
        {
            "song_id": _SONG.format(n=4),
            "exclude_entire_song": "CASE WHEN k % 4 > 1 THEN true WHEN k % 4 = 1 THEN false END",
            "reason": "CASE WHEN k % 8 <> 2 THEN 'live' END",
        },
        {
            "song_id": "regexp_matches(song_id, '^song-[a-z0-9-]+$')",
            "reason": "NOT coalesce(exclude_entire_song, false) OR length(reason) > 0",
        },
    ),
    "generation": (
        gates.generation_rules,
        {
            "prompt": "CASE WHEN k % 14 = 1 THEN '' WHEN k % 14 = 8 THEN repeat('y', 10001) ELSE 'a song' END",
            "duration_seconds": "CASE WHEN k % 7 = 2 THEN 5 ELSE 60 END",
            "bpm": "CASE WHEN k % 7 = 3 THEN 10 WHEN k % 2 = 0 THEN 90 END",
            "key": "CASE WHEN k % 7 = 4 THEN repeat('z', 51) WHEN k % 2 = 0 THEN 'C' END",
            "vocal_language": "CASE WHEN k % 7 = 5 THEN 'ENG' WHEN k % 7 = 6 THEN 'unknown' ELSE 'en' END",
            "seed": "CASE WHEN k % 7 = 6 THEN -1 ELSE k END",
        },
        {
            "prompt": "length(prompt) BETWEEN 1 AND 10000",
            "duration_seconds": "duration_seconds BETWEEN 10 AND 600",
            "bpm": "bpm IS NULL OR bpm BETWEEN 20 AND 300",
            "key": "\"key\" IS NULL OR length(\"key\") <= 50",
            "vocal_language": "regexp_matches(vocal_language, '^(?:[a-z]{2,3}|unknown|instrumental)$')",
            "seed": "seed >= 0",
        },
    ),
}


def _twin(name: str) -> str:
    _, columns, rules = SETS[name]
    record = ", ".join(f'{expression} AS "{column}"' for column, expression in columns.items())
    failed = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{rule_name}' END" for rule_name, rule in rules.items())
    return f"""SELECT '{name}' AS rule_set, k AS record, unnest(list_filter([{failed}], lambda x: x IS NOT NULL)) AS violation
    FROM (SELECT k, {record} FROM (SELECT doc_id AS k FROM documents))"""


def _nested(name: str, df: DataFrame) -> DataFrame:
    if name == "catalog":
        audio = F.struct(
            F.col("seconds").alias("duration_seconds"), F.col("rate").alias("sample_rate"), "channels", "codec",
            F.col("format").alias("format_name"),
        )
        return df.withColumn("audio", audio)
    if name == "rights":
        approval = F.struct("holder", F.lit("s").alias("scope"), F.col("evidence").alias("evidence_reference"), "approved_at")
        asset = F.struct(F.col("asset").alias("sha256"), F.col("proof").alias("evidence_reference"))
        return df.select(
            "k", "artist_id", "status", "effective_at", "expires_at",
            F.when(F.col("listed"), F.array(approval)).alias("approvals"),
            F.when(F.col("listed"), F.array(asset)).alias("source_assets"),
        )
    return df


@query("rule_violations", " UNION ALL ".join(_twin(name) for name in SETS))
def rule_violations(spark, d):
    """Every rule of every set is broken by some record."""
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    found = []
    for name, (rules, columns, _) in SETS.items():
        record = keys.select("k", *[F.expr(e).alias(c) for c, e in columns.items()])
        judged = gates.validate_rows(_nested(name, record), rules())
        found.append(
            judged.select(F.lit(name).alias("rule_set"), F.col("k").alias("record"), F.explode("violations").alias("violation"))
        )
    return reduce(DataFrame.unionByName, found)


def _numbered(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", "s_acctbal")


@query(
    "rights_documents",
    """SELECT s_suppkey::BIGINT AS document, 'artist-' || s_suppkey AS artist_id, CASE WHEN s_suppkey % 5 = 2 THEN 'pending' ELSE 'approved' END AS status,
      (s_suppkey % 3)::INT AS n_approvals, s_suppkey % 2 = 0 AS training, sha256(s_name) AS asset, strftime(TIMESTAMP '2024-01-01' + to_days((s_suppkey % 28)::INT), '%Y-%m-%d') AS effective_on,
      NULL AS violation FROM supplier WHERE s_suppkey % 7 <> 3
    UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid document' FROM supplier WHERE s_suppkey % 7 = 3""",
)
def rights_documents(spark, d):
    """One manifest per supplier; some are no YAML, some no mapping."""
    folder = _folder(spark, "rights")
    approvals = F.array_join(
        F.transform(
            F.when(F.col("k") % 3 > 0, F.sequence(F.lit(1).cast("long"), F.col("k") % 3)).otherwise(F.array().cast("array<bigint>")),
            lambda i: F.format_string("\n- holder: h%d\n  scope: s\n  evidence_reference: e\n  approved_at: 2024-01-01T00:00:00Z", i),
        ),
        "",
    )
    body = F.format_string(
        "artist_id: artist-%d\nstatus: %s\neffective_at: '%sT00:00:00Z'\npermissions:\n  training: %s\napprovals:%s\n"
        "source_assets:\n- sha256: '%s'\n  evidence_reference: e\n",
        "k",
        F.when(F.col("k") % 5 == 2, "pending").otherwise("approved"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 28).cast("int")).cast("string"),
        F.when(F.col("k") % 2 == 0, "true").otherwise("false"),
        F.when(approvals == "", F.lit(" []")).otherwise(approvals),
        F.sha2("s_name", 256),
    )
    broken = F.when(F.col("k") % 2 == 0, "a: [1, 2").otherwise("- only\n- a list\n")
    rows = _numbered(spark, d).select(
        F.format_string("%d.yaml", "k").alias("name"), F.when(F.col("k") % 7 == 3, broken).otherwise(body).alias("body")
    )
    _export(rows, folder, _text)
    good, bad = documents.read_rights(spark, f"{folder}/*.yaml")
    number = F.regexp_extract("path", r"([0-9]+)\.yaml$", 1).cast("long").alias("document")
    read = good.select(
        number,
        "artist_id",
        "status",
        F.size("approvals").alias("n_approvals"),
        F.col("permissions.training").alias("training"),
        F.get("source_assets", F.lit(0))["sha256"].alias("asset"),
        F.date_format("effective_at", "yyyy-MM-dd").alias("effective_on"),
    )
    return read.unionByName(bad.select(number, "violation"), allowMissingColumns=True)


@query(
    "catalog_documents",
    """SELECT s_suppkey::BIGINT AS document, 'artist-' || s_suppkey AS artist_id, 'song-' || s_suppkey || '-' || n AS song_id, 'Title ' || n AS title,
      sha256(s_name) AS source_sha256, s_acctbal + n AS duration_seconds, 8000 * n::INT AS sample_rate, NULL AS violation
    FROM supplier, (SELECT unnest([1, 2, 3]) AS n) WHERE s_suppkey % 6 <> 4 AND n <= s_suppkey % 4
    UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid document' FROM supplier WHERE s_suppkey % 6 = 4""",
)
def catalog_documents(spark, d):
    """One catalog per supplier with up to three songs."""
    folder = _folder(spark, "catalogs")
    songs = F.transform(
        F.filter(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: n <= F.col("k") % 4),
        lambda n: F.struct(
            F.concat(F.lit("song-"), F.col("k").cast("string"), F.lit("-"), n.cast("string")).alias("id"),
            F.concat(F.lit("Title "), n.cast("string")).alias("title"),
            F.sha2("s_name", 256).alias("source_sha256"),
            F.struct((F.col("s_acctbal") + n).alias("duration_seconds"), (8000 * n).alias("sample_rate")).alias("audio"),
        ),
    )
    artist = F.concat(F.lit("artist-"), F.col("k").cast("string")).alias("artist_id")
    whole = F.to_json(F.struct(F.lit(1).alias("schema_version"), artist, songs.alias("songs")))
    rows = _numbered(spark, d).select(
        F.format_string("%d.yaml", "k").alias("name"),
        F.when(F.col("k") % 6 == 4, F.substring(whole, 1, 40)).otherwise(whole).alias("body"),
    )
    _export(rows, folder, _text)
    good, bad = documents.read_catalog(spark, f"{folder}/*.yaml")
    read = good.select(
        F.regexp_extract("artist_id", "([0-9]+)$", 1).cast("long").alias("document"),
        "artist_id",
        "song_id",
        "title",
        "source_sha256",
        F.col("audio.duration_seconds").alias("duration_seconds"),
        F.col("audio.sample_rate").alias("sample_rate"),
    )
    number = F.regexp_extract("path", r"([0-9]+)\.yaml$", 1).cast("long").alias("document")
    return read.unionByName(bad.select(number, "violation"), allowMissingColumns=True)


@query(
    "stem_violations",
    """SELECT s_suppkey::BIGINT AS document, CASE WHEN s_suppkey % 9 = 0 THEN 'corrupt document' ELSE 'missing identity' END AS violation
    FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 10 = 0""",
)
def stem_violations(spark, d):
    """Manifests cut off in the middle, and some without an artist."""
    folder = _folder(spark, "stems")
    owner = F.when(F.col("k") % 10 != 0, F.lit("x")).alias("artist_id")
    whole = F.to_json(F.struct(F.lit(1).alias("schema_version"), owner, F.col("k").cast("string").alias("song_id")))
    rows = _numbered(spark, d).select(
        F.format_string("%d/stems.json", "k").alias("name"),
        F.when(F.col("k") % 9 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("body"),
    )
    _export(rows, folder, _text)
    _, bad = documents.read_stem_manifests(spark, f"{folder}/*/stems.json")
    return bad.select(F.regexp_extract("path", r"([0-9]+)/stems\.json$", 1).cast("long").alias("document"), "violation")


def _damaged_npy(body: str) -> bytes:
    """A contour by its first character: whole, silent, empty, cut within its header, or no contour."""
    kind, text = body[0], body[1:]
    whole = _npy(text)
    if kind == "1":
        return _npy("\0" * 20)
    if kind == "2":
        return _npy("")
    if kind == "3":
        return whole[:20]
    if kind == "4":
        return np.random.default_rng(0).bytes(64)
    return whole


@query(
    "contour_violations",
    """SELECT doc_id AS series_id, CASE WHEN doc_id % 11 = 1 THEN 'no voiced frame' WHEN doc_id % 11 = 2 OR text = '' THEN 'empty contour' ELSE 'unreadable' END AS violation
    FROM documents WHERE doc_id % 11 BETWEEN 1 AND 4 OR text = ''""",
)
def contour_violations(spark, d):
    folder = _folder(spark, "contours")
    kind = F.when(F.col("doc_id") % 11 < 5, F.col("doc_id") % 11).otherwise(0)
    rows = table(spark, d, "documents").select(
        _name(".npy").alias("name"), F.concat(kind.cast("string"), "text").alias("body")
    )
    _export(rows, folder, _damaged_npy)
    files = media.discover_media(spark, folder, [".npy"]).select(
        F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("long").alias("series_id"), "path"
    )
    _, bad = media.read_contours(files)
    known = F.col("violation").isin("no voiced frame", "empty contour")
    return bad.select("series_id", F.when(known, F.col("violation")).otherwise("unreadable").alias("violation"))
