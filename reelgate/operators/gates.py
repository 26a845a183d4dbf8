"""Fail-closed gates: rights, exclusions, intervals, thresholds and row rules.

A gate never drops a row silently: each either adds a verdict column or has a twin that
returns the denied rows with their reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgate.functions.scalars import (
    POLICY_MARKERS,
    fold_case,
    has_marker,
)
from reelgate.operators.scan import Running, ordered_scan

CAPABILITIES = ("training", "music_style", "singing_voice", "commercial_release")
SHA256 = "^[a-f0-9]{64}$"
CANONICAL_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"

# The accepted range (low, high) of each metric, None where it is open, and
# whether the bounds themselves are accepted.
BANK_RULES = {
    "duration_seconds": (12.0, 18.0),
    "voiced_fraction": (0.70, 0.95),
    "one_second_level_range_db": (None, 6.0),
    "clipping_fraction": (0.0, 0.0),
    "active_rms_dbfs": (-40.0, None),
}
LEAD_RULES = {
    "voiced_fraction": (0.72, 0.98),
    "one_second_level_range_db": (None, 8.0),
    "clipping_fraction": (0.0, 0.0),
    "active_rms_dbfs": (-45.0, None),
    "peak_dbfs": (None, -0.1),
    "high_band_ratio_db": (-35.0, None),
    "longest_voicing_seconds": (1.2, None),
    "centre_dominance_db": (3.0, None),
}
# The physical range of each reference metric.
METRIC_RANGES = {
    "duration_seconds": (0.0, 60.0),
    "voiced_fraction": (0.0, 1.0),
    "median_f0_hz": (0.0, None),
    "f0_p05_hz": (0.0, None),
    "f0_p95_hz": (0.0, None),
    "active_rms_dbfs": (-120.0, 0.0),
    "one_second_level_range_db": (0.0, 120.0),
    "peak_dbfs": (-120.0, 1.0),
    "clipping_fraction": (0.0, 1.0),
    "high_band_ratio_db": (-120.0, 60.0),
}
POSITIVE_METRICS = ("duration_seconds", "median_f0_hz", "f0_p05_hz", "f0_p95_hz")


def capability_gate(
    requests: DataFrame,
    rights: DataFrame,
    at: Column,
    *,
    key: str = "artist_id",
    capability: str = "capability",
) -> DataFrame:
    """Add ``allowed`` and ``denial_reason`` to requests of (key, capability).

    ``rights`` has one row per key: status, effective_at, expires_at, n_approvals and one
    boolean per capability. The first failing rule gives the reason.
    """
    flags = [c for c in CAPABILITIES if c in rights.columns]
    known = rights.select(
        F.col(key).alias("__rights_key"),
        F.col("status").alias("__status"),
        F.col("effective_at").alias("__from"),
        F.col("expires_at").alias("__until"),
        F.col("n_approvals").alias("__approvals"),
        *[F.col(c).alias(f"__flag_{c}") for c in flags],
    )
    joined = requests.join(known, F.col(key) == F.col("__rights_key"), "left")
    granted = F.lit(False)
    for c in flags:
        granted = F.when(
            F.col(capability) == c, F.coalesce(F.col(f"__flag_{c}"), F.lit(False))
        ).otherwise(granted)
    reason = (
        F.when(F.col("__rights_key").isNull(), "no rights manifest")
        .when(F.coalesce(F.col("__approvals"), F.lit(0)) < 1, "no approval evidence")
        .when(~F.coalesce(F.col(capability).isin(*flags), F.lit(False)), "unknown capability")
        .when(~F.col("__status").eqNullSafe("approved"), "not approved")
        .when(F.col("__from").isNotNull() & (at < F.col("__from")), "not yet effective")
        .when(F.col("__until").isNotNull() & (at >= F.col("__until")), "expired")
        .when(~granted, "capability not granted")
    )
    temporary = [c for c in known.columns]
    return (
        joined.withColumn("denial_reason", reason)
        .withColumn("allowed", F.col("denial_reason").isNull())
        .drop(*temporary)
    )


def flatten_rights(rights: DataFrame) -> DataFrame:
    """Turn nested rights manifests into the flat shape ``capability_gate`` takes."""
    return rights.select(
        "artist_id",
        "status",
        "effective_at",
        "expires_at",
        F.coalesce(F.size("approvals"), F.lit(0)).alias("n_approvals"),
        *[F.col(f"permissions.{c}").alias(c) for c in CAPABILITIES],
    )


def source_allowlist(df: DataFrame, allowed: DataFrame, key: str = "sha256") -> DataFrame:
    return df.join(allowed.select(key), key, "left_semi")


def source_denied(df: DataFrame, allowed: DataFrame, key: str = "sha256") -> DataFrame:
    return df.join(allowed.select(key), key, "left_anti")


def source_exclusions(
    df: DataFrame,
    excluded: DataFrame,
    *,
    sha256: str = "sha256",
    filename: str | None = "filename",
) -> DataFrame:
    """Add ``exclusion_reason``: the first policy row that matches by hash or file name.

    An OR inside the join condition would be a nested loop, so each way to match is an
    equi join of its own against the first row per hash and per folded name.
    """
    first = F.min(F.struct("pos", "reason"))
    by_hash = excluded.groupBy(F.col("sha256").alias("__xh")).agg(first.alias("__byhash"))
    joined = df.join(by_hash, F.col(sha256) == F.col("__xh"), "left")
    match = F.col("__byhash")
    if filename is not None:
        by_name = excluded.groupBy(fold_case("filename").alias("__xn")).agg(first.alias("__byname"))
        joined = joined.join(by_name, fold_case(filename) == F.col("__xn"), "left")
        match = F.least(F.col("__byhash"), F.col("__byname"))
    return joined.withColumn("exclusion_reason", match["reason"]).drop(
        "__xh", "__xn", "__byhash", "__byname"
    )


def music_song_gate(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Keep songs the music policy does not exclude; the voice policy is not consulted."""
    denied = policy.where(F.coalesce("exclude_from_training", F.lit(False))).select("song_id")
    return df.join(denied, "song_id", "left_anti")


def voice_song_gate(
    df: DataFrame,
    policy: DataFrame,
    label: Column,
    *,
    markers: Sequence[str] = POLICY_MARKERS,
    reject_live: bool | Column = True,
    key: str = "song_id",
    name: str | None = None,
) -> DataFrame:
    """Add ``voice_excluded`` and ``voice_reason``: whole-song flag or live marker.

    ``policy`` has one row per song: exclude_entire_song, reason. ``reject_live`` may be a
    column, as each artist's policy says; ``name`` is the column whose text is searched for
    markers beside ``label`` where the key is not the song's own name.
    """
    rules = policy.select(
        F.col(key).alias("__pk"),
        F.coalesce("exclude_entire_song", F.lit(False)).alias("__whole"),
        F.col("reason").alias("__why"),
    )
    joined = df.join(rules, F.col(key) == F.col("__pk"), "left")
    whole = F.coalesce(F.col("__whole"), F.lit(False))
    marked = F.lit(False)
    if reject_live is not False:
        marked = has_marker(F.concat_ws(" ", F.col(name or key).cast("string"), label), markers)
    if isinstance(reject_live, Column):
        marked = marked & F.coalesce(reject_live, F.lit(True))
    return (
        joined.withColumn("voice_excluded", whole | marked)
        .withColumn(
            "voice_reason",
            F.when(
                whole | marked, F.coalesce(F.col("__why"), F.lit("live recordings are excluded"))
            ),
        )
        .drop("__pk", "__whole", "__why")
    )


def interval_exclusion(
    windows: DataFrame,
    intervals: DataFrame,
    *,
    key: str = "song_id",
    window_id: Sequence[str] = ("start_s",),
    window: tuple[str, str] = ("start_s", "end_s"),
    interval: tuple[str, str] = ("start_s", "end_s"),
    large: bool | None = None,
) -> DataFrame:
    """Windows that overlap no excluded interval of their key (half-open: touching passes).

    A window overlaps one exactly if, among the intervals that start before the window's
    end, the latest end lies after the window's start. One running maximum over both
    tables in position order answers that, without pairing windows with intervals.
    """
    starts, ends = window
    marks = windows.select(
        F.col(key).alias("__key"),
        F.col(ends).cast("double").alias("__at"),
        F.lit(0).alias("__kind"),
        F.lit(None).cast("double").alias("__reach"),
        F.struct(*windows.columns).alias("__row"),
        *[F.col(c).alias(f"__id{i}") for i, c in enumerate(window_id)],
    )
    walls = intervals.select(
        F.col(key).alias("__key"),
        F.col(interval[0]).cast("double").alias("__at"),
        F.lit(1).alias("__kind"),
        F.col(interval[1]).cast("double").alias("__reach"),
    ).groupBy("__key", "__at", "__kind").agg(F.max("__reach").alias("__reach"))
    both = marks.unionByName(walls, allowMissingColumns=True)
    order = ["__at", "__kind", *[f"__id{i}" for i in range(len(window_id))]]
    scanned = ordered_scan(
        both, ["__key"], order, {"__until": Running("max_before", "__reach")}, large=large
    )
    kept = scanned.where(
        (F.col("__kind") == 0)
        & ~F.coalesce(F.col("__until") > F.col(f"__row.{starts}"), F.lit(False))
    )
    return kept.select("__row.*")


def metric_gate(df: DataFrame, rules: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Add ``failed_rules``; a null or NaN metric fails its rule."""
    failed = []
    for name, (low, high) in rules.items():
        value = F.col(name)
        ok = ~F.isnan(value.cast("double"))
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
        failed.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return df.withColumn("failed_rules", F.array_compact(F.array(*failed)))


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules that are false or null."""
    failed = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without and with violations."""
    return df.where(F.size("violations") == 0), df.where(F.size("violations") > 0)


def optional(column: str, rule: Column) -> Column:
    """A rule that a null value satisfies."""
    return F.col(column).isNull() | rule


def sha256_rule(column: str) -> Column:
    return F.col(column).rlike(SHA256)


def id_rule(column: str) -> Column:
    return F.col(column).rlike(CANONICAL_ID) & F.length(column).between(1, 64)


def leaf_name_rule(column: str) -> Column:
    return (F.length(column) > 0) & ~F.col(column).rlike(r"[/\\]") & ~F.col(column).isin(".", "..")


def metric_range_rules() -> dict[str, Column]:
    rules = {}
    for name, (low, high) in METRIC_RANGES.items():
        value = F.col(name)
        rule = (value > low) if name in POSITIVE_METRICS else (value >= low)
        rules[name] = rule if high is None else rule & (value <= high)
    return rules


def catalog_rules() -> dict[str, Column]:
    return {
        "song_id": F.col("song_id").rlike("^song-[a-z0-9-]+$"),
        "title": F.length("title").between(1, 500),
        "source_filename": F.length("source_filename") > 0,
        "source_sha256": sha256_rule("source_sha256"),
        "original_path": F.length("original_path") > 0,
        "original_sha256": sha256_rule("original_sha256"),
        "duration": F.col("audio.duration_seconds") > 0,
        "sample_rate": F.col("audio.sample_rate") > 0,
        "channels": F.col("audio.channels") > 0,
        "codec": F.length("audio.codec") > 0,
        "format_name": F.length("audio.format_name") > 0,
        "normalized_sha256": optional("normalized_sha256", sha256_rule("normalized_sha256")),
    }


def rights_rules() -> dict[str, Column]:
    return {
        "artist_id": id_rule("artist_id"),
        "status": F.col("status").isin("pending", "approved", "expired", "revoked"),
        "window": F.col("effective_at").isNull()
        | F.col("expires_at").isNull()
        | (F.col("expires_at") > F.col("effective_at")),
        "approvals": F.coalesce(
            F.forall(
                "approvals",
                lambda a: (F.length(a["holder"]) > 0)
                & (F.length(a["scope"]) > 0)
                & (F.length(a["evidence_reference"]) > 0)
                & a["approved_at"].isNotNull(),
            ),
            F.col("approvals").isNull(),
        ),
        "source_assets": F.coalesce(
            F.forall(
                "source_assets",
                lambda s: s["sha256"].rlike(SHA256) & (F.length(s["evidence_reference"]) > 0),
            ),
            F.col("source_assets").isNull(),
        ),
    }


def exclusion_rules() -> dict[str, Column]:
    return {
        "sha256": sha256_rule("sha256"),
        "filename": leaf_name_rule("filename"),
        "reason": F.length("reason") > 0,
        "excluded_at": F.col("excluded_at").isNotNull(),
    }


def interval_rules() -> dict[str, Column]:
    return {
        "start": F.col("start_s") >= 0,
        "end": F.col("end_s") > 0,
        "order": F.col("end_s") > F.col("start_s"),
        "reason": F.length("reason") > 0,
    }


def music_policy_rules() -> dict[str, Column]:
    audited = (F.length("reason") > 0) & F.col("excluded_at").isNotNull()
    return {
        "song_id": F.col("song_id").rlike("^song-[a-z0-9-]+$"),
        "audit": ~F.coalesce("exclude_from_training", F.lit(False))
        | F.coalesce(audited, F.lit(False)),
    }


def voice_policy_rules() -> dict[str, Column]:
    return {
        "song_id": F.col("song_id").rlike("^song-[a-z0-9-]+$"),
        "reason": ~F.coalesce("exclude_entire_song", F.lit(False))
        | F.coalesce(F.length("reason") > 0, F.lit(False)),
    }


def generation_rules() -> dict[str, Column]:
    return {
        "prompt": F.length("prompt").between(1, 10_000),
        "duration_seconds": F.col("duration_seconds").between(10, 600),
        "bpm": optional("bpm", F.col("bpm").between(20, 300)),
        "key": optional("key", F.length("key") <= 50),
        "vocal_language": F.col("vocal_language").rlike("^(?:[a-z]{2,3}|unknown|instrumental)$"),
        "seed": F.col("seed").between(0, 2**63 - 1),
    }


def validate_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """Names of unknown, missing or differently typed columns (metadata only, no job)."""
    problems = []
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    for name in sorted(have.keys() | want.keys()):
        if name not in want:
            problems.append(f"unknown column {name}")
        elif name not in have:
            problems.append(f"missing column {name}")
        elif have[name] != want[name]:
            problems.append(
                f"column {name} is {have[name].simpleString()}, not {want[name].simpleString()}"
            )
    return problems


def version_supported(df: DataFrame, supported: int, column: str = "schema_version") -> DataFrame:
    """Add ``version_ok``: a version from 1 up to the supported one."""
    return df.withColumn(
        "version_ok", F.coalesce(F.col(column).between(1, supported), F.lit(False))
    )


def text_required(df: DataFrame, texts: Sequence[DataFrame], key: str) -> DataFrame:
    """Add ``text`` from the first source that has the key, and ``violation``.

    Each source has one row per key (key, text). A source that exists with blank text wins
    over later ones and is then reported as blank.
    """
    joined = df
    found, chosen = [], F.lit(None).cast("string")
    for i, source in enumerate(texts):
        side = source.select(
            F.col(key).alias(f"__k{i}"), F.coalesce("text", F.lit("")).alias(f"__t{i}")
        )
        joined = joined.join(side, F.col(key) == F.col(f"__k{i}"), "left")
        found += [f"__k{i}", f"__t{i}"]
    chosen = F.coalesce(*[F.col(f"__t{i}") for i in range(len(texts))])
    violation = F.when(chosen.isNull(), "missing").when(
        F.regexp_replace(chosen, r"\s+", "") == "", "blank"
    )
    return (
        joined.withColumn("text", chosen).withColumn("violation", violation).drop(*found)
    )


def review_gate(
    decisions: DataFrame, key: str, decided_at: Sequence[str], status: str = "review_status"
) -> DataFrame:
    """Keys whose latest review decision is ``approved``."""
    latest = decisions.groupBy(key).agg(
        F.max_by(status, F.struct(*decided_at)).alias("review_status")
    )
    return latest.where(F.col("review_status") == "approved")


def exclusion_audit(
    source_denied_rows: DataFrame, voice_denied_rows: DataFrame, key: str | Sequence[str] = "song_id"
) -> DataFrame:
    """One audit table (keys, scope, reason) over both scopes, with a fallback reason."""
    keys = [key] if isinstance(key, str) else list(key)
    source = source_denied_rows.select(
        *keys,
        F.lit("source").alias("scope"),
        F.coalesce("exclusion_reason", F.lit("source is excluded")).alias("reason"),
    )
    voice = voice_denied_rows.select(
        *keys,
        F.lit("voice_training").alias("scope"),
        F.coalesce("voice_reason", F.lit("live recordings are excluded")).alias("reason"),
    )
    return source.unionByName(voice)


def require_empty(violations: DataFrame, what: str) -> None:
    """The strict mode of every gate: stop when there is a violation."""
    first = violations.take(1)
    if first:
        raise PermissionError(f"{what}: {first[0].asDict(recursive=True)}")
