"""From files on disk to catalog rows: discover, hash, gate, probe, deduplicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.functions.scalars import song_id
from reelgate.operators.gates import (
    capability_gate,
    flatten_rights,
    require_empty,
    source_exclusions,
)
from reelgate.operators.lineage import allow_join, dedup_by_hash
from reelgate.sources.media import hash_files, probe_media
from reelgate.session import pinned


@dataclass(frozen=True)
class Ingested:
    """Catalog rows to append, the outcome per file, and every denial with its reason."""

    catalog: DataFrame
    results: DataFrame
    denials: DataFrame


def ingest(
    files: DataFrame,
    rights: DataFrame,
    exclusions: DataFrame,
    catalog: DataFrame,
    at: Column,
    *,
    assets: DataFrame | None = None,
    strict: bool = False,
) -> Ingested:
    """Import the allowed files of each artist.

    ``files``: artist_id, path, filename. ``rights``: nested manifests, or flat ones beside
    ``assets`` (artist_id, sha256) where the lists outgrow a document. ``exclusions``:
    artist_id, sha256, filename, reason, pos; ``catalog``: artist_id, song_id, source_sha256.
    Files are hashed before the gates, as these go by hash, but only files that pass are
    probed. Hashes are pinned: each file is read once whatever is derived from it.
    """
    keyed = files.withColumn("capability", F.lit("training"))
    if assets is None:
        assets = rights.select("artist_id", F.explode("source_assets.sha256").alias("sha256"))
        rights = flatten_rights(rights)
    judged = capability_gate(keyed, rights, at).drop("capability")
    hashed = pinned(hash_files(judged.where("allowed").drop("allowed", "denial_reason")))
    per_artist = F.concat_ws("/", "artist_id", "sha256")
    by_name = F.concat_ws("/", "artist_id", "filename")
    scoped = exclusions.select(
        per_artist.alias("sha256"), by_name.alias("filename"), "reason", "pos"
    )
    gated = source_exclusions(
        hashed.withColumn("__h", per_artist).withColumn("__n", by_name),
        scoped,
        sha256="__h",
        filename="__n",
    ).drop("__h", "__n")
    listed = assets.select(
        F.col("artist_id").alias("__o"), F.col("sha256").alias("__a")
    ).distinct()
    gated = gated.join(
        listed, (F.col("artist_id") == F.col("__o")) & (F.col("sha256") == F.col("__a")), "left"
    )
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("exclusion_reason").isNotNull(), F.col("exclusion_reason"))
        .when(F.col("__a").isNull(), "not allow-listed")
    )
    gated = gated.withColumn("denial_reason", reason).drop("__o", "__a", "exclusion_reason", "error")
    denials = (
        judged.where(~F.col("allowed"))
        .select("artist_id", "path", F.lit(None).cast("string").alias("sha256"), "denial_reason")
        .unionByName(
            gated.where(F.col("denial_reason").isNotNull()).select(
                "artist_id", "path", "sha256", "denial_reason"
            )
        )
    )
    passed = gated.where(F.col("denial_reason").isNull()).drop("denial_reason")
    known = catalog.select(
        "song_id", F.concat_ws("/", "artist_id", "source_sha256").alias("source_sha256")
    )
    matched = allow_join(passed.withColumn("__h", per_artist), known, sha256="__h").drop("__h")
    fresh = dedup_by_hash(
        matched.where("status = 'imported'"),
        [F.lower("path"), F.col("path")],
        key=["artist_id", "sha256"],
    )
    # headers are read once; catalog rows, outcomes and denials all follow from the same reading
    probed = pinned(probe_media(fresh))
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    rows = probed.where(F.col("error").isNull()).select(
        "artist_id",
        song_id(stem, "sha256").alias("song_id"),
        stem.alias("title"),
        F.col("filename").alias("source_filename"),
        F.col("sha256").alias("source_sha256"),
        F.col("path").alias("original_path"),
        F.col("sha256").alias("original_sha256"),
        F.struct("duration_seconds", "sample_rate", "channels", "codec", "format_name").alias(
            "audio"
        ),
    )
    # what a copy's first file turned out to be holds for every copy of the same content
    read = probed.select(
        F.col("artist_id").alias("__o"),
        F.col("sha256").alias("__c"),
        F.col("path").alias("__first"),
        song_id(stem, "sha256").alias("__song"),
        F.col("error").alias("__error"),
    )
    judged_copies = matched.join(
        read, (F.col("artist_id") == F.col("__o")) & (F.col("sha256") == F.col("__c")), "left"
    )
    bad = judged_copies.where(F.col("__error").isNotNull()).select(
        "artist_id", "path", "sha256", F.col("__error").alias("denial_reason")
    )
    copy = F.col("__first").isNull() | (F.col("path") != F.col("__first"))
    results = judged_copies.where(F.col("__error").isNull()).select(
        "artist_id",
        "path",
        "sha256",
        F.coalesce("known_song_id", "__song").alias("song_id"),
        F.when(copy, "duplicate").otherwise(F.col("status")).alias("status"),
    )
    denials = denials.unionByName(bad)
    if strict:
        require_empty(denials, "denied source")
    return Ingested(rows, results, denials)
